"""Licence notices in texts: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' word trigrams are winnowed (of each WINDOW neighbouring hashes the least is kept) into an
inverted index, which is small and fixed and travels with the code. A text's trigrams are looked up; each
template that is hit is aligned with the text around the hit's diagonal within a band, and the share of the
template's words that match, with the span in the text, is the report.

Licences of one family differ in a word or a number, so the words that tell them apart (KEY_WORDS, and numbers
where a template has some) must be the same in the span as in the template, whatever the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

GPL_TAIL = (
    " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
    " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
    " the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
    " from this software without specific prior written permission."
)


def gnu(name: str, version: str) -> list[str]:
    """The short line and the notice of a licence of the GNU family."""
    return [
        f"This work is licensed under the GNU {name}, version {version}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        f" {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any"
        f" later version. This program{GPL_TAIL}",
    ]


def commons(short: str, long: str, version: str) -> list[str]:
    return [
        f"Licensed under {short} {version}.",
        f"This work is licensed under a Creative Commons {long} {version} International License.",
    ]


#: Public licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        ' law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES'
        " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
        " limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice"
        " shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-2.0": gnu("General Public License", "2"),
    "GPL-3.0": gnu("General Public License", "3"),
    "LGPL-2.1": gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0": gnu("Lesser General Public License", "3"),
    "AGPL-3.0": gnu("Affero General Public License", "3"),
    **{f"CC-BY-{v}": commons("CC BY", "Attribution", v) for v in ("2.0", "2.5", "3.0")},
    **{f"CC-BY-SA-{v}": commons("CC BY-SA", "Attribution-ShareAlike", v) for v in ("2.0", "2.5", "3.0")},
    "CC-BY-4.0": commons("CC BY", "Attribution", "4.0"),
    "CC-BY-SA-4.0": commons("CC BY-SA", "Attribution-ShareAlike", "4.0"),
    "CC-BY-ND-4.0": commons("CC BY-ND", "Attribution-NoDerivatives", "4.0"),
    "CC-BY-NC-4.0": commons("CC BY-NC", "Attribution-NonCommercial", "4.0"),
    "CC-BY-NC-SA-4.0": commons("CC BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "4.0"),
    "CC-BY-NC-ND-4.0": commons("CC BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "4.0"),
    "BSD-2-Clause": [BSD_START],
    "BSD-3-Clause": [BSD_START + BSD_THIRD],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,"
        " sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or"
        " non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software"
        " to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any"
        " damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying"
        ' documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the'
        " Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is"
        " available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
#: Words that tell licences apart; a span must have those of its template and no others of them.
KEY_WORDS = frozenset(
    b"affero apache attribution boost by bsd commons eclipse gnu isc lesser library mit mozilla nc nd noderivatives noncommercial sa sharealike".split()
)

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GRAM = 3
WINDOW = 2


@dataclass(frozen=True)
class ScanSettings:
    """``least_coverage`` holds for templates of fewer than ``long_words`` words, ``long_coverage`` for others, which
    are reported with their lower coverage where a notice is cut or partly rewritten."""

    band: int = 8
    least_coverage: float = 0.8
    long_words: int = 20
    long_coverage: float = 0.5
    gap: int = -1
    other: int = -1


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def telling(words: list[bytes], numbers: bool) -> set[bytes]:
    return {w for w in words if w in KEY_WORDS or (numbers and w.isdigit())}


def winnowed(words: list[bytes]) -> dict[int, tuple[bytes, ...]]:
    """Places and trigrams that stay: in each window the least hash, the rightmost of equals."""
    grams = list(zip(*(words[i:] for i in range(GRAM))))
    hashes = [xxhash.xxh64_intdigest(b" ".join(g)) for g in grams]
    kept = {}
    for i in range(max(1, len(grams) - WINDOW + 1)) if grams else ():
        at = min(range(i, min(i + WINDOW, len(grams))), key=lambda j: (hashes[j], -j))
        kept[at] = grams[at]
    return kept


class Scanner:
    def __init__(self, templates: dict[str, list[str]], settings: ScanSettings):
        self.settings = settings
        self.templates = [(name, words_of(t)) for name, texts in templates.items() for t in texts]
        self.index: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.templates):
            for at, gram in winnowed(words).items():
                self.index.setdefault(gram, []).append((k, at))
        self.keys = set(self.index)

    def band_of(self, template: list[bytes]) -> int:
        """Short notices get a narrow band, so that each of several close to each other is found on its own."""
        return min(self.settings.band, max(1, len(template) // 4))

    def align(self, template: list[bytes], words: list[bytes], diagonal: int, band: int) -> tuple[int, int, int, int]:
        """Best local alignment within the band: score, matches, first word, word behind the last."""
        gap, other = self.settings.gap, self.settings.other
        width, none = 2 * band + 1, (0, 0, -1)
        above, best = [none] * (width + 1), (0, 0, 0, 0)
        for i, word in enumerate(template):
            row, left = [], none
            for k in range(width):
                j = i + diagonal + k - band
                cell = none
                if 0 <= j < len(words):
                    s, m, b = above[k]
                    same = words[j] == word
                    cell = (s + 1, m + 1, b if b >= 0 else j) if same else (s + other, m, b)
                    for s, m, b in (above[k + 1], left):
                        if s + gap > cell[0]:
                            cell = (s + gap, m, b)
                    if cell[0] <= 0:
                        cell = none
                    elif same and cell[:2] > best[:2]:
                        best = (cell[0], cell[1], cell[2], j + 1)
                row.append(cell)
                left = cell
            above = row + [none]
        return best

    def scan(self, text: str) -> list[tuple[str, int, float, int, int]]:
        """(licence, matched words, coverage, start, end) with places in characters; spans don't overlap:
        of those that do, the one with the most matched words stays."""
        data = text.encode().lower()
        words = WORD.findall(data)
        if self.keys.isdisjoint(zip(words, words[1:], words[2:])):
            return []
        near: dict[tuple[int, int], int] = {}
        for i, gram in enumerate(zip(words, words[1:], words[2:])):
            for k, at in self.index.get(gram, ()):
                near.setdefault((k, (i - at) // (self.band_of(self.templates[k][1]) + 1)), i - at)
        found = set()
        for (k, _), diagonal in near.items():
            name, template = self.templates[k]
            _, matches, start, end = self.align(template, words, diagonal, self.band_of(template))
            least = self.settings.least_coverage if len(template) < self.settings.long_words else self.settings.long_coverage
            numbers = any(w.isdigit() for w in template)
            if matches >= least * len(template) and telling(words[start:end], numbers) == telling(template, numbers):
                found.add((-matches, start, end, name, matches / len(template)))
        if not found:
            return []
        places = [m.span() for m in WORD.finditer(data)]
        before = np.r_[0, np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)]  # characters before each byte
        out, taken = [], []  # spans by their start; they never overlap
        for minus, start, end, name, coverage in sorted(found):
            k = bisect_left(taken, (start,))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                insort(taken, (start, end))
                chars = (int(before[places[start][0]]), int(before[places[end - 1][1]]))
                out.append((name, -minus, round(coverage, 4), *chars))
        return sorted(out, key=lambda x: x[3])


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, settings: ScanSettings = ScanSettings()) -> DataFrame:
    """One row for each licence notice in each text: doc_id, license, matched_words, coverage, span_start,
    span_end (characters).

    Null and blank texts have none. Of overlapping notices the one with the most matched words is reported, of ties
    the first in the text, then by name. Rows are scanned alone: repeated rows give repeated reports, ids may be null, texts of any length take linear time; an empty table gives an empty result; other columns are
    ignored.
    """

    def run(batches):
        scanner = Scanner(templates, settings)
        for batch in batches:
            rows = [
                (doc, *hit)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                if text
                for hit in scanner.scan(text)
            ]
            columns = list(zip(*rows)) or [()] * 6
            types = [batch.column(0).type, pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "license", "matched_words", "coverage", "span_start", "span_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, matched_words long, coverage double, span_start long, span_end long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
