"""Line-first cleaning: bad lines go, and a document that loses too much of its text goes as a whole."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Marks that may end a sentence, before closing quotes and brackets.
ENDINGS = ".!?…。！？؟।:;"
CLOSERS = "\"'”’»)]"
ASCII_SPACE = " \t\n\v\f\r"
SYMBOLS = re.compile(r"[#*$%&|<>]")
NAVIGATION = re.compile(r" [|»›>·•/] |\|")
#: Phrases of page furniture. A line that holds one and has few words is furniture, not text.
FURNITURE = re.compile(
    r"all rights reserved|click here|read more|sign in|log in|sign up|cookie|privacy policy|terms of (?:use|service)"
    r"|subscribe|newsletter|javascript|lorem ipsum|skip to (?:main )?content|share this|back to top|page \d+ of \d+"
    r"|copyright|©|^\W*(?:licensed under|released under|this work is licensed)",
    re.I,
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds. A document is rejected if it keeps less than ``least_kept`` of its word characters."""

    least_words: int = 3
    furniture_words: int = 14
    navigation_share: float = 0.2
    symbol_share: float = 0.2
    shout_share: float = 0.6
    shout_words: int = 4
    repeat_share: float = 0.5
    least_kept: float = 0.5
    base_words: int = 10
    base_repeat_percent: int = 20


def line_fault(line: str, rules: LineRules) -> str | None:
    """Why a line goes: navigation, symbols, shouting, repetition, boilerplate or punctuation; else None.

    Punctuation: a line without a sentence's end fails only if it is also very short, as list items and
    menu entries are; wrapped and cut prose is left alone.
    """
    words = line.split()
    n = len(words)
    if not n:
        return None
    if len(NAVIGATION.findall(line)) > rules.navigation_share * n:
        return "navigation"
    if len(SYMBOLS.findall(line)) > rules.symbol_share * n and n > 1:
        return "symbols"
    if n >= rules.shout_words and line.count("!!") > rules.shout_share * n:
        return "shouting"
    if n >= 8 and sum(a == b for a, b in zip(words, words[1:])) > rules.repeat_share * n:
        return "repetition"
    if n <= rules.furniture_words and FURNITURE.search(line):
        return "boilerplate"
    if n < rules.least_words and not line.rstrip().rstrip(CLOSERS).endswith(tuple(ENDINGS)):
        return "punctuation"
    return None


def judge(text: str, rules: LineRules) -> dict:
    """Counts, verdicts and the cleaned text of one document."""
    words = text.encode().split()  # at ASCII white space only
    n = len(words)
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set = set()
        twice: set = set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        upto = 0
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 5 - max(i, upto)
                upto = i + 5
    lines = text.split("\n")
    full = [x for x in lines if x.encode().split()]
    base = n < rules.base_words or 100 * repeated > rules.base_repeat_percent * n
    bad = {x for x in full if line_fault(x, rules) is not None}
    good = [x for x in full if x not in bad]
    left = sum(len(w) for x in good for w in x.split())
    had = sum(len(w) for x in full for w in x.split())
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": len(full) - len(set(full)),
        "n_repeat_words": repeated,
        "base_failed": base,
        "kept": not base and left >= rules.least_kept * had,
        "n_lines": len(full),
        "n_bad_lines": len(full) - len(good),
        "cleaned": "\n".join([x for x in lines if x not in bad]) if bad else text,
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines"]


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, kept, n_lines, n_bad_lines, and the cleaned text if ``with_text``.

    Words are runs of anything but ASCII white space; null text has none, so it fails the base rule. Every
    row is judged alone: repeated rows and ids, nulls and texts of any length do no harm, and an empty
    table gives an empty result. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            found = [judge(t or "", rules) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0)] + [pa.array([x[c] for x in found], pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in COUNTS]
            if with_text:
                columns.append(pa.array([x["cleaned"] for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS] + ["cleaned"] * with_text)

    kinds = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in COUNTS)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}" + ", cleaned string" * with_text
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def kept_rows(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows that pass, with all their columns; their texts lose the lines that fail, blank lines stay.

    Null and blank texts fail the base rule. Rows are judged alone, so repeated rows pass or fail together;
    texts of any length are read whole; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [judge(t or "", rules) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array([x["cleaned"] for x in found], batch.schema.field(at).type))
            yield batch.filter(pa.array([x["kept"] for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
