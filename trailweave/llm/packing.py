"""Packing of tokenised documents into windows of fixed length, with bounded space.

Each partition keeps at most OPEN windows open. A piece goes into the open window with the least room that
holds it; if none does and all slots are taken, the fullest window is emitted. What is still open when the
partitions end is merged by best fit over groups of partitions.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import free_memory, resident, settle, trim_memory

WINDOW = 2048
OPEN = 128
#: Partitions whose open windows are merged by one task: up to OPEN * MERGED windows of light records.
MERGED = 64
END_ID = 1
MOST_WORDS = 800_000
#: Texts whose words are looked up together, in characters (and the one that goes beyond).
GROUP_CHARS = 1_000_000
#: Rows of a batch that a worker has as Python strings at a time.
ROWS_AT_ONCE = 256
#: Words in one text for the tokenizer, and what its vocabulary marks a word's last token with.
JOINED = 128
WORD_END = "</w>"
LONGEST_KEPT = 64
MARKS = b".,!?;:"


class WordIds:
    """Ids of words, as bytes, by the word in lower case (A-Z only); filled on demand.

    The tokenizer drops white space, ignores case and merges inside runs of letters or of marks only, so the
    ids of a text are those of its words in turn, and those of a word with marks behind a letter are those
    of the two, if that letter stays one letter in the tokenizer's normal form. Each distinct word is tokenised
    once while it is remembered, many at a time. A text with a special token's name goes to the tokenizer whole.
    """

    def __init__(self, definition: str, most_words: int = MOST_WORDS):
        self.most_words = most_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Runs of letters go to the tokenizer many in one text, which halves its work. Each word gives one
        word end at least, so if there are as many ends as words, the ends tell whose ids are whose."""
        alone, runs = [], []
        for w in words:
            text = w.decode()
            (runs if text.isalpha() else alone).append((w, text))
        groups = [runs[i : i + JOINED] for i in range(0, len(runs), JOINED)]
        found = self.tokenizer.encode_batch_fast([" ".join([t for _, t in g]) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(group):
                alone += group
                continue
            data = ids.tobytes()
            for (w, _), start, end in zip(group, [0, *cuts], cuts):
                yield w, data[start:end]
        for (w, _), e in zip(alone, self.tokenizer.encode_batch_fast([t for _, t in alone], add_special_tokens=False)):
            yield w, array("I", e.ids).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        known, whole, parts = self.known, set(), []
        for w in new:
            core = w.rstrip(MARKS)
            if len(core) < len(w) and core and (core[-1:].isalpha() or stays_a_letter(core.decode()[-1])):
                parts.append((w, core, w[len(core) :]))
                whole.update((core, w[len(core) :]))
            else:
                whole.add(w)
        known.update(self._encoded(list(whole.difference(known))))
        for w, core, marks in parts:
            known[w] = known[core] + known[marks]

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; ASCII white space ends a word."""
        named = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        if not named:
            return (yield from self._batch(texts))
        plain = self._batch(["" if i in named else t for i, t in enumerate(texts)])
        for i, (t, ids) in enumerate(zip(texts, plain)):
            yield array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if i in named else ids

    def _batch(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < GROUP_CHARS:
                group.append(texts[at].encode().lower().split())
                size += len(texts[at])
                at += 1
            new = set().union(*group).difference(self.known)
            if new and len(self.known) + 2 * len(new) > self.most_words:
                self.known.clear()
                new = set().union(*group)
            long = {w for w in new if len(w) > LONGEST_KEPT}
            self._learn(new - long)
            rare = dict(self._encoded(list(long))) if long else {}
            known = self.known
            for words in group:
                if rare and not rare.keys().isdisjoint(words):
                    yield b"".join([rare[w] if w in rare else known[w] for w in words])
                else:
                    yield b"".join(map(known.__getitem__, words))


def stays_a_letter(c: str) -> bool:
    """Whether the tokenizer's normal form of a character is one letter. Some letters become a letter and a
    mark, which would join the marks behind it."""
    normal = unicodedata.normalize("NFC", c.lower())
    return len(normal) == 1 and c.isalpha() and normal.isalpha()


def word_ids(definition: bytes, most_words: int) -> WordIds:
    return resident(("word ids", hashlib.sha256(definition).hexdigest(), most_words), lambda: WordIds(definition.decode(), most_words))


class BestFit:
    """Windows with room, by room; the one with the least sufficient room is found by bit tricks."""

    def __init__(self, window: int, most: int | None):
        self.window, self.most, self.count, self.rooms = window, most, 0, 0
        self.by_room: list[list[tuple[int, list]]] = [[] for _ in range(window + 1)]
        self.made = 0

    def _take(self, room: int) -> tuple[int, list]:
        held = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        self.count -= 1
        return held

    def add(self, size: int, item: tuple) -> Iterator[tuple[int, list]]:
        """Places the item; yields windows that are full or must go. A window is (number, [(offset, item)])."""
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number, items = self._take(room)
        else:
            if self.most is not None and self.count >= self.most and size < self.window:
                yield self._take((self.rooms & -self.rooms).bit_length() - 1)
            room, number, items = self.window, self.made, []
            self.made += 1
        items.append((self.window - room, item))
        room -= size
        if room == 0:
            yield number, items
        else:
            self.by_room[room].append((number, items))
            self.rooms |= 1 << room
            self.count += 1

    def rest(self) -> Iterator[tuple[int, list]]:
        for held in self.by_room:
            yield from held


def few_at_once(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, a few rows at a time: a whole batch as Python strings is twice its size again."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        keys, texts = [x.to_pylist() for x in batch.slice(at, ROWS_AT_ONCE).columns]
        yield keys, [t or "" for t in texts]


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, window: int = WINDOW, most_open: int = OPEN, end_id: int = END_ID, most_words: int = MOST_WORDS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``most_words``: how many words a worker remembers with their ids, some 250 bytes each; fewer cost time only.
    ``path``: a tokenizer definition, which the driver reads and broadcasts (under 2 MB, fixed). A document
    is its ids and then ``end_id``; one longer than the window gives whole windows and a remainder, others
    stay in one piece. Null text counts as empty: the end id alone. Null or repeated ids are documents of
    their own; an empty table gives an empty result; other columns are ignored.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tail = array("I", [end_id]).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = word_ids(shared.value, most_words), TaskContext.get().partitionId()
        fit, rows, kind = BestFit(window, most_open), [], None

        def told(held: tuple[int, list], is_open: bool) -> None:
            number, items = held
            rows.extend((*item, part << 32 | number, offset, is_open) for offset, item in items)

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 8
            rows.clear()
            types = [kind] + [pa.int64()] * 6 + [pa.bool_()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "is_open"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for keys, texts in few_at_once(batch):
                for doc, ids in zip(keys, ids_of.batch(texts)):
                    ids += tail
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        size = min(window, total - start)
                        item = (doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total)
                        for held in fit.add(size, item):
                            told(held, False)
                if len(rows) > 20_000:
                    yield flushed()
        if kind is not None:
            for held in fit.rest():
                told(held, True)
            yield flushed()
        trim_memory()

    schema = PIECES.format(id=id_type)
    pieces = settle(docs.select("doc_id", "text").mapInArrow(run, schema + ", is_open boolean"))

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        free_memory()  # the words are done with
        fit, base = BestFit(window, None), (1 << 62) + (int(key[0]) << 32)
        ends = (pdf["offset"] + pdf["length"]).groupby(pdf["sequence_id"]).max()
        ends = sorted(ends.items(), key=lambda x: (-x[1], x[0]))
        moved: dict[int, tuple[int, int]] = {}
        for old, size in ends:
            for number, items in fit.add(int(size), (old,)):
                moved.update({o: (base + number, offset) for offset, (o,) in items})
        for number, items in fit.rest():
            moved.update({o: (base + number, offset) for offset, (o,) in items})
        old = pdf["sequence_id"]
        pdf["offset"] += old.map({k: v[1] for k, v in moved.items()})
        pdf["sequence_id"] = old.map({k: v[0] for k, v in moved.items()})
        return pdf.drop(columns=["is_open", "grp"])

    group = F.shiftright("sequence_id", 32).cast("long")
    left = pieces.where("is_open").withColumn("grp", F.call_function("div", group, F.lit(MERGED)))
    return pieces.where("not is_open").drop("is_open").unionByName(left.groupBy("grp").applyInPandas(merge, schema))
