"""How a source's words differ from those of others in its language, in exact whole numbers.

Only terms in at least ``least`` documents of a language count. A first pass counts document frequencies in a
count-min sketch: each task fills its own, the tasks' sketches are added up cell by cell, and what reaches the
tasks again is one bit a cell, whether it came to ``least``. A sketch never underestimates, so a term with an
empty bit is impossible and goes before anything is shuffled; the rest is counted exactly. A full sketch lets
more through and changes no result.

Counts are sparse: most terms occur in few sources. For two sources, terms that both have are found by a join on
(language, term); terms that one of them has take part through how many terms it has with each count; terms
that neither has all add the same. So no table of sources by terms is made.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import free_memory, settle

LEAST = 10
UNIT = 1_000_000_000
TOP_TERMS = 10
#: Rows of the sketch, and cells in a row: CELLS_A_DOC for each document between these powers of two. Its bits are
#: at most 3 * 2 ** 24 / 8 = 6 MB.
ROWS, CELLS_A_DOC, LEAST_LOG, MOST_LOG = 3, 16, 16, 24
#: Cells that are added up and shuffled together.
SLICE = 1 << 14
#: A task's counts are passed on when they hold so many terms, or texts of so many bytes are counted.
MOST_TERMS, MOST_BYTES = 1_000_000, 64_000_000
#: ASCII letters become small, other ASCII characters separate terms, all else is part of them.
FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
NUL = b"\0"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split(b" ")


def _cells(lang: bytes, known: list[bytes], log: int) -> np.ndarray:
    """One cell of each row of the sketch for each term of a language."""
    h = np.fromiter([xxhash.xxh3_64_intdigest(lang + NUL + t) for t in known], np.uint64, len(known))
    step = (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << log) - 1)
    return np.stack([((h + np.uint64(k) * step) & mask).astype(np.int64) + (k << log) for k in range(ROWS)])


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).fill_null("").to_pylist() for i in range(3)))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def sketch(docs: DataFrame, log: int, least: int) -> DataFrame:
    """(part, cells): the merged document frequencies, up to ``least``, in slices of SLICE cells."""

    def fill(batches):
        free_memory()
        counts = np.zeros(ROWS << log, np.uint8)
        seen, size, any_row = defaultdict(Counter), 0, False

        def put():
            for lang, found in seen.items():
                n = np.minimum(np.fromiter(found.values(), np.int64, len(found)), least)
                for cells in _cells(lang, list(found), log):
                    total = np.bincount(np.unique(cells, return_inverse=True)[1], n)
                    cells = np.unique(cells)
                    counts[cells] = np.minimum(counts[cells] + total, least).astype(np.uint8)
            seen.clear()

        for lang, _, text in _rows(batches):
            any_row = True
            found = set(terms(text))
            found.discard(b"")
            seen[lang.encode()].update(found)
            size += len(found)
            if size > MOST_TERMS:
                put()
                size = 0
        put()
        if any_row:
            slices = counts.reshape(-1, SLICE)
            full = np.flatnonzero(slices.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([slices[i].tobytes() for i in full], pa.binary())], ["part", "cells"])

    def merge(batches):
        """Slices come sorted; one is added up at a time."""
        at, total = None, None
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["part", "bits"])
                    at, total = part, np.zeros(SLICE, np.uint8)
                total = np.minimum(total + np.frombuffer(cells, np.uint8), least).astype(np.uint8)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()])], ["part", "bits"])

    filled = _read(docs).mapInArrow(fill, "part int, cells binary")
    return filled.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")


def possible_terms(docs: DataFrame, least: int, log: int):
    """Broadcast bits of the sketch: which cells came to ``least``. Their number is fixed by ``log``."""
    bits = np.zeros((ROWS << log) // 8, np.uint8)
    for part, found in sketch(docs, log, least).toArrow().to_pandas().itertuples(index=False):
        bits[part * SLICE // 8 : (part + 1) * SLICE // 8] = np.frombuffer(found, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bits.tobytes())


def sketch_log(docs: DataFrame) -> int:
    return min(max((docs.count() * CELLS_A_DOC - 1).bit_length(), LEAST_LOG), MOST_LOG)


def term_counts(docs: DataFrame, least: int = LEAST, log: int | None = None) -> DataFrame:
    """lang, source, term, n (occurrences, above zero) and in_lang (occurrences in the language), of terms that at
    least ``least`` documents of the language hold."""
    log = sketch_log(docs) if log is None else log
    shared = possible_terms(docs, least, log)

    def count(batches):
        free_memory()
        bits = np.frombuffer(shared.value, np.uint8)
        seen, size, read = defaultdict(lambda: (Counter(), Counter())), 0, 0

        def passed():
            vocabulary = defaultdict(set)  # a term is looked up once for all sources of its language
            for (lang, _), (docs_of, _) in seen.items():
                vocabulary[lang].update(docs_of)
            for lang, every in vocabulary.items():
                every = list(every)
                hit = np.ones(len(every), bool)
                for cells in _cells(lang.encode(), every, log):
                    hit &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                vocabulary[lang] = {t for t, h in zip(every, hit) if h}
            for (lang, source), (docs_of, n_of) in seen.items():
                known = list(vocabulary[lang].intersection(docs_of))
                if known:
                    columns = [pa.array([lang] * len(known)), pa.array([source] * len(known)), pa.array([t.decode() for t in known])]
                    columns += [pa.array([of[t] for t in known], pa.int64()) for of in (docs_of, n_of)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "docs", "n"])
            seen.clear()

        for lang, source, text in _rows(batches):
            found = terms(text)
            docs_of, n_of = seen[lang, source]
            before = len(n_of)
            n_of.update(found)
            every = set(found)
            docs_of.update(every)
            for each in (docs_of, n_of):
                each.pop(b"", None)
            size, read = size + max(len(n_of) - before, 0) + 1, read + len(text)
            if size > MOST_TERMS or read > MOST_BYTES:
                yield from passed()
                size, read = 0, 0
        yield from passed()

    rows = _read(docs).mapInArrow(count, "lang string, source string, term string, docs long, n long")
    rows = rows.repartition("lang", "term")  # serves the sums and the window; tasks have added up their own rows
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    every = Window.partitionBy("lang", "term")
    rows = rows.select("lang", "source", "term", "n", F.sum("n").over(every).alias("in_lang"), F.sum("docs").over(every).alias("in_docs"))
    return rows.where(F.col("in_docs") >= least).drop("in_docs")


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * size)); a count of 10 ** 28 fits."""
    return 1 + F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + 2 * size).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP_TERMS, log: int | None = None) -> DataFrame:
    """lang, source, part, item, value and rank. Part ``pair``: each other source of the language and the sum of
    squared differences of shares over their sums, all of them. Part ``term``: the ``top`` terms in which the
    source exceeds its language most.

    Null lang, source or text counts as empty. A group without terms has pairs like any other; in a language
    without frequent terms all values are 0. Ties go to the lesser item. Repeated rows count again; other
    columns and doc_id are ignored; an empty table gives an empty result.
    """
    counts = settle(term_counts(docs, least, log))
    groups = _read(docs).select("lang", "source").distinct()
    size = counts.groupBy("lang").agg(F.count_distinct("term").alias("size"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    whole = own.groupBy("lang").agg(F.sum("total").alias("whole"))
    groups = groups.join(own, ["lang", "source"], "left").join(size, "lang", "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "size", "whole")])
    none = F.lit(0).cast("long")
    groups = settle(groups.withColumn("zero", F.when(F.col("size") > 0, _share(none, F.col("total"), F.col("size"))).otherwise(none)))
    share = _share(F.col("n"), F.col("total"), F.col("size"))
    shares = counts.join(groups, ["lang", "source"])
    shares = settle(shares.select("lang", "source", "term", share.alias("p"), _share(F.col("in_lang"), F.col("whole"), F.col("size")).alias("q"), "zero"))
    return _pairs(groups, shares).unionByName(_terms(shares, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    return _ranked(above, "term").where(F.col("rank") <= top)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    zero_a, zero_b = F.col("zero_a"), F.col("zero_b")
    sides = [groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "terms", "zero")], *(["size"] if s == "a" else [])) for s in "ab"]
    both = sides[0].join(sides[1], "lang").where("source_a < source_b")
    rest = F.when(F.col("size") > 0, (F.col("size") - F.col("terms_a") - F.col("terms_b")) * _apart(zero_a, zero_b)).otherwise(0)
    found = [both.select("lang", "source_a", "source_b", rest.cast("long").alias("value"))]
    # what one of the two has, as if the other had not: terms with one share count together
    alike = settle(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"), F.first("zero").alias("zero")))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_other"))
    one = alike.join(other, "lang").where("source <> other")
    value = F.sum(F.col("times") * _apart(F.col("p"), F.col("zero_other"))).alias("value")
    found.append(one.groupBy("lang", F.least("source", "other").alias("source_a"), F.greatest("source", "other").alias("source_b")).agg(value))
    # terms that both have: their own value instead of the two above, and once more what neither has
    sides = [shares.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "zero")]) for s in "ab"]
    p, q = F.col("p_a"), F.col("p_b")
    shared = sides[0].join(sides[1], ["lang", "term"]).where("source_a < source_b")
    change = _apart(p, q) - _apart(p, zero_b) - _apart(zero_a, q) + _apart(zero_a, zero_b)
    found.append(shared.groupBy("lang", "source_a", "source_b").agg(F.sum(change).alias("value")))
    total = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    each = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return _ranked(total.select("lang", each.alias("x"), "value").select("lang", "x.source", "x.item", "value"), "pair")
