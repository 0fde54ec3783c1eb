"""Removal of multi-line passages that repeat across the corpus, by content-defined line chunks.

A document's lines are cut into chunks where a rolling hash over the last WINDOW line hashes leaves less than CUTS
when divided by OF, or after MOST_LINES lines without such a place (the maximum chunk, which only texts of one repeated line
reach). The cuts depend on the lines around them alone, so inside a repeated passage they fall on the same lines
wherever the passage stands. A chunk is known by its last two lines with words; one that has fewer takes in the line
above, so what is counted is always more than one line. It is counted over the whole corpus by a 128-bit hash;
where it repeats, the bytes are compared with those of its first place, and all equal ones but the first are
repeats. Each repeat is an anchor: it grows up and down, line by line and up to GROW lines, while its neighbours
equal those of the first place, since a passage seldom begins and ends on a cut. So every line that is removed lies
in a run of two lines or more that stands as a whole at another place; a line that repeats on its own is no passage
and stays, also beside others such.

Texts stay where they are: hashes are shuffled for all chunks; bodies only for those whose hash repeats, one for
all the copies in a part of a map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.bits import filter_of, may_hold
from trailweave.llm.common import fresh, settle

WINDOW = 2
#: Three of four places are cuts: short chunks, so that a passage of few lines holds one whole.
CUTS, OF = 3, 4
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
OLDEST = pow(BASE, WINDOW - 1, 1 << 64)
MOST_LINES = 64
GROW = 8
#: Texts are cut in parts of so many bytes, or one text.
PART_BYTES = 2_000_000
WORD_BITS = 16


def line_hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(x.encode()) for x in lines]


def chunks(lines: list[str]) -> Iterator[tuple[int, int]]:
    """(first line, line behind the last) of each chunk."""
    start, rolled, gone = 0, 0, [0] * WINDOW
    for i, x in enumerate(line_hashes(lines)):
        rolled = ((rolled - gone[i % WINDOW] * OLDEST) * BASE + x) & MASK
        gone[i % WINDOW] = x
        if (rolled >> 32) % OF < CUTS or i - start + 1 >= MOST_LINES:
            yield start, i + 1
            start = i + 1
    if start < len(lines):
        yield start, len(lines)


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(first line, line behind the last, text) of what each chunk is known by: its last two lines with words."""
    lines = text.split("\n")
    worded = [i for i, x in enumerate(lines) if x.encode().strip()]  # ASCII white space, as everywhere
    k = 0
    for start, end in chunks(lines):
        before = k
        while k < len(worded) and worded[k] < end:
            k += 1
        if k > before and k > 1:
            yield worded[k - 2], worded[k - 1] + 1, "\n".join(lines[worded[k - 2] : worded[k - 1] + 1])


def _key(text: str) -> tuple[int, int]:
    x = xxhash.xxh3_128_digest(text.encode())
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def row_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def line_code(line: str) -> int:
    """Hash of a line and, in the lowest bits, its words (WORD_BITS bits, more count as the most)."""
    words = min(len(line.encode().split()), (1 << WORD_BITS) - 1)
    return (xxhash.xxh3_64_intdigest(line.encode()) >> WORD_BITS << WORD_BITS | words) - (1 << 63)


def words_in(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << WORD_BITS) - 1))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for doc, text, n in zip(batch.column(0), batch.column(1), pc.binary_length(batch.column(1)).to_pylist()):
        if texts and size + (n or 0) > PART_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc.as_py())
        texts.append(text.as_py() or "")
        size += n or 0
    if texts:
        yield ids, texts


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def chunk_keys(docs: DataFrame) -> DataFrame:
    """(k1, k2) of every chunk."""

    def run(batches):
        for batch in batches:
            for _, texts in _parts(batch):
                keys = np.array([_key(body) for t in texts for _, _, body in candidates(t)], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, "k1 long, k2 long")


def suspects(docs: DataFrame, wanted) -> DataFrame:
    """k1, k2, body and places (doc_id, row, start, and the codes of the lines above, inside and below) of chunks that
    the filter holds; copies in one part of a task share a row."""
    schema = f"k1 long, k2 long, body string, places array<struct<doc_id:{_id_type(docs)},row:bigint,start:bigint,up:array<bigint>,own:array<bigint>,down:array<bigint>>>"

    def run(batches):
        for batch in batches:
            fields = [("doc_id", batch.column(0).type), ("row", pa.int64()), ("start", pa.int64()), *[(x, pa.list_(pa.int64())) for x in ("up", "own", "down")]]
            for ids, texts in _parts(batch):
                found: dict[str, tuple] = {}
                for doc, text in zip(ids, texts):
                    each = list(candidates(text))
                    keys = [_key(body) for _, _, body in each]
                    hits = wanted.value.hit(np.array([k[0] for k in keys], np.int64))
                    if not hits.any():
                        continue
                    codes, row = list(map(line_code, text.split("\n"))), row_hash(text)
                    for (start, end, body), key, hit in zip(each, keys, hits):
                        if hit:
                            place = {"doc_id": doc, "row": row, "start": start, "up": codes[max(0, start - GROW) : start][::-1], "own": codes[start:end], "down": codes[end : end + GROW]}
                            found.setdefault(body, (key, []))[1].append(place)
                columns = [pa.array([k[i] for k, _ in found.values()], pa.int64()) for i in (0, 1)]
                columns += [pa.array(list(found), pa.string()), pa.array([p for _, p in found.values()], pa.list_(pa.struct(fields)))]
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "body", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _alike(a: Column, b: Column) -> Column:
    """How many of the first elements of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False))
    return F.when(differ == 0, n).otherwise(differ - 1).cast("int")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: doc_id, row (a hash of the text), line (from 0) and words."""
    keys = ["k1", "k2"]
    repeated = settle(chunk_keys(docs).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))
    found = settle(suspects(docs, filter_of(settle(repeated.select("k1")))).join(repeated, keys, "left_semi"))
    place = F.struct("p.doc_id", "p.row", "p.start")
    first = found.select(*keys, "body", F.explode("places").alias("p")).groupBy(*keys).agg(F.min(F.struct(place.alias("place"), F.col("p.up").alias("up"), F.col("p.down").alias("down"), "body")).alias("first"))
    later = found.join(first, keys).where(F.col("body") == F.col("first.body")).select("first.place", "first.up", "first.down", F.explode("places").alias("p"))
    later = later.where(~place.eqNullSafe(F.col("place")))
    up, down = _alike(F.col("p.up"), F.col("up")), _alike(F.col("p.down"), F.col("down"))
    later = later.select("p", up.alias("n_up"), down.alias("n_down"))
    codes = F.concat(F.reverse(F.slice("p.up", F.lit(1), F.col("n_up"))), F.col("p.own"), F.slice("p.down", F.lit(1), F.col("n_down")))
    lines = later.select("p.doc_id", "p.row", (F.col("p.start") - F.col("n_up")).alias("from"), F.posexplode(codes).alias("at", "code"))
    lines = lines.select("doc_id", "row", (F.col("from") + F.col("at")).alias("line"), words_in(F.col("code")).alias("words")).distinct()
    doc = Window.partitionBy("doc_id", "row").orderBy("line")  # lines of one document
    starts = (F.coalesce(F.lag("line").over(doc), F.lit(-2)) + 1 != F.col("line")).cast("int")
    return lines.withColumn("starts", starts).withColumn("run", F.sum("starts").over(doc)).select("doc_id", "row", "line", "words", "run")


def _by_document(gone: DataFrame) -> DataFrame:
    """doc_id, row, lines, words and spans (from, to) of what each document loses."""
    spans = gone.groupBy("doc_id", "row", "run").agg(F.min("line").alias("from"), F.max("line").alias("to"), F.count("*").alias("lines"), F.sum("words").alias("words"))
    return spans.groupBy("doc_id", "row").agg(F.sum("lines").alias("lines"), F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_removed_words and removed_lines (like '3-5,9-10', from 0; null: none).

    Null text counts as empty. Rows with equal id and text count as one document and lose the same lines; null ids
    come first in the order of places, and of ties in it there are none but such rows. Texts of any length are cut
    line by line; an empty table gives an empty result; other columns are ignored.
    """
    by_doc = _by_document(repeated_lines(docs)).toDF("same_id", "same_row", "lines", "words", "spans")

    def told(x: Column) -> Column:
        return F.when(x["from"] == x["to"], x["from"].cast("string")).otherwise(F.concat_ws("-", x["from"].cast("string"), x["to"].cast("string")))

    rows = docs_rows(docs)
    both = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("row") == F.col("same_row")), "left")
    return both.select(
        "doc_id",
        "n_lines",
        F.coalesce("lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce("words", F.lit(0)).cast("long").alias("n_removed_words"),
        F.array_join(F.transform("spans", told), ",").alias("removed_lines"),
    )


def docs_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row and n_lines of each document."""

    def run(batches):
        for batch in batches:
            for ids, texts in _parts(batch):
                columns = [pa.array(ids, batch.column(0).type), pa.array(list(map(row_hash, texts)), pa.int64()), pa.array([t.count("\n") + 1 for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_lines"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_id_type(docs)}, row long, n_lines long")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of their texts, all columns kept; null and repeated rows, ties and
    empty tables as in ``line_dedup``. Rows that lose nothing are told by a bit filter and stay in their tasks;
    the rest, and the filter's few false ones, are joined with their spans."""
    same, row, gone, of = fresh(docs.columns, "same_id", "row", "gone", "of")
    by_doc = settle(_by_document(repeated_lines(docs)).select(F.col("doc_id").alias(same), F.col("row").alias(row), F.col("spans").alias(gone)))
    held = filter_of(settle(by_doc.select(F.xxhash64(same, row).alias("key"))))

    @F.pandas_udf("long")
    def hashed(texts):
        return texts.map(row_hash)

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for text, found in zip(texts, spans):
            lines = text.split("\n")
            for span in reversed(list(found)):
                del lines[span["from"] : span["to"] + 1]
            out.append("\n".join(lines))
        return type(texts)(out, dtype=object)

    marked = docs.withColumn(of, hashed(F.coalesce("text", F.lit(""))))
    maybe = may_hold(held, F.xxhash64("doc_id", of))
    some = marked.where(maybe).join(by_doc, F.col("doc_id").eqNullSafe(F.col(same)) & (F.col(of) == F.col(row)), "left")
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(cut(F.coalesce("text", F.lit("")), F.coalesce(F.col(gone), none)))
    return marked.where(~maybe).select(*docs.columns).unionByName(some.withColumn("text", text).select(*docs.columns))
