"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then of the whole text.

Texts stay in their map tasks: counts of light keys are shuffled, then digests of rows whose length and
prefix repeat, and a group of copies, however large, shrinks to one record for each id in each map task. What
is broadcast are bit filters of bounded size; what they can't tell is sorted out by joins of light records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.bits import filter_of, may_hold
from trailweave.llm.common import HEAVY, counted, fold_ascii, fresh, gathered, in_few, settle, text_or_empty

PREFIX_CHARS = 64
def digest(text: Column) -> Column:
    """SHA-256 of the folded text, 32 bytes."""
    return F.unhex(F.sha2(fold_ascii(text).cast("binary"), 256))


def duplicate_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row for each text that several rows hold: digest, keep_id (the largest doc_id), group_size and
    keep_rows (rows of the group that carry keep_id: over 1 only if an id repeats)."""
    rows = docs.select(F.col("doc_id"), text_or_empty("text").alias("text"))
    light = [
        F.octet_length("text").alias("length"),
        F.xxhash64(fold_ascii(F.left("text", F.lit(prefix_chars)))).alias("prefix"),
    ]
    keys = rows.select(*light).groupBy("length", "prefix").agg(F.count("*").alias("n"))
    keys = keys.withColumn("of_length", F.sum("n").over(Window.partitionBy("length")))
    alive = settle(keys.where("of_length > 1 and n > 1").select("length", "prefix"))
    # texts that may survive are hashed in full where they are; the join behind sorts out the others
    key = F.xxhash64("length", "prefix")
    some = rows.select("doc_id", "text", *light).where(may_hold(filter_of(settle(alive.select(key.alias("key")))), key))
    some = some.select("doc_id", "length", "prefix", digest(F.col("text")).alias("digest"))
    by_id = some.groupBy("length", "prefix", "digest", "doc_id").agg(F.count("*").alias("n"))
    by_id = by_id.join(alive, ["length", "prefix"], "left_semi")
    groups = by_id.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.max(F.struct("doc_id", "n"))["n"].alias("keep_rows"),
    )
    return gathered(groups.where("group_size > 1"))


def exact_dedup(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """A verdict for each row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same bytes after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest doc_id stays (null ids come last); if several equal rows share that
    id, exactly one of them is kept. Columns besides doc_id and text are ignored. An empty table gives
    an empty result.
    """
    groups = duplicate_groups(docs, prefix_chars)
    rows = docs.select(F.col("doc_id"), digest(text_or_empty("text")).alias("digest"))
    rows = rows.join(groups, "digest", "left")
    lone = F.col("group_size").isNull()
    found = rows.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.coalesce("keep_rows", F.lit(1)).alias("keep_rows"),
    )
    if groups.where("keep_rows > 1").isEmpty():
        return found.drop("keep_rows")
    several = F.col("kept") & (F.col("keep_rows") > 1)
    turn = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    tied = found.where(several).withColumn("kept", turn == 1)
    return found.where(~several).unionByName(tied).drop("keep_rows")


def kept_rows(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest doc_id.
    Null text counts as empty; of equal rows one stays; an empty table gives an empty result.

    Rows whose text nobody shares, and rows that surely go, are told by bit filters in their map tasks. Only
    those that stay for their group, and the filters' few false ones, are joined with all their columns."""
    groups = duplicate_groups(docs, prefix_chars)
    mark = fresh(docs.columns, "digest", "keep_id", "group_size", "keep_rows")
    of, keep, size, rows_of = mark
    keys, n = counted(groups.select(F.xxhash64("digest").alias("key")))
    shared = filter_of(keys)
    stay = filter_of(settle(groups.select(F.xxhash64("digest", "keep_id").alias("key"))))
    rows = docs.withColumn(of, digest(text_or_empty("text")))
    copied = may_hold(shared, F.xxhash64(F.col(of)))
    some = rows.where(copied)
    lone = some.where(~may_hold(stay, F.xxhash64(F.col(of), F.col("doc_id"))))
    some = some.where(may_hold(stay, F.xxhash64(F.col(of), F.col("doc_id")))).join(groups.toDF(*mark), of, "left")
    some = in_few(some.where(F.col(size).isNull() | F.col("doc_id").eqNullSafe(F.col(keep))), n, HEAVY)
    # of those, copies go; the first filter's false ones are found by their digests, which are light
    false = rows.select(of).where(copied).distinct().join(groups.select(F.col("digest").alias(of)), of, "left_anti")
    false, n_false = counted(false.select(F.xxhash64(of).alias("key")), n)
    lone = lone.where(may_hold(filter_of(false), F.xxhash64(F.col(of))))
    lone = in_few(lone.join(groups.select(F.col("digest").alias(of)), of, "left_anti"), n_false, HEAVY)
    out = rows.where(~copied).select(*docs.columns).unionByName(lone.select(*docs.columns))
    if groups.where("keep_rows > 1").isEmpty():
        return out.unionByName(some.select(*docs.columns))
    several = F.coalesce(F.col(rows_of), F.lit(1)) > 1
    return out.unionByName(some.where(~several).select(*docs.columns)).unionByName(
        some.where(several).dropDuplicates([of, "doc_id"]).select(*docs.columns)
    )
