"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

A row's global number is its rank under (bucket, doc_id, size, crc), where the bucket hashes the other
three, so the number depends on the content alone and not on files, partitions or retries. The number
goes through a Feistel network over Z_a x Z_b with a*b just above the row count; numbers that land
beyond the count walk on along their cycle until they land inside. The permuted number p gives
``shard = p mod n`` and ``slot = p div n``, so shard sizes differ by one row at most and anybody who
knows a row's number, the row count and the seed can compute its place (``place``).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import settle, text_or_empty

PRIME = 2_147_483_647
ROUNDS = 6
BUCKETS = 4096
BLOCK = 65_536
MOST_STEPS = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    keys, x = [], (seed * 48_271 + 11) % PRIME
    for _ in range(ROUNDS):
        a = x = (x * 48_271 + 12_820_163) % PRIME
        b = x = (x * 48_271 + 12_820_163) % PRIME
        keys.append((a | 1, b))
    return keys


def sides(n_rows: int) -> tuple[int, int]:
    """The two moduli: their product is at least ``n_rows`` and exceeds it by less than the first."""
    a = max(1, isqrt(max(n_rows - 1, 0)) + 1)
    return a, max(1, -(-n_rows // a))


def steps(n_rows: int) -> int:
    """Walks never take more steps than there are numbers outside, plus one; beyond MOST_STEPS outside
    numbers, the chance of a walk that long is under n ** (1 - MOST_STEPS / 2), and a row that still
    stood outside would raise an error rather than get a wrong place."""
    a, b = sides(n_rows)
    return min(a * b - n_rows, MOST_STEPS)


def permute(x: int, n_rows: int, seed: int) -> int:
    """The permuted number of ``x``, as the DataFrame expression computes it."""
    a, b = sides(n_rows)
    while True:
        left, right = x // b, x % b
        for i, (k, c) in enumerate(round_keys(seed)):
            v = right % PRIME
            g = (v * k + c) % PRIME
            left, right = right, (left + (g * g % PRIME * k + v) % PRIME) % (a if i % 2 == 0 else b)
        x = left * b + right
        if x < n_rows:
            return x


def place(row_number: int, n_rows: int, n_shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a global row number."""
    p = permute(row_number, n_rows, seed)
    return p % n_shards, p // n_shards


def permuted_once(x: Column, n_rows: int, seed: int) -> Column:
    """One pass through the network, as a fold over its round keys."""
    a, b = sides(n_rows)
    keys = F.array(
        *[
            F.struct(F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("c"), F.lit(a if i % 2 == 0 else b).cast("long").alias("m"))
            for i, (k, c) in enumerate(round_keys(seed))
        ]
    )
    prime, width = F.lit(PRIME).cast("long"), F.lit(b).cast("long")

    def one_round(acc: Column, key: Column) -> Column:
        v = acc["right"] % prime
        g = (v * key["k"] + key["c"]) % prime
        f = (g * g % prime * key["k"] + v) % prime
        return F.struct(acc["right"].alias("left"), ((acc["left"] + f) % key["m"]).alias("right"))

    start = F.struct(F.call_function("div", x, width).alias("left"), (x % width).alias("right"))
    return F.aggregate(keys, start, one_round, lambda acc: acc["left"] * width + acc["right"])


def permuted(df: DataFrame, number: str, out: str, n_rows: int, seed: int) -> DataFrame:
    """Adds ``out``: the permuted value of ``number``, a long from 0 to ``n_rows`` - 1."""
    n = F.lit(n_rows).cast("long")
    df = df.withColumn(out, permuted_once(F.col(number), n_rows, seed))
    if walk := steps(n_rows):
        walked = F.aggregate(
            F.sequence(F.lit(1), F.lit(walk)),
            F.col(out),
            lambda x, _: F.when(x < n, x).otherwise(permuted_once(x, n_rows, seed)),
        )
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(walked))
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long")))
    return df


def numbered(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows with a dense global ``row_number`` from 0, and their count.

    Equal rows are counted before the shuffle and dealt out again afterwards in blocks, so that a row
    which makes up much of the table costs one record. Only one count for each of BUCKETS buckets goes
    through a single task and a broadcast.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    groups = settle(rows.groupBy(*keys).agg(F.count("*").alias("copies")).withColumn("bucket", bucket))
    by_bucket = groups.groupBy("bucket").agg(F.sum("copies").alias("held"))
    offsets = settle(by_bucket.select("bucket", "held", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("offset")))
    n_rows = offsets.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    upto = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = groups.withColumn("first", F.sum("copies").over(upto) - F.col("copies"))
    ranked = ranked.join(F.broadcast(offsets.select("bucket", "offset")), "bucket")
    ranked = ranked.withColumn("first", F.col("first") + F.col("offset"))
    # rows with many copies are dealt out in blocks by as many tasks; the others where they are
    starts = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long"))
    many = ranked.where(F.col("copies") > BLOCK).select(*keys, "first", "copies", F.explode(starts).alias("from")).repartition("first", "from")
    blocks = ranked.where(F.col("copies") <= BLOCK).select(*keys, "first", "copies", F.lit(0).cast("long").alias("from")).unionByName(many)
    to = F.least(F.col("from") + BLOCK, F.col("copies")) - 1
    each = blocks.select(*keys, "first", F.explode(F.sequence(F.col("from"), to)).alias("nth"))
    return each.select(*keys, (F.col("first") + F.col("nth")).alias("row_number")), n_rows


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = 20_240_601) -> DataFrame:
    """Puts every row into shards whose row counts differ by one at most, in a reproducible random order.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('rows'), shard, slot (gapless
    from 0 in each shard), grown_shard (null: under the law of rows a further shard moves rows between
    old ones) and row_number, from which ``place`` computes shard and slot again.

    Null text counts as empty; a null doc_id is a key like any other; repeated rows each get a slot of
    their own; an empty table gives an empty result; columns besides doc_id and text are ignored. Equal
    texts under different ids are not kept together, since no law of equal row counts could do so.
    """
    text = text_or_empty("text").cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows, n_rows = numbered(rows, ["doc_id", "size", "text_crc32"])
    rows = permuted(rows, "row_number", "permuted", n_rows, seed)
    n = F.lit(n_shards).cast("long")
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("permuted") % n).cast("int").alias("shard"),
        F.call_function("div", F.col("permuted"), n).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
