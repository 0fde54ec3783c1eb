"""From buckets to groups: all links among members of a bucket are found, without listing a bucket's pairs.

Whatever puts texts in buckets (keys that any similar pair shares), the rest is the same. Each bucket's members
are first compared with its least one, whole set against whole set; that settles groups of close copies at one
comparison a text, and all buckets of two. Buckets that hold more than one group then are compared within a
task: sizes and bitmaps bound each overlap from above, and each member names its nearest few of other groups,
which are checked on whole sets. Where more than a few pass, the bucket comes again, with more of them, until
none is left out. A pair that meets in several buckets is named in the first of them alone. Large buckets are cut
in blocks, and a pair of blocks is a task's work; members of the largest group aren't compared with each other.

Sets are read from the texts once, for members of buckets alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bits import filter_of
from trailweave.llm.common import free_memory, settle
from trailweave.llm.components import components
from trailweave.llm.shingles import bitmap, lists, parts

#: How many of the nearest each member names in the first round, and how many times more in each later one: in the
#: second, all of a block.
NEAREST, GROWTH = 4, 1024
#: Members of a block.
BLOCK = 2048


def buckets(posted: Callable, percent: int) -> tuple[DataFrame, DataFrame]:
    """``posted(wanted)``: (tok, t), all rows or those whose tok may be in a broadcast filter. Pairs (a, b) of the
    least and each other member, and (tok, t) of buckets with more than two."""
    found = posted(None).groupBy("tok").agg(F.count("*").alias("size"), F.min("t").alias("a"), F.max("t").alias("b")).where("size > 1 and a <> b")
    found = settle(found)
    large = found.where("size > 2").select("tok", "a")
    rows = settle(posted(filter_of(large.select("tok"))).join(large, "tok"))
    pairs = found.where("size = 2").select("a", "b").union(rows.where("a <> t").select("a", F.col("t").alias("b"))).distinct()
    return pairs, rows.select("tok", "t")


def sets_of(docs: DataFrame, wanted: DataFrame, identify: Callable) -> DataFrame:
    """t, n, bm (bitmap) and sh (the set) of the texts in ``wanted`` (settled t). ``identify(texts)`` gives ids and
    sorted sets. A text is taken once in each task and once of all tasks."""
    hits = filter_of(wanted)

    def run(batches):
        free_memory()
        had = set()
        for batch in batches:
            for _, texts in parts(batch.column(0)):
                ids, sets = identify(texts)
                hit = hits.value.hit(np.array(ids, np.int64))
                new = []
                for i in np.flatnonzero(hit):
                    if ids[i] not in had:
                        had.add(ids[i])
                        new.append(i)
                some = [sets[i] for i in new]
                columns = [pa.array([ids[i] for i in new], pa.int64()), pa.array(list(map(len, some)), pa.int64()), lists(list(map(bitmap, some))), lists(some)]
                yield pa.RecordBatch.from_arrays(columns, ["t", "n", "bm", "sh"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "t long, n long, bm array<long>, sh array<long>")
    return settle(rows.join(wanted, "t", "left_semi").groupBy("t").agg(*[F.first(c).alias(c) for c in ("n", "bm", "sh")]))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps do not rule out the overlap: a bit that differs needs an element that
    differs."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("t").alias(side), F.col("n").alias(f"n_{side}"), F.col("bm").alias(f"bm_{side}")), side)
    to, every = F.least(F.size("bm_a"), F.size("bm_b")), F.col("n_a") + F.col("n_b")

    def folded(bits: Column) -> Column:
        half = F.zip_with(F.slice(bits, F.lit(1), to), F.slice(bits, to + 1, to), lambda x, y: x.bitwiseOR(y))
        return F.when(F.size(bits) > to, half).otherwise(bits)

    apart = F.zip_with(folded(F.col("bm_a")), folded(F.col("bm_b")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(apart, F.lit(0), lambda s, x: s + x)
    sized = (F.greatest(F.size("bm_a"), F.size("bm_b")) <= 2 * to) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return pairs.where(sized & (100 * (every - differ) >= percent * (every + differ))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their sets."""
    both = pairs
    for side in "ab":
        both = both.join(sets.select(F.col("t").alias(side), F.col("n").alias(f"n_{side}"), F.col("sh").alias(f"sh_{side}")), side)
        if side == "a":  # a set goes no further than its size allows
            both = both.join(sets.select(F.col("t").alias("b"), F.col("n").alias("m")), "b").where(f"100 * least(n_a, m) >= {percent} * greatest(n_a, m)").drop("m")
    shared = F.size(F.array_intersect("sh_a", "sh_b"))
    return both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def compared(rows: DataFrame, sets: DataFrame, percent: int, nearest: int, keys_of: Callable) -> DataFrame:
    """``rows``: tok, t, label, major (the bucket's largest label), n_major and n_minor. (a, b) of other labels whose
    bitmaps do not rule them out, the nearest of each member outside the largest label; and (tok) where there were
    more. ``sets``: t, n, bm and sig; ``keys_of(sigs)`` gives a function (i, ids) that tells the key of the first bucket
    in which member i meets each of the others, in an order of buckets that is the same for all."""
    blocks = {k: F.ceil(F.col(f"n_{k}") / BLOCK).cast("int") for k in ("minor", "major")}
    small = F.col("n_major") + F.col("n_minor") <= BLOCK
    main = F.col("label") == F.col("major")
    spread = F.xxhash64("t")
    part = F.when(small, 0).when(main, blocks["minor"] + F.pmod(spread, blocks["major"])).otherwise(F.pmod(spread, blocks["minor"])).cast("int")
    others = F.when(small, F.array(F.lit(0))).when(main, F.sequence(F.lit(0), blocks["minor"] - 1)).otherwise(F.sequence(F.lit(0), blocks["minor"] + blocks["major"] - 1))
    every = rows.select("tok", "t", "label", part.alias("part"), main.alias("main"), F.explode(others).alias("other"))
    every = every.select("tok", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "t", "label", "main")
    every = every.join(sets.select("t", "n", "bm", "sig"), "t").select("tok", "i", "j", "part", "t", "label", "main", "n", "bm", "sig")
    every = every.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j", "part")

    def run(batches):
        free_memory()
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for s, e in zip(starts, np.r_[starts[1:], len(keys)]):
                if key is not None and (keys[s] != key).any():
                    yield near_members(held, int(key[0]), percent, nearest, keys_of)
                    held = []
                key = keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield near_members(held, int(key[0]), percent, nearest, keys_of)

    return every.mapInArrow(run, "a long, b long, tok long")


def near_members(batches: list[pa.RecordBatch], tok: int, percent: int, nearest: int, keys_of: Callable) -> pa.RecordBatch:
    """Of one pair of blocks the pairs that ``compared`` gives."""
    table = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: table.column(name).chunk(0)
    part, t, label, n = (column(c).to_numpy() for c in ("part", "t", "label", "n"))
    main = column("main").to_numpy(zero_copy_only=False)
    meet, bits = keys_of(column("sig").to_pylist()), column("bm")
    ends = bits.offsets.to_numpy()
    data, width = bits.values.to_numpy().view(np.uint64), np.diff(ends)
    two = part[0] != part[-1]
    found, more = [np.zeros((0, 2), np.int64)], False
    by_width = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    maps = {w: np.stack([data[ends[k] : ends[k + 1]] for k in at]) for w, at in by_width.items()}
    for w, at in by_width.items():
        wider = by_width.get(2 * w, np.zeros(0, np.int64))
        pool = np.r_[at, wider]
        low = maps[w] if not len(wider) else np.r_[maps[w], maps[2 * w][:, :w] | maps[2 * w][:, w:]]
        narrow = by_width.get(w // 2, np.zeros(0, np.int64)) if w % 2 == 0 else np.zeros(0, np.int64)
        for k in np.flatnonzero(~main[at]):
            i = at[k]
            ids, apart = _possible(i, low[k], pool, low, t, label, n, part if two else None, percent)
            if len(narrow):
                folded = low[k][: w // 2] | low[k][w // 2 :]
                more_ids, more_apart = _possible(i, folded, narrow, maps[w // 2], t, label, n, part if two else None, percent)
                ids, apart = np.r_[ids, more_ids], np.r_[apart, more_apart]
            if len(ids):  # in the first bucket that they share
                here = meet(i, ids) == tok
                ids, apart = ids[here], apart[here]
            if len(ids) > nearest:
                more = True
                ids = ids[np.lexsort((t[ids], apart))[:nearest]]
            if len(ids):
                found.append(np.stack([np.minimum(t[i], t[ids]), np.maximum(t[i], t[ids])], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    a, b = ([*x.tolist(), *[None] * more] for x in pairs.T)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([tok] * len(a), pa.int64())], ["a", "b", "tok"])


def _possible(i, mine, pool, maps, t, label, n, part, percent):
    """Which of ``pool`` may overlap with member i: a bit that differs needs an element that differs."""
    fits = (label[pool] != label[i]) & (100 * np.minimum(n[pool], n[i]) >= percent * np.maximum(n[pool], n[i]))
    if part is not None:
        fits &= part[pool] != part[i]
    fits = np.flatnonzero(fits)
    apart = np.bitwise_count(maps[fits] ^ mine).sum(1, dtype=np.int64)
    every = n[pool[fits]] + n[i]
    passed = 100 * (every - apart) >= percent * (every + apart)
    return pool[fits[passed]], apart[passed]


def groups(pairs: DataFrame, rows: DataFrame, sets: DataFrame, signed: DataFrame, percent: int, keys_of: Callable) -> DataFrame:
    """(node, label): components of all pairs in a bucket that overlap by ``percent`` or more. ``pairs`` and ``rows`` as
    ``buckets`` gives them, settled; ``signed``: t and sig; what has no link may be absent."""
    tried = pairs
    links = settle(verified(settle(possible(pairs, sets, percent)), sets, percent))
    labels, nearest = components(links), NEAREST
    while True:
        named = rows.join(labels.withColumnRenamed("node", "t"), "t", "left").withColumn("label", F.coalesce("label", "t"))
        sizes = named.groupBy("tok", "label").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy("tok").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n_all"))
        sizes = sizes.where("n_all > n_major").select("tok", "major", "n_major", (F.col("n_all") - F.col("n_major")).alias("n_minor"))
        named = settle(named.join(sizes, "tok"))
        if named.isEmpty():
            return labels
        mixed = sets.select("t", "n", "bm").join(signed, "t")
        found = settle(compared(named, mixed, percent, nearest, keys_of))
        fresh = settle(found.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        new = settle(verified(fresh, sets, percent))
        tried = settle(tried.unionByName(fresh))
        if not new.isEmpty():
            links = settle(links.unionByName(new))
            labels = components(links)
        rows = settle(named.select("tok", "t").join(found.where("a is null").select("tok").distinct(), "tok", "left_semi"))
        nearest *= GROWTH
