"""Near copies by overlap of word shingles: every pair of texts whose sets of 5-word shingles overlap by 0.8
or more (Jaccard) ends in one group.

SimHash comes first: the fingerprints of 5-word shingles go through the operator's anchors, and each text is
compared, set against set, with one text of its component. That settles groups of close copies, however
large, at one comparison a text. Fingerprints alone can't find all pairs at 0.8 (about 10 of 64 bits differ
there), so an exact prefix filter looks for what is left. In one order of all shingles, two sets that overlap
by ``least`` share a shingle among the first n - ceil(least * n) + 1 of each, so only these are put in
buckets. Shingles seen often come last in the order, which keeps common passages out of the prefixes; the
order changes the cost, never the result.

In a bucket, members outside its largest group come first, those that share most before others. The first is
compared with all members of other groups and leaves, then the next 16, the next 256 and so on (GROWTH), until
one group is left. So a large group of close copies costs about one comparison a text, and no pair is given
up because it was linked to a text unlike it. Places of the shared shingle, sizes and small bitmaps bound the
overlap from above and rule out nearly all pairs that are no copies; only the rest has its sets compared. Pairs found in one bucket are compared in one place, so
a text's set goes once to each bucket that names it, not once to each of its pairs.

Shingles are hashed anew from the texts where they are needed, so neither texts nor all sets are shuffled or
kept: light records are, and the sets of texts that are compared. Texts equal after lower-casing A-Z are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm import exact_dedup, simhash
from trailweave.llm.bits import filter_of
from trailweave.llm.common import GATHERED, HEAVY, counted, free_memory, gathered, shuffles_go, size_of
from trailweave.llm.components import components, joining
from trailweave.llm.shingles import bitmap, lists, parts, shingle_ids, text_ids

WIDTH = 5
LEAST = 0.8
#: A shingle in more prefixes than this goes behind the rarer ones.
OFTEN = 8
#: Each round compares so many times more members of a bucket with the rest than the one before.
GROWTH = 16
#: A bucket's first members are chosen in so many parts, then among the parts' first.
PARTS = 32
#: From this number of first members on, a round compares bitmaps in map tasks; more than MOST_FIRSTS are left
#: to later rounds. Large buckets are dealt out in parts of about BUCKET_PART members.
DENSE, MOST_FIRSTS, BUCKET_PART = 256, 4096, 20_000
#: Sets that are compared in one place hold about so many shingles on each side, or are one set.
CELL = 2_000_000
#: Pairs that a task holds before it passes them on.
PAIRS_HELD = 500_000


def _scan(docs: DataFrame, schema: str, row) -> DataFrame:
    """Rows that ``row(t, shingles)`` gives for each text, as a list of column arrays."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        free_memory()
        for batch in batches:
            for _, texts in parts(batch.column(0)):
                yield pa.RecordBatch.from_arrays(row(text_ids(texts), shingle_ids(texts, WIDTH)), names)
        pa.default_memory_pool().release_unused()

    return docs.select("text").mapInArrow(run, schema)


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), n (its shingles), fp (the fingerprint of its shingles) and bm (its bitmap)."""

    def run(batches):
        free_memory()
        for batch in batches:
            for at, texts in parts(batch.column(1)):
                sets = shingle_ids(texts, WIDTH)
                fps = [simhash.fingerprint(t, WIDTH) for t in texts.to_pylist()]
                columns = [pa.array(x, pa.int64()) for x in (text_ids(texts), list(map(len, sets)), fps)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns, lists(list(map(bitmap, sets)))], ["doc_id", "t", "n", "fp", "bm"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, n long, fp long, bm array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def prefix(n: np.ndarray, least: float) -> np.ndarray:
    return np.maximum(n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0) * (n > 0)


def postings(docs: DataFrame, least: float, most: int | None = None) -> tuple[DataFrame, int]:
    """Buckets of at least two texts: tok, t, n (shingles of t), pos (of tok in t's order) and shared (how
    large t's buckets are in all); and how many rows there are. ``most``: the size of all prefixes, if it is known."""
    narrow = 4 * GATHERED

    def plain(ts, sets):
        return [pa.array(np.concatenate([np.zeros(0, np.int64), *[s[: prefix(np.array(len(s)), least)] for s in sets]]))]

    seen = _scan(docs, "tok long", plain).groupBy("tok").agg(F.count("*").alias("n"))
    seen = gathered(seen.where("n > 1"), most, narrow)  # of the shingles' number, few
    often = filter_of(gathered(seen.where(F.col("n") > OFTEN).select("tok")))

    def ordered(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix with frequent shingles last, and which of it the plain order has not."""
        size = int(prefix(np.array(len(s)), least))
        late = often.value.hit(s)
        first = np.flatnonzero(~late)[:size]
        at = np.concatenate([first, np.flatnonzero(late)[: size - len(first)]])
        return s[at], at >= size

    def moved(ts, sets):
        parts = [x[new] for x, new in map(ordered, sets)]
        return [pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))]

    more = _scan(docs, "tok long", moved).distinct()
    wanted = filter_of(gathered(seen.select("tok").unionByName(more), most, narrow))

    def posted(ts, sets):
        parts = [(x, wanted.value.hit(x)) for x, _ in map(ordered, sets)]
        each = np.array([int(hit.sum()) for _, hit in parts], np.int64)
        none = np.zeros(0, np.int64)
        columns = [
            np.concatenate([none, *[x[hit] for x, hit in parts]]),
            np.repeat(np.array(ts, np.int64), each),
            np.repeat(np.array([len(s) for s in sets], np.int64), each),
            np.concatenate([none, *[np.flatnonzero(hit) for _, hit in parts]]),
        ]
        return [pa.array(c, pa.int64()) for c in columns]

    rows, n = counted(_scan(docs, "tok long, t long, n long, pos long", posted).distinct(), most, narrow)
    size = rows.groupBy("tok").agg(F.count("*").alias("size")).where("size > 1")
    rows, n = counted(rows.join(size, "tok"), n)
    shared = rows.groupBy("t").agg(F.sum("size").alias("shared"))
    return counted(rows.drop("size").join(shared, "t"), n)


def first_members(rows: DataFrame, width: int) -> DataFrame:
    """Of each bucket the ``width`` members to compare with the rest: those of its largest group last."""
    order = [F.col("label") == F.col("major"), F.desc("shared"), F.col("t")]
    part = F.pmod(F.xxhash64("t"), F.lit(PARTS))
    for keys in (["tok", part], ["tok"]):
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("turn") <= width)
    return rows.drop("turn")


def similar_groups(docs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs``: texts, each once. ``texts``: their t, n, fp, bm. (node, label) of the components of all pairs
    that overlap by ``least`` or more; what is in no pair may be absent."""
    with shuffles_go(docs.sparkSession):
        n_texts, shingles = texts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tried, n_tried = counted(by_fingerprints(texts, n_texts), n_texts)
    links, n_links = counted(overlapping(docs, tried.withColumn("tok", F.col("a")), least), n_tried, HEAVY)
    labels = components(links, n_links)
    (rows, n), width = postings(docs, least, int((1 - least) * shingles) + 2 * n_texts), 1
    toks = F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("toks")
    ordered = gathered(rows.groupBy("t").agg(toks), n_texts, HEAVY)  # each text's buckets in the order of all shingles
    while True:
        rows = rows.join(labels.withColumnRenamed("node", "t"), "t", "left").withColumn("label", F.coalesce("label", "t"))
        sizes = rows.groupBy("tok", "label").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy("tok").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels"))
        rows, n = counted(rows.join(sizes.where("labels > 1").drop("labels"), "tok"), n)
        if not n:
            return labels
        firsts = gathered(first_members(rows, width), n)
        pairs = dense_pairs(rows, firsts, texts.join(ordered, "t"), least) if width >= DENSE else sparse_pairs(rows, firsts, texts, least)
        pairs, n_pairs = counted(pairs.join(tried, ["a", "b"], "left_anti"), n)
        found, n_found = counted(overlapping(docs, pairs, least), n_pairs, HEAVY)
        tried, n_tried = counted(tried.unionByName(pairs.select("a", "b")), n_tried + n_pairs)
        if n_found:
            known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
            links, n_links = counted(known.unionByName(joining(found)), size_of(labels) + n_found)
            labels = components(links, n_links)
        rows = rows.drop("label", "major").join(firsts.select("tok", "t"), ["tok", "t"], "left_anti")
        width = min(width * GROWTH, MOST_FIRSTS)


def sparse_pairs(rows: DataFrame, firsts: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs of first members with members of other groups that places, sizes and bitmaps do not rule out: a, b
    and tok, the least bucket that names them."""
    one = firsts.select("tok", *[F.col(c).alias(f"{c}_a") for c in ("t", "n", "pos", "label")])
    most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n") - F.col("pos"))
    fits = (F.col("label") != F.col("label_a")) & (most >= (F.col("n_a") + F.col("n")) * (least / (1 + least)) - 1e-9)
    pairs = one.join(rows, "tok").where(fits)
    pairs = pairs.groupBy(F.least("t_a", "t").alias("a"), F.greatest("t_a", "t").alias("b")).agg(F.min("tok").alias("tok"))
    return possible(pairs, texts, least)


def dense_pairs(rows: DataFrame, firsts: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """What ``sparse_pairs`` gives, for buckets with many members: they stream past the bucket's first members
    (MOST_FIRSTS at most are held), and only pairs that pass leave the task. A pair is named in the first bucket that it
    shares alone (``toks``: a text's buckets in the order of all shingles); a later round gets there if this one does not."""
    size = rows.groupBy("tok").agg(F.ceil(F.count("*") / BUCKET_PART).cast("int").alias("parts"))
    columns = ["tok", "t", "n", "pos", "label"]
    every = rows.select(*columns).join(size, "tok").withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    held = firsts.select(*columns).join(size, "tok").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = held.withColumn("later", F.lit(0)).unionByName(every.withColumn("later", F.lit(1))).drop("parts").join(texts.select("t", "bm", "toks"), "t")
    both = both.select(*columns, "part", "later", "bm", "toks").repartition("tok", "part").sortWithinPartitions("tok", "part", "later")

    def run(batches):
        free_memory()
        at, held = None, {}
        for batch in batches:
            tok, t, n, pos, label, part, later = (batch.column(i).to_numpy() for i in range(7))
            ends = batch.column(7).offsets.to_numpy()
            bits = batch.column(7).values.to_numpy()[: ends[-1]].view(np.uint64)
            longs, toks = np.diff(ends), lists_of(batch.column(8))
            starts = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (part[1:] != part[:-1]) | (later[1:] != later[:-1]) | (longs[1:] != longs[:-1])])
            found, waiting = [], 0
            for s, e in zip(starts, np.r_[starts[1:], len(tok)]):
                if (tok[s], part[s]) != at:
                    at, held = (tok[s], part[s]), {}
                block = (t[s:e], n[s:e], pos[s:e], label[s:e], bits[ends[s] : ends[e]].reshape(e - s, -1), toks[s:e])
                if not later[s]:
                    held.setdefault(int(longs[s]), []).append((*(x.copy() for x in block[:5]), [x.copy() for x in block[5]]))
                    continue
                for mine in [x for width, many in held.items() if width <= 2 * longs[s] and longs[s] <= 2 * width for x in many]:
                    for near in near_in_turn(mine, block, least, tok[s]):
                        found.append(np.c_[near, np.full(len(near), tok[s])])
                        waiting += len(near)
                        if waiting >= PAIRS_HELD:
                            yield once(found)
                            found, waiting = [], 0
            yield once(found)

    def once(found):
        """Each pair with its least tok."""
        pairs = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
        pairs = pairs[np.r_[True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)][: len(pairs)]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], ["a", "b", "tok"])

    return both.mapInArrow(run, "a long, b long, tok long").groupBy("a", "b").agg(F.min("tok").alias("tok"))


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    ends, data = column.offsets.to_numpy(), column.values.to_numpy()
    return [data[s:e] for s, e in zip(ends[:-1], ends[1:])]


def near_in_turn(ones: tuple, others: tuple, least: float, tok: int | None = None):
    """Pairs of two blocks of a bucket (t, n, pos, label, bitmaps of one size) that may overlap by ``least``, as arrays
    of little more than PAIRS_HELD. With ``tok``, the bucket, and each text's buckets in order as a sixth part of the
    blocks: those that share none before it."""
    t1, n1, pos1, label1, bits1 = ones[:5]
    t2, n2, pos2, label2, bits2 = others[:5]
    width = min(bits1.shape[1], bits2.shape[1])
    bits1, bits2 = (b if b.shape[1] == width else b[:, :width] | b[:, width:] for b in (bits1, bits2))
    out, size = [np.zeros((0, 2), np.int64)], 0
    for i in range(len(t1)):
        every = n1[i] + n2
        fits = (label2 != label1[i]) & (np.minimum(n1[i] - pos1[i], n2 - pos2) * (1 + least) >= least * every - 1e-6)
        at = np.flatnonzero(fits)
        if len(at):
            differ = np.bitwise_count(bits2[at] ^ bits1[i]).sum(1, dtype=np.int64)
            at = at[(every[at] - differ) * (1 + least) >= 2 * least * every[at] - 1e-6]
            if tok is not None and len(at):
                mine, sizes = ones[5][i], [len(others[5][k]) for k in at]
                before = np.isin(np.concatenate([others[5][k] for k in at]), mine[: np.flatnonzero(mine == tok)[0]])
                at = at[np.add.reduceat(before, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64) == 0]
            out.append(np.stack([np.minimum(t1[i], t2[at]), np.maximum(t1[i], t2[at])], 1))
            size += len(at)
        if size >= PAIRS_HELD:
            yield np.concatenate(out)
            out, size = [np.zeros((0, 2), np.int64)], 0
    yield np.concatenate(out)


def near_in_blocks(ones: tuple, others: tuple, least: float) -> np.ndarray:
    """What ``near_in_turn`` gives, as one array."""
    return np.concatenate(list(near_in_turn(ones, others, least)))


def by_fingerprints(texts: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of each text and the least one of its component of fingerprints at most 2 bits apart."""
    points = gathered(texts.where("n > 0").groupBy("fp").agg(F.min("t").alias("least")), most)
    rep = simhash.point_groups(points).withColumnRenamed("component", "a")
    return texts.where("n > 0").select("fp", F.col("t").alias("b")).join(rep, "fp").where("a <> b").select("a", "b")


def _fold(bits: Column, to: Column) -> Column:
    """A bitmap of twice the size brought to ``to`` longs."""
    half = F.zip_with(F.slice(bits, F.lit(1), to), F.slice(bits, to + 1, to), lambda x, y: x.bitwiseOR(y))
    return F.when(F.size(bits) > to, half).otherwise(bits)


def possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose bitmaps do not rule out the overlap: a bit that differs needs a shingle that differs."""
    columns = pairs.columns
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("t").alias(side), F.col("n").alias(f"n_{side}"), F.col("bm").alias(f"bm_{side}")), side)
    to = F.least(F.size("bm_a"), F.size("bm_b"))
    apart = F.zip_with(_fold(F.col("bm_a"), to), _fold(F.col("bm_b"), to), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(apart, F.lit(0), lambda s, x: s + x)
    every = F.col("n_a") + F.col("n_b")
    near = F.greatest(F.size("bm_a"), F.size("bm_b")) <= 2 * to
    return pairs.where(near & ((every - differ) * (1 + least) >= 2 * least * every - 1e-6)).select(columns)


def overlapping(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (settled a, b and tok, each pair once) whose sets of shingles overlap by ``least``, sets compared
    in full. Only the sets of texts in pairs leave their map tasks.

    Pairs of one tok are compared together, in as many cells, by hashes of a and b, as bound the sets that a cell
    holds. A set goes to the cells that name it, so in a group with many pairs it moves far less often than it is
    compared.
    """
    ends, n = counted(pairs.select("tok", F.explode(F.array("a", "b")).alias("t")).distinct(), 2 * size_of(pairs))
    if not n:
        return pairs.select("a", "b")
    texts, n = counted(ends.select("t").distinct(), n)
    wanted = filter_of(texts)

    def row(ts, sets):
        ts = np.array(ts, np.int64)
        hit = wanted.value.hit(ts)
        return [pa.array(ts[hit]), lists([s for s, h in zip(sets, hit) if h])]

    sets = gathered(_scan(docs, "t long, sh array<long>", row).join(texts, "t", "left_semi"), n, HEAVY)
    size = ends.join(sets.select("t", F.size("sh").alias("n")), "t").groupBy("tok").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("cells"))
    i, j = (F.pmod(F.xxhash64(side), F.col("cells")).cast("int").alias(name) for side, name in (("a", "i"), ("b", "j")))
    asked = pairs.join(size, "tok").select("tok", i, j, "a", "b")
    held = asked.select("tok", "i", "j", F.explode(F.array("a", "b")).alias("b")).distinct().join(sets.withColumnRenamed("t", "b"), "b")
    both = held.withColumn("a", F.lit(None).cast("long")).unionByName(asked.withColumn("sh", F.lit(None).cast("array<long>")))
    both = both.select("tok", "i", "j", "a", "b", "sh").repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j", "a")  # sets, without a, come first

    def run(batches):
        free_memory()
        at, known = None, {}
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            a, b, sh = batch.column(3), batch.column(4).to_numpy(), batch.column(5)
            is_set, a = a.is_null().to_numpy(zero_copy_only=False), a.fill_null(0).to_numpy()
            ends, data = sh.offsets.to_numpy(), sh.values.to_numpy()
            found = []
            for k, key in enumerate(map(tuple, keys.tolist())):
                if key != at:
                    at, known = key, {}
                if is_set[k]:
                    known[b[k]] = data[ends[k] : ends[k + 1]].copy()
                elif overlap(known[a[k]], known[b[k]], least):
                    found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def overlap(one: np.ndarray, other: np.ndarray, least: float) -> bool:
    """Whether two sorted sets overlap by ``least``."""
    if len(one) > len(other):
        one, other = other, one
    if not len(one) or len(one) < least * len(other):
        return False
    shared = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
    return shared >= least * (len(one) + len(other) - shared)


def similar_dedup(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and component_id, the least doc_id of those joined by equal texts and similar links.

    Null text counts as empty; texts without words form one group with each other only if equal. Texts of any
    length are hashed whole. Null and repeated ids pass through; ties do not arise, since groups do not depend
    on the order of pairs; an empty table gives an empty result; other columns are ignored.
    """
    marked, n = counted(marks(docs), each=HEAVY)
    texts = marked.groupBy("t").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "bm")], F.count("*").alias("copies"))
    texts = gathered(texts, n, HEAVY)
    single = docs if texts.where("copies > 1").isEmpty() else exact_dedup.kept_rows(docs)
    labels = similar_groups(single, texts.select("t", "n", "fp", "bm"), least)
    grouped = texts.select("t", "least").join(labels.withColumnRenamed("node", "t"), "t", "left")
    grouped = gathered(grouped.select("t", F.coalesce("label", "t").alias("label"), "least"), n)
    ids = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = grouped.join(ids, "label").select("t", "component_id")
    return marked.select("doc_id", "t").join(ids, "t").select("doc_id", "component_id")


def kept_rows(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each group of ``similar_dedup``, with all its columns. Rows that repeat a kept id with the
    same text count as one; with other texts they stay. An empty table gives an empty result."""
    return simhash.one_of_each(docs, similar_dedup(docs, least))
