"""Near duplicates by SimHash and anchor-point covering.

Anchors are the words of the perfect Hamming code on bits 0 to 62 together with bit 63 as it is, so every
64-bit point has an anchor within the covering radius of 1. Two fingerprints at most 2 bits apart have a
point between them that is within 1 bit of both, hence an anchor within 1 + 1 = 2 bits of both: covering
radius plus half the threshold. Each distinct fingerprint goes to every anchor within 2 bits (33 of them,
or 2 for a code word) and is compared with the others there. No pair is missed and none is found wrongly.

At one anchor, fingerprints are the anchor with 0, 1 or 2 bits flipped, at most 2081 of them whatever the
corpus. They are chained along shared flips, which links what is linked by some chain and emits at most two
links for each fingerprint instead of all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.bits import filter_of, may_hold
from trailweave.llm.common import HEAVY, counted, fresh, gathered, in_few, settle, size_of
from trailweave.llm.components import components

SEED = 42
CODED = 63
AT_ONCE = 65_536


def fingerprint(text: str, width: int) -> int:
    """Majority of each bit over the hashes of all word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()  # A-Z only, at ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    n, ones, hashed = len(shingles), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, AT_ONCE):
        part = shingles[at : at + AT_ONCE]
        h = np.fromiter([hashed(s, SEED) for s in part], np.uint64, len(part))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (a signed long) of each row."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t or "", width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def parity_masks(coded: int) -> list[int]:
    """Masks of the bits whose place (from 1) has binary digit k: their parities spell the syndrome."""
    return [sum(1 << (i - 1) for i in range(1, coded + 1) if i >> k & 1) for k in range(coded.bit_length())]


def anchors(fp: Column, coded: int = CODED) -> Column:
    """All anchors within 2 bits of a fingerprint, for differences in its lowest ``coded`` + 1 bits (2 ** m - 1
    coded ones and a free one); any higher bits are the same in all that are compared."""
    one = F.lit(1).cast("long")

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", one, (place - 1).cast("int"))

    syndrome = F.lit(0)
    for k, mask in enumerate(parity_masks(coded)):
        syndrome = syndrome + F.bit_count(fp.bitwiseAND(F.lit(mask))) % 2 * (1 << k)
    top = F.lit(-(1 << 63) if coded == 63 else 1 << coded)
    home = F.when(syndrome == 0, fp).otherwise(fp.bitwiseXOR(bit(F.greatest(syndrome, F.lit(1)))))
    low = F.filter(F.sequence(F.lit(1), F.lit(coded)), lambda i: i < i.bitwiseXOR(syndrome))
    far = F.transform(low, lambda i: fp.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(syndrome))))
    return F.concat(F.array(home, home.bitwiseXOR(top)), far)


def chained(anchor: int, members: list[int]) -> list[tuple[int, int]]:
    """Links among fingerprints within 2 bits of one anchor: the first that flips a bit is linked to all
    others that flip it, which are within 2 bits of it, as are single flips to each other, and the anchor
    itself to all."""
    links, first = [], {}
    for fp in members:
        flips, bits = (fp ^ anchor) & (1 << 64) - 1, []
        while flips:
            bits.append(flips & -flips)
            flips &= flips - 1
        if not bits:
            links += [(fp, other) for other in members if other != fp]
        for key in bits + [0] * (len(bits) == 1):
            if first.setdefault(key, fp) != fp:
                links.append((first[key], fp))
    return links


def near_links(points: DataFrame, coded: int = CODED) -> DataFrame:
    """``points``: distinct fp. Links (a, b) that join all fingerprints within 2 bits of each other."""
    near = points.select("fp", F.explode(anchors(F.col("fp"), coded)).alias("anchor"))
    near = near.repartition("anchor").sortWithinPartitions("anchor")

    def links(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
        ends, found = np.r_[starts[1:], len(anchor)], []
        for k in np.flatnonzero(ends - starts > 1):
            s, e = starts[k], ends[k]
            found += chained(int(anchor[s]), sorted(fp[s:e].tolist()))
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        """Anchors come sorted; the last one of a batch waits for the next batch."""
        held_anchor, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            anchor = np.r_[held_anchor, batch.column(1).to_numpy()]
            fp = np.r_[held_fp, batch.column(0).to_numpy()]
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            yield links(anchor[:cut], fp[:cut])
            held_anchor, held_fp = anchor[cut:], fp[cut:]
        yield links(held_anchor, held_fp)

    return near.mapInArrow(run, "a long, b long")


def simhash_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the least doc_id that is reached over links
    between fingerprints at most 2 bits apart, the row's own included.

    Null and blank texts have fingerprint 0 and are linked like any other. Rows with equal fingerprints
    form one point, so copies, however many, cost one record each and no links. A null doc_id never is a
    component's id unless all its ids are null; repeated rows stay; an empty table gives an empty result;
    other columns are ignored.
    """
    marked = settle(fingerprints(docs, width))
    points = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = marked.join(point_groups(points), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def point_groups(points: DataFrame) -> DataFrame:
    """``points``: distinct fp with ``least``, any value of theirs. fp and component, the least value in its
    component of fingerprints at most 2 bits apart."""
    labels = components(near_links(points.select("fp")), size_of(points))
    linked = points.join(labels.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    linked = linked.join(least, "label").select("fp", "component")
    lone = points.join(labels.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("component"))
    return linked.unionByName(lone)


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's id; ``found`` has doc_id and component_id. Where an
    id repeats, its rows with equal texts count as one and those with different texts all stay.

    Rows of other ids than those that go or repeat are told by a bit filter and stay in their map tasks; the
    rest is joined."""
    same, rows = fresh(docs.columns, "same_id", "rows")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = gathered(found.groupBy("doc_id").agg(F.count_if(kept).alias(rows), F.count("*").alias("all_rows")))
    special = ids.where(f"{rows} <> 1 or all_rows > 1")
    keys, n = counted(special.select(F.xxhash64("doc_id").alias("key")))
    shared = filter_of(keys)
    maybe = may_hold(shared, F.xxhash64("doc_id"))
    some = docs.where(maybe).join(special.select(F.col("doc_id").alias(same), rows), F.col("doc_id").eqNullSafe(F.col(same)), "left")
    some = in_few(some.where(F.col(same).isNull() & F.col(rows).isNull() | (F.col(rows) > 0)), n, HEAVY)
    out = docs.where(~maybe).select(*docs.columns).unionByName(some.where(F.coalesce(F.col(rows), F.lit(1)) == 1).select(*docs.columns))
    if not special.where(F.col(rows) > 1).isEmpty():
        out = out.unionByName(some.where(F.col(rows) > 1).select(*docs.columns).dropDuplicates(["doc_id", "text"]))
    return out


def kept_rows(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each component of ``simhash_dedup``, with all its columns."""
    return one_of_each(docs, simhash_dedup(docs, width))
