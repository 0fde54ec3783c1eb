"""Near duplicates by b-bit MinHash and a multi-index Hamming join.

A text's signature has HASHES symbols of 16 bits, each the mixed low part of the least of its shingles under one
hash. Two texts whose sets overlap by J differ in a symbol with a chance of 1 - J, so texts at the least overlap
of 0.85 differ in about 10 of 65. The join finds all pairs with at most MOST_APART = 25 different symbols: the
symbols are cut in CHUNKS = 13 chunks, and of 25 differences some chunk has at most one, since 13 chunks with two
each would have 26. The allowed error is enumerated: a chunk gives one key for each symbol left out, so any
such pair has an equal key. A pair at 0.85 exactly stays under the threshold but for a chance of 9e-7; at 0.9 it
is 2e-10. Pairs over the threshold aren't candidates, and all candidates are checked on whole sets.

Texts with equal sets are one from the start, so copies, however many, cost one record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm import links
from trailweave.llm.common import free_memory, settle
from trailweave.llm.shingles import mixed, parts, shingle_ids

WIDTH, PERCENT = 3, 85
CHUNKS, IN_CHUNK = 13, 5
HASHES = CHUNKS * IN_CHUNK
MOST_APART = 2 * CHUNKS - 1
_SEEDS = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS, TERMS = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]
SALTS = mixed(np.arange(1001, 1001 + HASHES, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES symbols (uint16) for each set, none of them empty."""
    flat, out = np.concatenate(sets).view(np.uint64), np.empty((len(sets), HASHES), np.uint16)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for k in range(HASHES):
        out[:, k] = mixed(np.minimum.reduceat(flat * FACTORS[k] + TERMS[k], starts)) >> np.uint64(48)
    return out


def keys(symbols: np.ndarray) -> np.ndarray:
    """For each signature (a row) the keys of its chunks, each without one symbol in turn."""
    out = np.empty(symbols.shape, np.uint64)
    for c in range(CHUNKS):
        for left_out in range(IN_CHUNK):
            value = np.zeros(len(symbols), np.uint64)
            for k in range(IN_CHUNK):
                if k != left_out:
                    value = value << np.uint64(16) | symbols[:, c * IN_CHUNK + k]
            out[:, c * IN_CHUNK + left_out] = mixed(value ^ SALTS[c * IN_CHUNK + left_out])
    return out.view(np.int64)


def keys_of(sigs: list[bytes]) -> np.ndarray:
    return keys(np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, HASHES))


def first_shared(sigs: list[bytes]):
    """For ``links.compared``: the first of the keys, in their order, that two members share."""
    every = keys_of(sigs)
    return lambda i, ids: every[i][(every[ids] == every[i]).argmax(1)]


def identify(texts: pa.StringArray) -> tuple[list[int], list[np.ndarray]]:
    sets = shingle_ids(texts, WIDTH)
    return [set_id(s) for s in sets], sets


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, t (the set's hash), n (its size) and sig (its signature; of an empty set, none)."""

    def run(batches):
        free_memory()
        for batch in batches:
            for at, texts in parts(batch.column(1)):
                ids, sets = identify(texts)
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full])):
                        sigs[i] = row.tobytes()
                columns = [batch.column(0).slice(at, len(texts)), pa.array(ids, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n", "sig"])
        pa.default_memory_pool().release_unused()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, n long, sig binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def postings(texts: DataFrame, wanted=None) -> DataFrame:
    """(tok, t): the keys of all signatures, or those that the broadcast filter ``wanted`` may hold."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            found, t = keys_of(batch.column(1).to_pylist()).ravel(), np.repeat(batch.column(0).to_numpy(), HASHES)
            if wanted is not None:
                hit = wanted.value.hit(found)
                found, t = found[hit], t[hit]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(t)], ["tok", "t"])

    return texts.select("t", "sig").mapInArrow(run, "tok long, t long")


def under_threshold(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most MOST_APART symbols."""

    @F.pandas_udf("int")
    def apart(a, b):
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, HASHES) for s in (a, b))
        return type(a)((x != y).sum(1).astype(np.int32), index=a.index)

    both = pairs
    for side in "ab":
        both = both.join(texts.select(F.col("t").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    return both.where(apart("sig_a", "sig_b") <= MOST_APART).select("a", "b")


def minhash_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that is reached over links) and kept.

    A text's set holds its distinct 3-word shingles, A-Z lower-cased; with fewer words the whole sequence is one;
    without words (or with a null text) it is empty and linked with nothing. Rows with equal sets are linked;
    repeated rows stay; a null doc_id is a component's id only if all its ids are null. ``percent`` is 85 or more.
    An empty table gives an empty result; other columns are ignored.
    """
    if percent < PERCENT:
        raise ValueError("signatures are cut for overlaps of 85 percent or more")
    marked = settle(marks(docs))
    texts = settle(marked.where("n > 0").groupBy("t").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig")))
    pairs, rows = links.buckets(lambda wanted: postings(texts, wanted), percent)
    pairs = settle(under_threshold(pairs, texts))
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("t")).union(rows.select("t")).distinct())
    labels = links.groups(pairs, rows, links.sets_of(docs, ends, identify), texts.select("t", "sig"), percent, first_shared)
    named = texts.select("t", "least").join(labels.withColumnRenamed("node", "t"), "t", "left").select("t", F.coalesce("label", "t").alias("label"), "least")
    named = settle(named)
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "label").select("t", "component_id")
    found = marked.where("n > 0").select("doc_id", "t", "n").join(ids, "t").select("doc_id", "n", "component_id")
    alone = marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
