"""Periodic runs: stretches of words that repeat with a period, found on a harmonic grid.

For each period p the words at 0, p, 2p, ... form a grid, and a run of at least four periods holds four
neighbouring grid words, which are equal. Each such place jp is extended with (j + 1)p by the longest common
extension to the right and to the left. An extension is a range minimum over the common prefixes of neighbours
in a suffix array, to the left in that of the reversed words. The grid has n log n places for n words, however
the words repeat; places whose words differ start no run and are not asked.

Texts are searched many at a time: a word counts as another one in another text, so that no extension leaves
its text. A map without a shuffle; memory is linear in the longest text but for one rank array for each
doubling of the longest repetition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import free_memory
from trailweave.llm.shingles import parts

#: Grid places are kept for texts up to so many words; longer ones are walked period by period.
GRID_WORDS = 1 << 16
#: Texts are searched together up to so many words, and so many places are extended at once.
WORDS_AT_ONCE, PLACES_AT_ONCE = 200_000, 200_000
BLOCK = 32


class RangeMin:
    """Minima of ranges: heads and tails of blocks, doubled ranges of whole blocks, and a scan within one."""

    def __init__(self, values: np.ndarray):
        pad = -len(values) % BLOCK
        self.v = np.r_[values, np.full(pad, np.iinfo(np.int32).max, np.int32)].astype(np.int32)
        rows = self.v.reshape(-1, BLOCK)
        self.head = np.minimum.accumulate(rows, axis=1).ravel()
        self.tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(1)]
        while len(self.table[-1]) > (step := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least values of lo..hi, both included."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.tail[lo], self.head[hi])
        between = np.flatnonzero(b - a > 1)
        if len(between):
            first, last = a[between] + 1, b[between] - 1
            level = np.frexp((last - first + 1).astype(float))[1] - 1
            for k in np.unique(level):
                at = level == k
                x = np.minimum(self.table[k][first[at]], self.table[k][last[at] - (1 << k) + 1])
                out[between[at]] = np.minimum(out[between[at]], x)
        inside = np.flatnonzero(a == b)
        if len(inside):
            at, end = lo[inside].copy(), hi[inside]
            least = self.v[at]
            for _ in range(BLOCK - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.v[at])
            out[inside] = least
        return out


class Suffixes:
    """Suffix array by prefix doubling, in which only suffixes that are still equal are sorted again."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        order = np.argsort(x, kind="stable")
        first = np.r_[True, x[order][1:] != x[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, k = [rank], 1
        undecided = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        while len(undecided):
            then = np.where(undecided + k < n, rank[np.minimum(undecided + k, n - 1)] + 1, 0)
            by = np.lexsort((then, rank[undecided]))
            at, then = undecided[by], then[by]
            group = np.r_[True, rank[at][1:] != rank[at][:-1]]
            part = group | np.r_[True, then[1:] != then[:-1]]
            place = np.arange(len(at))
            start, begin = (np.maximum.accumulate(np.where(x, place, 0)) for x in (group, part))
            rank = rank.copy()
            rank[at] = rank[at] + begin - start
            levels.append(rank)
            lone = part & np.r_[part[1:], True]
            undecided, k = at[~lone], 2 * k
        self.rank = rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        one, other, common = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            i, j = one + common, other + common
            same = (i < n) & (j < n) & (levels[level][np.minimum(i, n - 1)] == levels[level][np.minimum(j, n - 1)])
            common += same * (1 << level)
        self.least = RangeMin(common.astype(np.int32)) if n > 1 else None

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and from j on; i and j differ."""
        a, b = self.rank[i], self.rank[j]
        return self.least.query(np.minimum(a, b), np.maximum(a, b) - 1).astype(np.int64)


_GRID: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods (jp, p) with (j + 3)p < n, for a text of n words, at most GRID_WORDS."""
    top = max(1 << (n - 1).bit_length(), 64)
    if top not in _GRID:
        places = [np.arange(0, top - 3 * p, p, dtype=np.int32) for p in range(1, top // 3 + 1)]
        at = np.concatenate(places)
        p = np.repeat(np.arange(1, len(places) + 1, dtype=np.int32), list(map(len, places)))
        by = np.argsort(at + 3 * p, kind="stable")
        _GRID[top] = at[by], p[by], (at + 3 * p)[by]
    at, p, last = _GRID[top]
    m = int(np.searchsorted(last, n))
    return at[:m], p[:m]


def places(w: np.ndarray):
    """Grid places (at, p) of a text whose words at, at + p, at + 2p and at + 3p are equal, in parts."""
    n = len(w)
    if n <= GRID_WORDS:
        at, p = grid(n)
        for k in range(3):
            same = np.flatnonzero(w[at + k * p] == w[at + (k + 1) * p])
            at, p = at[same], p[same]
        yield at.astype(np.int64), p.astype(np.int64)
        return
    held, size = [], 0
    for p in range(1, n // 3 + 1):
        some = w[::p]
        same = some[1:] == some[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
        if len(at):
            held.append((at, np.full(len(at), p)))
            size += len(at)
            if size > PLACES_AT_ONCE:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def runs_of(texts: list[np.ndarray], least_length: int = 6, least_power: int = 4) -> list[np.ndarray]:
    """Of each text (word codes) its runs as rows (start, length, period), in order of start and period."""
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    waiting, size = [], 0
    for i, w in enumerate(texts):
        found = [x for x in places(w) if len(x[0])]
        if found:
            waiting.append((i, found))
            size += len(w)
        if waiting and size > WORDS_AT_ONCE:
            _extend(texts, waiting, out, least_length, least_power)
            waiting, size = [], 0
    if waiting:
        _extend(texts, waiting, out, least_length, least_power)
    return out


def _extend(texts: list[np.ndarray], waiting: list, out: list, least_length: int, least_power: int) -> None:
    chosen = [texts[i] for i, _ in waiting]
    starts = np.cumsum([0, *map(len, chosen)])
    codes = np.concatenate(chosen).astype(np.int64)
    own = np.repeat(np.arange(len(chosen)), np.diff(starts)) * (int(codes.max()) + 1) + codes
    ahead, back, n = Suffixes(own), Suffixes(own[::-1].copy()), len(own)
    for (i, found), base, w in zip(waiting, starts, chosen):
        rows = []
        for many_at, many_p in found:
            for s in range(0, len(many_at), PLACES_AT_ONCE):
                at, p = many_at[s : s + PLACES_AT_ONCE], many_p[s : s + PLACES_AT_ONCE]
                right = ahead.common(base + at, base + at + p)
                left = np.zeros(len(at), np.int64)
                inner = np.flatnonzero(at > 0)
                left[inner] = back.common(n - base - at[inner], n - base - at[inner] - p[inner])
                long = p + right + left
                fits = long >= np.maximum(least_length, least_power * p)
                rows.append(np.unique(np.stack([at - left, long, p], 1)[fits], axis=0))
        rows = np.unique(np.concatenate(rows), axis=0)
        smallest = np.ones(len(rows), bool)
        smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)  # a multiple of the period gives the same stretch
        rows = rows[smallest]
        out[i] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, cut at ASCII white space, and how many each has."""
    words = pc.ascii_split_whitespace(texts)
    sizes, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():
        ends = np.r_[0, np.cumsum(real)][np.cumsum(sizes)]
        sizes, flat = np.diff(ends, prepend=0), flat.filter(pa.array(real))
    return flat, sizes


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least_length: int = 6, least_power: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period in words, by start and period) and collapsed: the
    words without those that a run holds after its first period, joined by one space.

    A run has at least ``least_length`` words and ``least_power`` (4 or more) of its smallest period, and no
    neighbouring word extends it. Null text counts as empty and has no runs; runs may overlap; repeated rows and
    null ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    if least_power < 4:
        raise ValueError("the grid finds runs of at least four periods")

    def run(batches):
        free_memory()
        for batch in batches:
            for at, texts in parts(batch.column(1)):
                flat, sizes = split_words(texts)
                ends = np.cumsum(sizes)
                codes = flat.dictionary_encode().indices.to_numpy()
                found = runs_of(np.split(codes, ends[:-1]), least_length, least_power)
                edge = np.zeros(len(flat) + 1, np.int64)
                for base, rows in zip(ends - sizes, found):
                    np.add.at(edge, base + rows[:, 0] + rows[:, 2], 1)
                    np.add.at(edge, base + rows[:, 0] + rows[:, 1], -1)
                keep = np.cumsum(edge[:-1]) == 0
                left = np.r_[0, np.cumsum(keep)][np.r_[0, ends]].astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(left), flat.filter(pa.array(keep)))
                rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
                columns = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], fields=list(RUN))
                runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32)), columns)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes), runs, pc.binary_join(words, " ")], ["doc_id", "n_words", "runs", "collapsed"]
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _long(name: str, *args: Column) -> Column:
    return F.call_function(name, *args).cast("long")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in a tenth of the documents with a period put in: with h the CRC-32 of the decimal
    doc_id and g = h div 10, from word g mod n on the first of 3 + g mod 8 parts is repeated. A null id leaves
    the text as it is."""
    words, i = F.col("words"), F.col("i")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h.alias("h"))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    d = d.withColumn("n", F.size("words").cast("long")).withColumn("g", _long("div", F.col("h"), F.lit(10)))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", 1 + _long("div", F.col("n") - F.col("a"), 3 + F.col("g") % 8))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    changed = F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Of the operator's rows: the number of runs, the longest (of equals the first, then the smallest period) and
    hashes of all runs and of the words left."""
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    d = found.withColumn("top", F.array_max(order))
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        _long("div", 1000 * F.col("top.length"), -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
