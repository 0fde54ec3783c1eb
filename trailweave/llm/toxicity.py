"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over hashed word features is trained from confirmed toxic texts and from unlabelled
ones, different texts drawn from all documents. For their share pi of toxic texts there are two figures: a bound
that the two samples give, and the share among labelled rows; the lesser is taken, since labels are given more
often where toxic texts are looked for. The risk on clean text is then estimated as the risk of calling unlabelled text toxic minus pi times that of calling toxic text toxic; where that
estimate falls below zero the model overfits, and the step goes back up instead.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import free_memory, resident

FOLDS = 5
MARKS = ".,;:!?…\"'`()[]{}<>|*#$%&@/\\-_«»“”‘’¡¿"
#: Lengths of word beginnings that are features next to the whole word.
STARTS = (4, 5, 6)
BITS = 18
MOST_WORDS = 300_000


@dataclass(frozen=True)
class PuSettings:
    """``most_toxic`` and ``most_unlabelled`` bound the training sample: rows are taken in the order of a
    hash of their id, and of the unlabelled ones equal texts count once. Everything else covers all rows."""

    most_toxic: int = 3000
    most_unlabelled: int = 6000
    least_texts: int = 3
    least_z: float = 4.0
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learnt from; a null id is never held out, and never in the labels."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


def features(word: str) -> list[int]:
    """Hashed places of a word without the marks around it: itself and its beginnings."""
    bare, mask = word.strip(MARKS), (1 << BITS) - 1
    if not bare:
        return [zlib.crc32(word.encode()) & mask] * (1 + len(STARTS))
    return [zlib.crc32(b"=" + bare.encode()) & mask] + [zlib.crc32(b"^" + bare[:n].encode()) & mask for n in STARTS]


def telling(at: np.ndarray, owner: np.ndarray, places: np.ndarray, n: int, m: int, settings: PuSettings) -> np.ndarray:
    """Which places hold features whose shares of toxic and of unlabelled texts differ beyond chance."""
    marked = np.zeros(1 << BITS, bool)
    for kind in range(places.shape[1]):  # kinds are hashed apart, so pairs of text and place repeat within one only
        pairs = owner.astype(np.uint32 if m < 1 << (32 - BITS) else np.uint64)
        pairs <<= BITS
        pairs |= places[at, kind].astype(pairs.dtype)
        pairs.sort()
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        cut = np.searchsorted(pairs, n << BITS)  # toxic texts come first
        pairs &= (1 << BITS) - 1
        toxic, rest = np.bincount(pairs[:cut], minlength=1 << BITS), np.bincount(pairs[cut:], minlength=1 << BITS)
        both = toxic + rest
        share = (both + 1) / (m + 2)
        z = (toxic / n - rest / (m - n)) / np.sqrt(share * (1 - share) * (1 / n + 1 / (m - n)))
        marked |= (np.abs(z) > settings.least_z) & (both >= settings.least_texts)
    return marked


def risk_slope(z: np.ndarray, p: np.ndarray, is_toxic: np.ndarray, prior: float) -> np.ndarray:
    """Slope of the non-negative risk by each text's logit ``z`` (``p``: its sigmoid). The risk is that of calling
    toxic texts clean, times the prior, plus the clean risk: that of calling unlabelled texts toxic minus the prior
    times that of calling toxic texts toxic. Where the clean risk is negative, its own slope is turned round."""
    n, m = int(is_toxic.sum()), len(z)
    loss = np.logaddexp(0, z)  # of calling a text toxic that is clean
    clean_risk = loss[~is_toxic].mean() - prior * loss[is_toxic].mean()
    slope = np.where(is_toxic, -prior * p / n, p / (m - n))
    return slope + np.where(is_toxic, prior * (p - 1) / n, 0) if clean_risk >= 0 else -slope


def estimated_prior(at: np.ndarray, owner: np.ndarray, places: np.ndarray, is_toxic: np.ndarray) -> float:
    """Share of toxic texts among the unlabelled. Any set of texts holds at least pi times the share of toxic texts
    in it, so pi is at most the ratio of the two shares; the sets are those above a score, by log ratios of the
    features' counts in one half of the texts, among the texts of the other half; one standard error is allowed for
    in each share, since the least of several figures is taken."""
    least, half = 1.0, np.random.default_rng(1).random(len(is_toxic)) < 0.5
    for fit in (half, ~half):
        counts = []
        for kind in (is_toxic, ~is_toxic):
            rows = (fit & kind)[owner]
            counts.append((np.bincount(places[at[rows]].ravel(), minlength=int(places.max()) + 1) + 1) / ((fit & kind).sum() + 2))
        weights = np.log(counts[0]) - np.log(counts[1])
        weights[0] = 0
        score = np.bincount(owner, weights[places].sum(1)[at], len(is_toxic))
        toxic, rest = np.sort(score[~fit & is_toxic]), score[~fit & ~is_toxic]
        if len(toxic) < 10 or len(rest) < 10:
            continue
        for share in (0.9, 0.8, 0.7, 0.6, 0.5):
            cut = toxic[int(len(toxic) * (1 - share))]
            u, t = (rest >= cut).mean(), (toxic >= cut).mean()
            least = min(least, (u + (u * (1 - u) / len(rest)) ** 0.5) / max(t - (t * (1 - t) / len(toxic)) ** 0.5, 1e-3))
    return float(min(max(least, 0.001), 0.9))


def train(toxic: pa.ChunkedArray, unlabelled: pa.ChunkedArray, most_prior: float, settings: PuSettings = PuSettings()) -> tuple[np.ndarray, float]:
    """Weights and bias from the distinct words of each text (lists of strings): Adam on the non-negative
    risk. ``most_prior``: where the estimate of the prior ends. Words are numbered once and kept as Arrow data, so a sample of the largest size takes some 300 MB."""
    if not len(toxic) or not len(unlabelled):
        return np.zeros(1 << BITS), -20.0
    n = len(toxic)
    sizes = np.concatenate([c.value_lengths().to_numpy() for part in (toxic, unlabelled) for c in part.chunks])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    coded = pa.concat_arrays([c.flatten() for part in (toxic, unlabelled) for c in part.chunks]).dictionary_encode()
    at, number = coded.indices.to_numpy(), coded.dictionary
    del coded, toxic, unlabelled
    places = np.fromiter((x for w in number for x in features(w.as_py())), np.int32, len(number) * (1 + len(STARTS))).reshape(-1, 1 + len(STARTS))
    m = len(sizes)
    is_toxic = np.arange(m) < n
    column = np.cumsum(marked := telling(at, owner, places, n, m, settings)) * marked  # 0: not in use
    places = column[places]
    used = places.any(1)[at]
    at, owner, number = at[used], owner[used], None
    size = int(column.max()) + 1
    prior = min(estimated_prior(at, owner, places, is_toxic), most_prior)
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    mean, square, mean_b, square_b = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, settings.steps + 1):
        z = np.bincount(owner, weights[places].sum(1)[at], m) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = risk_slope(z, p, is_toxic, prior)
        by_word = np.bincount(at, slope[owner], len(places))
        slopes = np.bincount(places.ravel(), np.repeat(by_word, places.shape[1]), size) + settings.decay * weights
        slopes[0] = 0
        mean, square = 0.9 * mean + 0.1 * slopes, 0.99 * square + 0.01 * slopes**2
        weights -= settings.rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        total = slope.sum()
        mean_b, square_b = 0.9 * mean_b + 0.1 * total, 0.99 * square_b + 0.01 * total**2
        bias -= settings.rate * mean_b / (1 - 0.9**step) / (np.sqrt(square_b / (1 - 0.99**step)) + 1e-7)
    return weights[column], float(bias)


class _Worth(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        worth = sum(map(self.weights.__getitem__, features(word)))
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = worth
        return worth


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.worth, self.bias = _Worth(weights), bias

    def __call__(self, text: str) -> float:
        z = self.bias + sum(map(self.worth.__getitem__, sorted(words_of(text))))
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def fit(docs: DataFrame, labels: DataFrame, settings: PuSettings = PuSettings()):
    """Broadcast weights and bias (fixed size). Reads labels of rows that are not held out only."""
    shuffled = F.xxhash64("doc_id")
    seen = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    seen = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, known = seen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    most_prior = min(max(toxic / known if known else 0.5, 0.001), 0.9)
    confirmed = seen.where("toxic = 1").orderBy(shuffled, "doc_id").limit(settings.most_toxic)
    every = docs.select("doc_id").where("doc_id is not null")
    rest = every.orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id"), "doc_id").limit(settings.most_unlabelled)

    def distinct_words(batches):
        for batch in batches:
            words = pa.array([sorted(words_of(t or "")) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], ["doc_id", "words"])

    def sample(ids: DataFrame, different: bool) -> pa.ChunkedArray:
        texts = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
        schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, words array<string>"
        if different:  # of equal texts the one with the least id, so that groups of copies do not outweigh the rest
            texts = texts.withColumn("same", F.xxhash64("text"))
            first = texts.groupBy("same").agg(F.min("doc_id").alias("first"))
            texts = texts.join(F.broadcast(first.select(F.col("first").alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", "text")
        return texts.mapInArrow(distinct_words, schema).toArrow().sort_by("doc_id").column("words")

    model = train(sample(confirmed, False), sample(rest, True), most_prior, settings)
    free_memory()  # what training has used; a driver lives on for long
    return docs.sparkSession.sparkContext.broadcast(model)


def _scorer(shared) -> Scorer:
    weights, bias = shared.value
    return resident(("toxicity", hashlib.sha256(weights).hexdigest(), bias), lambda: Scorer(weights, bias))


def toxicity(docs: DataFrame, labels: DataFrame, settings: PuSettings = PuSettings()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5) of each row.

    Only the text gives the score; null counts as empty and gets the score of a text without words. Rows
    are judged alone, so repeats do no harm; labels for the same id count as toxic if one does; without any
    confirmed toxic text nothing is predicted toxic; an empty table gives an empty result; other columns
    are ignored.
    """
    shared = fit(docs, labels, settings)

    def run(batches):
        score = _scorer(shared)
        for batch in batches:
            found = [score(t or "") for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)


def kept_rows(docs: DataFrame, labels: DataFrame, settings: PuSettings = PuSettings()) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns. Null text counts as empty, texts of any
    length are read whole, rows are judged alone, and an empty table gives an empty result."""
    shared = fit(docs, labels, settings)

    def run(batches):
        score = _scorer(shared)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([score(t or "") < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
