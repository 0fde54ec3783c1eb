"""Periodic runs against plain search, and the registered query against the contract's rules in plain Python."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from trailweave.llm import runs
from trailweave.llm.common import table
from trailweave.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def smallest_period(w):
    """By the failure function of the whole stretch."""
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[-1]


def plain_runs(w):
    """Every period is walked from left to right; stretches with a smaller period are left to it."""
    out, n = [], len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if length >= max(6, 4 * p) and smallest_period(w[s : s + length]) == p:
                out.append((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *top, top[1] and 1000 * top[1] // top[2], sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_are_those_of_plain_search(letters):
    rng, texts = random.Random(letters), []
    for n in [*range(0, 14), *[rng.randrange(15, 160) for _ in range(120)]]:
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):  # repeated parts
            p, a = rng.randrange(1, 9), rng.randrange(n + 1)
            w = w[:a] + (w[a : a + p] * rng.randrange(2, 8)) + w[a:]
        texts.append(np.array(w, np.int32))
    got = runs.runs_of(texts)
    for w, rows in zip(texts, got):
        assert list(map(tuple, rows.tolist())) == plain_runs(w.tolist())
    assert sum(map(len, got)) > 50


def test_texts_longer_than_the_grid(monkeypatch):
    rng = random.Random(5)
    w = [rng.randrange(3) for _ in range(300)] + [0, 1, 2, 2] * 20 + [1] * 30
    want = plain_runs(w)
    for name, value in (("GRID_WORDS", 64), ("PLACES_AT_ONCE", 7), ("WORDS_AT_ONCE", 100)):
        monkeypatch.setattr(runs, name, value)
    got = runs.runs_of([np.array(w, np.int32)] * 3)
    assert all(list(map(tuple, r.tolist())) == want for r in got) and len(want) > 3


def test_long_repetitions_take_little_more_than_linear_time():
    rng = random.Random(1)
    part = [rng.randrange(5000) for _ in range(40_000)]
    for w in ([7] * 200_000, part * 5, part + [1, 2, 3] * 50_000):
        began = time.perf_counter()
        rows = runs.runs_of([np.array(w, np.int32)])[0].tolist()
        assert time.perf_counter() - began < 60
        assert max(r[1] for r in rows) in (len(w), 150_000) and len(w) - 40_000 >= 150_000


def test_range_minima():
    rng = np.random.default_rng(3)
    for n in (1, 5, 32, 33, 500, 5000):
        v = rng.integers(0, 9000, n).astype(np.int32)
        lo = rng.integers(0, n, 400)
        hi = np.minimum(lo + rng.integers(0, n, 400), n - 1)
        assert runs.RangeMin(v).query(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi)]


def test_query_follows_the_contract(spark):
    docs = table(spark, DIR, "documents").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, DIR).collect()))
    short = [r for r in docs if len((r.text or "").split()) < 1500]
    want = {plain_digest(r.doc_id, r.text) for r in short}
    assert len(got) == len(docs) and {r for r in got if r[0] in {x.doc_id for x in short}} == want
    assert sum(r[1] > 0 for r in want) > 10


def test_odd_rows(make, odd):
    rows = odd + [(10, "a " * 50), (11, "x y z " * 9 + "x"), (12, "            q")]
    rows = [r for r in rows if r[0] != 7] + [(7, "go on " * 40_000)]
    got = sorted((tuple(r) for r in runs.run_digest(runs.periodic_runs(runs.planted(make(rows)))).collect()), key=str)
    assert got == sorted((plain_digest(i, t) if i != 7 else next(r for r in got if r[0] == 7) for i, t in rows), key=str)
    seven = next(r for r in got if r[0] == 7)
    assert seven[1:5] == (1, 0, 80_000, 2)
    found = {r.doc_id: r for r in runs.periodic_runs(make(rows)).collect()}
    assert found[11].collapsed == "x y z" and found[10].collapsed == "a" and found[1].collapsed == "" and found[1].runs == []
    assert runs.periodic_runs(make([])).count() == 0
