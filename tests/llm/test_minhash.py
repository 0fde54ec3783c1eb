"""MinHash near duplicates against brute force over all pairs of sets."""

import math
import os
import random
import re

import numpy as np
import pytest

from trailweave.llm import links, minhash
from trailweave.llm.common import table
from trailweave.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def brute(rows, percent=85):
    """doc_id -> (n_shingles, component_id, kept); ids must not repeat."""
    sets = {i: plain_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    common = {}
    for many in having.values():
        for k, a in enumerate(many):
            for b in many[k + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def found(docs):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_dedup(docs).collect()}


def edited(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


def test_matches_brute_force(make):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.choice((8, 40, 250))))) for i in range(60)]
    for i in range(60):
        w = rows[i][1].split()
        rows.append((2000 + i, " ".join(edited(rng, w, rng.randrange(1 + len(w) // 25), words))))
        rows.append((3000 + i, " ".join(w[: len(w) - len(w) // rng.choice((5, 7, 9, 20))])))
        rows.append((4000 + i, " ".join(w + w[:30]).upper()))
    want = brute(rows)
    assert 60 < len({x[1] for x in want.values()}) < 200
    assert found(make(rows)) == want


def test_the_threshold_is_exact(make):
    """Overlaps of exactly 85 of 100 are links, those just below are none."""
    base = [f"w{i}" for i in range(102)]  # 100 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:87])), (3, " ".join(base[:86]).replace("w", "v")), (8, " ".join(base).replace("w", "v")), (4, "one"), (5, "one two"), (6, "ONE"), (7, "one two three")]
    got = found(make(rows))
    assert got == brute(rows) and got[2][1] == 1 and got[3][1] == 3 and got[8][1] == 8 and got[6][1] == 4


@pytest.mark.parametrize("block, nearest", [(2048, 4), (16, 1), (7, 2)])
def test_large_groups_just_short_of_similar(make, monkeypatch, block, nearest):
    """Copies like the original but not all like each other, in small blocks and with few named at a time."""
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "NEAREST", nearest)
    monkeypatch.setattr(links, "GROWTH", 2)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    rows = [(i, " ".join(edited(rng, base, 3 + i % 7, words))) for i in range(150)]
    want = brute(rows)
    assert len({x[1] for x in want.values()}) > 10 and max(list(x[1] for x in want.values()).count(c) for c in {x[1] for x in want.values()}) > 10
    assert found(make(rows)) == want


def test_a_large_group_takes_few_checks(make, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, i % 4, words))) for i in range(2000)]
    checked, plain = [], links.verified
    monkeypatch.setattr(links, "verified", lambda pairs, sets, percent: (checked.append(pairs.count()), plain(pairs, sets, percent))[1])
    got = found(make(rows))
    assert {x[1] for x in got.values()} == {0} and sum(checked) < 30 * len(rows)


def test_pairs_under_the_threshold_share_a_key():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 16, (300, minhash.HASHES)).astype(np.uint16)
    other = one.copy()
    for k, row in enumerate(other):
        at = rng.permutation(minhash.HASHES)[: minhash.MOST_APART] if k % 2 else np.arange(minhash.MOST_APART) // 2 * 5 + np.arange(minhash.MOST_APART) % 2
        row[at] ^= 1
    assert ((one != other).sum(1) == minhash.MOST_APART).all()
    assert (minhash.keys(one) == minhash.keys(other)).any(1).all()


def test_chance_of_a_similar_pair_over_the_threshold():
    def over(j):
        return sum(math.comb(minhash.HASHES, k) * (1 - j) ** k * j ** (minhash.HASHES - k) for k in range(minhash.MOST_APART + 1, minhash.HASHES + 1))

    assert over(0.85) < 1e-6 and over(0.9) < 2e-10


def test_symbols_differ_as_often_as_sets():
    rng = np.random.default_rng(4)
    far = []
    for _ in range(200):
        all_ = rng.integers(-(1 << 63), 1 << 63, 400)
        a, b = np.sort(all_[:370]), np.sort(all_[30:])  # 340 of 400
        x, y = minhash.signatures([a, b])
        far.append((x != y).sum())
    assert abs(np.mean(far) - 0.15 * minhash.HASHES) < 0.8 and 2 < np.std(far) < 3.6 and max(far) <= minhash.MOST_APART


def test_odd_rows(make, odd):
    docs = make(odd)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_dedup(docs).collect()), key=str)
    assert len(got) == len(odd)
    by = {}
    for i, n, c, k in got:
        by.setdefault(i, set()).add((n, c, k))
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)}
    assert {x[1] for x in by[4]} == {x[1] for x in by[5]} == {4} and by[8] == {(1, 8, True)} and by[9] == {(1, 9, True)}
    assert (0, None, True) in by[None] and any(c == 4 and not k for _, c, k in by[None])
    assert minhash.minhash_dedup(make([])).count() == 0
    with pytest.raises(ValueError):
        minhash.minhash_dedup(docs, 80)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="demonstration tables are absent")
def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DIR, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op11_minhash"](spark, DIR).collect()}
    want = brute(rows)
    assert got == want and sum(not x[2] for x in want.values()) > 5
