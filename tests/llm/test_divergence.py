"""Source divergence against its definition in plain Python and against its SQL."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from trailweave.llm import divergence
from trailweave.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, term string, value string"


def plain(rows, least=10, top=10):
    groups, docs, counts = set(), Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 2) // (total + 2 * len(kept)) for w in kept}

        sources = sorted(s for x, s in groups if x == lang)
        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(t, sum(apart(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s]
            terms = [(w, apart(p[s][w], q[w])) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])}
    return out


def frame(spark, rows, parts=3):
    df = spark.createDataFrame([(i, *r, 1, 2, "t", "v") for i, r in enumerate(rows)], SCHEMA)
    return df.repartition(parts) if rows else df


def some_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Ünïcode", "ĲÉ", "𝒳y"]
    rows = []
    for _ in range(n):
        take = rng.zipf(1.3, rng.integers(0, 60)) % len(words)
        rows.append((" ".join(words[k].upper() if k % 3 else words[k] for k in take) + "; it's 3x", ["en", "de", None][rng.integers(3)], [None, "a", "b", "hot", "hot", "é"][rng.integers(6)]))
    return rows


@pytest.mark.parametrize("least, log", [(10, None), (3, 14), (1, 14)])
def test_is_its_definition(spark, least, log):
    """The small sketches are overfull: more terms are counted, with the same result."""
    rows = some_rows(400) + [(None, "xx", "lone"), ("", "xx", None), ("only here", "yy", "one")]
    found = divergence.source_divergence(frame(spark, rows), least, log=log).collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == plain(rows, least)
    assert {r.part for r in found} == {"pair", "term"}


def test_sketch_never_underestimates_and_rules_out_most(spark):
    rows = some_rows(300, 1) + [(f"rare{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}", "en", "a") for k in range(3000)]
    docs = Counter((lang or "", w) for text, lang, _ in rows for w in set(divergence.terms(text)) - {b""})
    bits = np.frombuffer(divergence.possible_terms(frame(spark, rows), 10, 16).value, np.uint8)
    passed = 0
    for (lang, term), n in docs.items():
        cells = divergence._cells(lang.encode(), [term], 16)[:, 0]
        hit = all(bits[c >> 3] >> (7 - (c & 7)) & 1 for c in cells)
        assert hit or n < 10
        passed += hit and n < 10
    assert passed < 100


@given(st.text())
def test_terms_are_those_of_the_pattern(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert [t.decode() for t in divergence.terms(text) if t] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    rows = some_rows(200, 2)
    monkeypatch.setattr(divergence, "MOST_TERMS", 50)
    assert set(map(tuple, divergence.source_divergence(frame(spark, rows, 2), 5).collect())) == plain(rows, 5)


def test_odd_rows(spark, make, odd):
    docs = make(odd * 12)
    rows = [(t, "en", None) for _, t in odd * 12]
    assert set(map(tuple, divergence.source_divergence(docs).collect())) == plain(rows)
    assert divergence.source_divergence(make([])).count() == 0


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**17, 3 * 10**18, 10)], "n long, total long, size long")
    from pyspark.sql import functions as F

    got = df.select(divergence._share(F.col("n"), F.col("total"), F.col("size"))).first()[0]
    assert got == 1 + 10**9 * (10**17 + 2) // (3 * 10**18 + 20)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="demonstration tables are absent")
def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DIR}/documents.parquet')")
    want = con.sql(ORACLES["op13_source_divergence"])
    got = QUERIES["op13_source_divergence"](spark, DIR)
    assert got.columns == want.columns
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall()) and len(rows) > 100
