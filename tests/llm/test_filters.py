import random
import re
import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailweave.llm import license_scan, quality, toxicity, url_filter


def test_quality_counts_match_brute_force(make, odd):
    rng = random.Random(7)
    rows = odd + [(100 + i, "\n".join(" ".join(rng.choice("ab cd ef gh | # $ x".split()) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(9)))) for i in range(80)]
    got = quality.quality_rules(make(rows)).collect()
    assert len(got) == len(rows)
    left = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        n = Counter(windows)
        repeat = len({j for k, w in enumerate(windows) if n[w] > 1 for j in range(k, k + 5)})
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        row = (i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeat, len(words) < 10 or 100 * repeat > 20 * len(words))
        assert left[row] > 0, row
        left[row] -= 1


def test_quality_lines():
    rules = quality.LineRules()
    fault = lambda x: quality.line_fault(x, rules)
    assert fault("Home | News | Sports | About") == "navigation"
    assert fault("A plain sentence without its end mark") is None and fault("It ends well.") is None
    assert fault("Menu") == "punctuation" and fault("Read more") == "boilerplate"
    assert fault("WOW!! SO!! MUCH!! NOISE!!") == "shouting" and fault("a### b$$$ c%%%") == "symbols"
    clean = "This is the first good line of text.\nThis is the second one, as good as the first."
    assert quality.judge(clean + "\nRead more", rules)["kept"] and quality.judge(clean + "\nRead more", rules)["cleaned"] == clean
    assert not quality.judge("\n".join(["Home | News | Sports | About"] * 5 + ["One good line."]), rules)["kept"]


def test_quality_kept_rows(make, odd):
    docs = make(odd)
    got = quality.kept_rows(docs)
    assert got.columns == docs.columns and sorted(r.doc_id or 0 for r in got.collect()) == sorted((r.doc_id or 0) for r in quality.quality_rules(docs).collect() if r.kept)
    text = "This is the first good line of text.\n\nRead more\nThis is the second one, as good as the first.\n"
    assert quality.kept_rows(make([(1, text)])).first().text == text.replace("Read more\n", "")
    assert quality.kept_rows(make([])).count() == quality.quality_rules(make([])).count() == 0


def sample(make, spark):
    rng = random.Random(11)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        words, bad = [rng.choice(clean) for _ in range(60)], i % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vilething", "vileword", "nastyone", "nastytwo"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_learnt(make, spark, odd):
    rows, labels = sample(make, spark)
    got = toxicity.toxicity(make(rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, r.doc_id % 6 == 0) for r in got if r.held_out and r.doc_id > 20]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    kept = toxicity.kept_rows(make(rows + odd), labels)
    assert kept.columns == make(odd).columns and kept.count() == sum(not r.predicted for r in got)
    again = toxicity.toxicity(make(rows + odd, 5), labels).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in got)


def test_toxicity_does_not_read_held_out_labels(make, spark):
    rows, labels = sample(make, spark)
    held = toxicity.held_out(labels["doc_id"])
    other = labels.select("doc_id", "quality", (1 - labels["toxic"]).alias("toxic")).where(held).unionByName(labels.where(~held))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(make(rows), x).collect()} for x in (labels, other))
    assert a == b


def test_toxicity_without_examples(make, spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(make(odd), none).collect()} == {0}
    assert toxicity.toxicity(make([]), none).count() == toxicity.kept_rows(make([]), none).count() == 0


def test_risk_slope_is_the_risks_derivative():
    rng = np.random.default_rng(3)
    for prior, shift in ((0.2, 0.0), (0.6, 4.0)):  # the second has a negative clean risk
        is_toxic = np.arange(30) < 12
        z = rng.normal(size=30) + shift * is_toxic

        def clean(z):
            loss = np.log1p(np.exp(z))
            return loss[~is_toxic].mean() - prior * loss[is_toxic].mean()

        def risk(z):
            return prior * np.log1p(np.exp(-z))[is_toxic].mean() + clean(z) if clean(z) >= 0 else -clean(z)

        assert (clean(z) < 0) == (shift > 0)
        slope = toxicity.risk_slope(z, 1 / (1 + np.exp(-z)), is_toxic, prior)
        for i in range(30):
            step = np.eye(30)[i] * 1e-5
            assert abs((risk(z + step) - risk(z - step)) / 2e-5 - slope[i]) < 1e-6


def test_prior_is_estimated_from_the_samples():
    """A tenth of the unlabelled texts are toxic; each toxic text has some of a few words."""
    rng = random.Random(5)

    def text(bad):
        return [f"w{rng.randrange(200)}" for _ in range(30)] + [rng.choice(["vile", "nasty", "foul"]) for _ in range(2 * bad)]

    lists = lambda texts: pa.chunked_array([pa.array(texts, pa.list_(pa.string()))])
    seen, estimate = [], toxicity.estimated_prior
    toxicity.estimated_prior = lambda *x: seen.append(estimate(*x)) or seen[-1]
    try:
        toxicity.train(lists([text(True) for _ in range(300)]), lists([text(i % 10 == 0) for i in range(3000)]), 0.9)
    finally:
        toxicity.estimated_prior = estimate
    assert 0.09 < seen[0] < 0.13


def test_risk_stays_above_zero():
    """With few texts, the plain estimate would fall far below zero; the model must still not call all
    unlabelled texts clean with certainty for no reason."""
    lists = lambda *t: pa.chunked_array([pa.array([x.split() for x in t], pa.list_(pa.string()))])
    weights, bias = toxicity.train(lists(*["bad thing here"] * 6), lists(*["good thing here"] * 20, "bad thing"), 0.2, toxicity.PuSettings(least_z=1, least_texts=1))
    score = toxicity.Scorer(weights, bias)
    assert score("bad") > 0.5 > score("good")


def test_licences(make, odd):
    notice = license_scan.TEMPLATES["MIT"][1]
    worn = notice.replace("restriction", "any limitation").replace("publish, ", "")
    rows = odd + [(50, "Intro.\nReleased under the MIT License.\nMore."), (51, f"É x {worn} end"), (52, "license of the mit school is released under water"), (53, notice[:200])]
    got = {r.doc_id: r for r in license_scan.license_scan(make(rows)).collect()}
    assert set(got) == {50, 51}
    assert (got[50].license, got[50].coverage, got[50].span_start, got[50].span_end) == ("MIT", 1.0, 7, 37)
    assert got[51].license == "MIT" and 0.9 < got[51].coverage < 1 and got[51].span_start == 4 and got[51].span_end == 3 + len(worn)
    assert license_scan.license_scan(make([])).count() == 0


@pytest.mark.parametrize(
    "text, names",
    [
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-NC-ND 4.0.", ["CC-BY-NC-ND-4.0"]),
        ("Licensed under CC BY-NC 3.0.", []),
        ("Released under the BSD License.", []),
        ("Released under the MIT License.\nReleased under the MIT License.", ["MIT", "MIT"]),
        ("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", ["CC-BY-NC-4.0", "CC-BY-4.0"]),
        (license_scan.TEMPLATES["BSD-3-Clause"][0], ["BSD-3-Clause"]),
        (license_scan.TEMPLATES["BSD-2-Clause"][0], ["BSD-2-Clause"]),
        (license_scan.TEMPLATES["LGPL-2.1"][1], ["LGPL-2.1"]),
        (" ".join(license_scan.TEMPLATES["Apache-2.0"][1].split()[:55]), ["Apache-2.0"]),
    ],
)
def test_licences_of_a_family_are_told_apart(text, names):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.ScanSettings())
    assert [x[0] for x in scanner.scan("Some words before. " + text + " And some behind it.")] == names


def test_every_template_is_itself():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.ScanSettings())
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            assert [(x[0], x[2]) for x in scanner.scan(t)] == [(name, 1.0)], t


def full_alignment(template, words, gap=-1, other=-1):
    """Best score of local alignment over the whole matrix."""
    above, best = [0] * (len(words) + 1), 0
    for t in template:
        row = [0]
        for j, w in enumerate(words):
            row.append(max(0, above[j] + (1 if t == w else other), above[j + 1] + gap, row[-1] + gap))
        best, above = max(best, *row), row
    return best


def test_banded_alignment_is_the_full_one():
    """Worn notices between foreign words: the band finds the best alignment of the whole matrix."""
    rng, settings = random.Random(4), license_scan.ScanSettings()
    scanner = license_scan.Scanner(license_scan.TEMPLATES, settings)
    for k, (name, template) in enumerate(scanner.templates * 3):
        worn = list(template)
        for _ in range(len(worn) // 12):
            at = rng.randrange(len(worn))
            worn[at : at + 1] = rng.choice([[], [b"other"], [worn[at], b"more"]])
        before = [b"x%d" % rng.randrange(50) for _ in range(rng.randrange(40))]
        words = before + worn + [b"y%d" % rng.randrange(50) for _ in range(20)]
        assert scanner.align(template, words, len(before), scanner.band_of(template))[0] == full_alignment(template, words), name


def test_winnowing_guarantee():
    words = [b"w%d" % (i * i % 37) for i in range(80)]
    kept = sorted(license_scan.winnowed(words))
    assert kept[0] < license_scan.WINDOW and all(b - a <= license_scan.WINDOW for a, b in zip(kept, kept[1:]))


URLS = [
    (1, "https://a.com/x"), (2, "https://EXAMPLE.com/en/1"), (3, "https://www.example.com/en/2?q#f"), (4, "http://b.net/es/3"), (5, "http://b.net/fr/4"),
    (6, "http://b.net/de/5"), (7, "no scheme"), (8, None), (9, "x://y"), (9, "x://y"), (None, "https://a.org?x=http://b.com/"), (10, "https://notexample.com/en/"), (11, "https://a.com"), (12, "ftp://Ünï.com/é\n/z"),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", 1, "p", "x") for i, u in rows], "page_id long, url string, html string, score int, plain string, host string")


def test_url_rules(spark):
    got = {r.page_id: r for r in url_filter.url_filter(pages(spark, URLS)).collect()}
    want = {1: ("com/", "allow"), 2: ("example.com/en/", "block"), 3: ("www.example.com/en/", "allow"), 4: ("net/es/", "block"), 5: ("net/fr/", "block"), 10: ("com/", "allow"), 12: ("com/", "allow")}
    for i, (rule, verdict) in want.items():
        assert (got[i].rule, got[i].verdict) == (rule, verdict)
    assert (got[2].host, got[2].path) == ("example.com", "/en/1") and (got[7].host, got[7].path) == (got[8].host, got[8].path) == ("", "")
    assert got[11].rule is None and (got[11].host, got[11].path) == ("a.com", "") and (got[None].host, got[None].path) == ("a.org", "")
    assert got[12].path == "/é\n/z" and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.url_filter(pages(spark, URLS)).count() == len(URLS)
    assert url_filter.url_filter(pages(spark, []).limit(0)).count() == 0


def slow_model(strings, order):
    """P(char | context) by interpolation, from a list of (string, weight)."""
    counts = [{} for _ in range(order + 1)]
    for s, n in strings:
        t = "^" * order + s + "$"
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k].setdefault(t[i - k : i], Counter())[t[i]] += n

    def p(context, char):
        out = 1 / url_filter.SYMBOLS
        for k in range(order + 1):
            seen = counts[k].get(context[order - k :])
            if seen:
                types = sum(v > 0 for v in seen.values())
                out = (seen[char] + types * out) / (sum(seen.values()) + types)
        return out

    return p


def test_url_scores_match_brute_force(spark):
    """Scores under models of all seeds, and the threshold from models without the held-out seeds."""
    rng = random.Random(9)
    rows = [(i, f"http://{rng.choice('abc')}{rng.choice('xyz')}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(30)}?q={rng.choice(['buy', 'read'])}") for i in range(300)]
    rows += [(900, "no scheme"), (901, None), (902, "http://z.org/" + "long/" * 2000)]
    got = url_filter.url_filter(pages(spark, rows)).collect()
    plain = {i: re.sub(f"[^{url_filter.PLAIN}]", "*", (u or "").lower()) for i, u in rows}
    all_of, train = ({"allow": Counter(), "block": Counter()} for _ in range(2))
    for r in got:
        if r.rule:
            all_of[r.verdict][plain[r.page_id]] += 1
            if zlib.crc32(plain[r.page_id].encode()) % url_filter.HELD_OUT:
                train[r.verdict][plain[r.page_id]] += 1

    def scorer(seeds):
        p, q = (slow_model(list(seeds[v].items()), url_filter.ORDER) for v in ("allow", "block"))

        def score(x):
            t = "^" * url_filter.ORDER + x + "$"
            return sum(log(p(t[i - 5 : i], t[i])) - log(q(t[i - 5 : i], t[i])) for i in range(5, len(t))) / (len(x) + 1)

        return score

    final, partial = scorer(all_of), scorer(train)
    held = {v: [partial(x) for x, n in all_of[v].items() if not zlib.crc32(x.encode()) % url_filter.HELD_OUT for _ in range(n)] for v in all_of}
    mean = {v: sum(x) / len(x) for v, x in held.items()}
    dev = {v: (sum((y - mean[v]) ** 2 for y in x) / len(x)) ** 0.5 for v, x in held.items()}
    cut = (mean["allow"] * dev["block"] + mean["block"] * dev["allow"]) / (dev["allow"] + dev["block"])
    free = [r for r in got if r.rule is None]
    assert len(free) > 50 and {r.page_id for r in free} >= {900, 901, 902}
    for r in free:
        assert abs(r.score / 1e6 - final(plain[r.page_id])) < 1e-4
        if abs(r.score / 1e6 - cut) > 0.01:
            assert (r.verdict == "allow") == (r.score / 1e6 > cut)
    two = [(1, "http://a.net/de/x?buy=1"), (2, "http://a.net/de/x?read=2")]
    mixed = [(i, u) for i, u in rows if i < 900] + two
    by_query = {r.page_id: r.score for r in url_filter.url_filter(pages(spark, [(10 + i, u) for i, u in mixed[:-2]] + two)).collect()}
    assert by_query[1] != by_query[2]


def test_long_urls_take_linear_time(spark):
    """A url of a million characters, whole."""
    import time

    from trailweave.llm import url_filter

    url = "https://a.org/" + "ab/c" * 250_000
    began = time.perf_counter()
    n = url_filter.grams(spark.createDataFrame([(url,)], "plain string")).agg(F.count("*"), F.first("gram"), F.last("gram")).first()
    assert n[0] == len(url) + 1 and n[1] == "^^^^^h" and n[2] == "/cab/c"[1:] + "$" and time.perf_counter() - began < 30


def test_many_notices_take_linear_time():
    import time

    from trailweave.llm.license_scan import TEMPLATES, Scanner, ScanSettings

    scanner, times = Scanner(TEMPLATES, ScanSettings()), []
    for n in (2_000, 50_000):
        began = time.perf_counter()
        found = scanner.scan("É. Released under the MIT License.\n" * n)
        times.append(time.perf_counter() - began)
        assert len(found) == n and found[-1][3:] == (len("É. Released under the MIT License.\n") * (n - 1) + 3, len("É. Released under the MIT License.\n") * n - 2)
    assert times[1] < 60 * times[0] + 1


def test_whole_scan_finds_what_full_alignment_of_every_template_finds(make):
    """Every template is put whole, cut and with changed words into prose; each is found once, where it stands."""
    import random

    from trailweave.llm.license_scan import TEMPLATES, license_scan, words_of

    rng, rows, want = random.Random(7), [], {}
    for k, (name, text) in enumerate((name, t) for name, texts in TEMPLATES.items() for t in texts):
        before, after = (" ".join(rng.choice(["river", "stone", "lake", "bird"]) for _ in range(rng.randrange(30))) for _ in range(2))
        rows.append((k, f"{before} {text}\n{after}"))
        want[k] = (name, len(words_of(text)))
    got = {}
    for r in license_scan(make(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.matched_words))
    assert {k: v for k, v in got.items()} == {k: [v] for k, v in want.items()}
