import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from trailweave.llm import bits, exact_dedup, line_dedup, simhash
from trailweave.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOWER)


def test_exact_matches_brute_force(make, odd):
    got = exact_dedup.exact_dedup(make(odd)).collect()
    groups = defaultdict(list)
    for i, t in odd:
        groups[low(t)].append(i)
    assert len(got) == len(odd)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_kept_rows(make, odd):
    docs = make(odd)
    got = exact_dedup.kept_rows(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(low(r.text) for r in rows) == sorted({low(t) for _, t in odd}) and all(r.digest == "x" for r in rows)
    assert exact_dedup.kept_rows(make([])).count() == exact_dedup.exact_dedup(make([])).count() == 0


def test_exact_with_full_filters(make, odd, monkeypatch):
    """Filters so small that nearly all rows pass: the joins behind must give the same."""
    rows = odd + [(500 + i, f"text {i % 7}") for i in range(40)] + [(600 + i, f"own {i}") for i in range(40)]
    want = sorted(map(str, exact_dedup.exact_dedup(make(rows)).collect())), sorted(map(str, exact_dedup.kept_rows(make(rows)).collect()))
    monkeypatch.setattr(bits, "LEAST_LOG", 5)
    monkeypatch.setattr(bits, "MOST_LOG", 5)
    got = sorted(map(str, exact_dedup.exact_dedup(make(rows)).collect())), sorted(map(str, exact_dedup.kept_rows(make(rows)).collect()))
    assert got == want


def shuffled_columns(df):
    """Output columns of every shuffle in a plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan)


def test_exact_shuffles_no_texts(spark, odd):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.createDataFrame([r for r in odd if r[0] not in (None, 4)], "doc_id long, text string")
        asked = shuffled_columns(exact_dedup.exact_dedup(docs))
        assert asked and not any(re.search(r"\btext#", x) for x in asked)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(points):
    """least id of each connected point, from all pairs"""
    fps = sorted(set(points.values()))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in points.items():
        least[find(f)] = min(d, least.get(find(f), d))
    return {d: least[find(f)] for d, f in points.items()}


def test_simhash_matches_brute_force(make, odd):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400])))) for i in range(40)]
    for i in range(40):
        text = rows[i][1].split()
        text[rng.randrange(len(text))] = "changed"
        rows.append((200 + i, " ".join(text)))
    rows += [(i, t) for i, t in odd if i is not None and i != 4] + [(4, odd[3][1])]
    got = {r.doc_id: r for r in simhash.simhash_dedup(make(rows)).collect()}
    points = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(points)
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == points
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.kept_rows(make(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))


def test_simhash_odd_rows(make, odd):
    rows = simhash.simhash_dedup(make(odd)).collect()
    assert len(rows) == len(odd)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert simhash.simhash_dedup(make([])).count() == simhash.kept_rows(make([])).count() == 0
    assert simhash.kept_rows(make(odd)).columns == make(odd).columns


def test_covering_links_all_near_points(spark):
    """Dense clouds of points: links must connect exactly what all pairs connect."""
    rng = random.Random(1)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        cloud = [centre]
        for _ in range(60):
            x = rng.choice(cloud)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
            cloud.append(x)
        fps.update(cloud)
    fps.update({0, 1 << 63, (1 << 64) - 1})
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).repartition(3)
    pairs = [(signed[a], signed[b]) for a, b in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    label = {signed[r.node]: signed[r.label] for r in components(links).collect()}
    want = slow_components({f: f for f in fps})
    mine, theirs = defaultdict(set), defaultdict(set)
    for f in fps:
        mine[label.get(f, f)].add(f)
        theirs[want[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long").repartition(5)
    labels = dict(map(tuple, components(edges).collect()))
    assert {labels[i] for i in range(201)} == {0} and labels[901] == 900


PASSAGE = ["One repeated line of the passage.", "Another line that comes with it.", "And a third one to end it.", "Then a fourth for good measure.", "Fifth and last of all."]


def slow_chunks(lines):
    """Chunks by their definition, written anew: a cut behind line i where its and its forerunner's hashes say so."""
    h = [xxhash.xxh64(x.encode()).intdigest() for x in lines]
    ends = []
    for i in range(len(lines)):
        both = ((h[i - 1] * 0x9E3779B97F4A7C15 if i else 0) + h[i]) % 2**64
        if both // 2**32 % 4 < 3 or i - (ends[-1] if ends else 0) + 1 == 64:
            ends.append(i + 1)
    return list(zip([0, *ends], [*ends, len(lines)]))


def has_words(line):
    return bool(line.strip(" \t\n\r\x0b\x0c"))


def line_oracle(rows):
    """Lines that go, by id and text, over dictionaries of texts: by the definition of chunks."""
    places = sorted({(i, xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63), t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    first, gone = {}, defaultdict(set)
    for i, _, t in places:
        lines = t.split("\n")
        for lo, end in slow_chunks(lines):
            two = [k for k in range(end) if has_words(lines[k])][-2:]
            if len(two) < 2 or two[1] < lo:
                continue
            start, end = two[0], two[1] + 1
            body = tuple(lines[start:end])
            if body not in first:
                first[body] = (lines, start, end)
                continue
            theirs, s, e = first[body]
            up = down = 0
            while up < 8 and up < min(s, start) and theirs[s - up - 1] == lines[start - up - 1]:
                up += 1
            while down < 8 and end + down < len(lines) and e + down < len(theirs) and theirs[e + down] == lines[end + down]:
                down += 1
            gone[i, t].update(range(start - up, end + down))
    return gone


def stands_elsewhere(rows, doc, line):
    """Plain search: the line lies in a run of two lines with words, blank ones between them at most, that stands at
    another place as well."""
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    lines = next(x for i, x in texts if i == doc)
    for a in range(line + 1):
        if not has_words(lines[a]):
            continue
        b = next((k for k in range(a + 1, len(lines)) if has_words(lines[k])), None)
        if b is None or b < line:
            continue
        if sum(x[k : k + b - a + 1] == lines[a : b + 1] for _, x in texts for k in range(len(x))) > 1:
            return True
    return False


def test_lone_repeats_beside_each_other_stay(make):
    """One document has x, one has y, many have both, in lines of their own or as a passage."""
    rows = []
    for k in range(60):
        x, y = f"the line x of {k} stands here", f"and this is line y of {k}"
        rows += [(3 * k, f"a{k} own\n{x}\nb{k} own"), (3 * k + 1, f"c{k} own\n{y}\nd{k} own"), (3 * k + 2, f"e{k} own\n{x}\n{y}\nf{k} own")]
    assert sum(r.n_removed_lines for r in line_dedup.line_dedup(make(rows)).collect()) == 0


def test_line_chunks_match_brute_force(make, odd):
    rng = random.Random(3)
    rows = list(odd)
    for i in range(40):
        own = [f"Own line {i} {k} of this very text." if k % 4 else "" for k in range(rng.randrange(1, 9))]
        at = rng.randrange(len(own) + 1)
        rows.append((50 + i, "\n".join(own[:at] + PASSAGE[: 2 + i % 4] + own[at:])))
    long = " ".join(f"word{k}" for k in range(60))
    rows += [(190, f"Start of it.\n{long}\nEnd."), (191, f"Something else.\n{long}"), (192, "\n".join(["same"] * 300)), (193, "\n".join(PASSAGE * 3))]
    gone = line_oracle(rows)
    got = line_dedup.line_dedup(make(rows)).collect()
    assert len(got) == len(rows)
    clean = {r.doc_id: r.text for r in line_dedup.cleaned(make(rows)).collect()}
    texts = {i: t or "" for i, t in rows}
    for r in got:
        if r.doc_id is not None:
            lines, lost = texts[r.doc_id].split("\n"), gone.get((r.doc_id, texts[r.doc_id]), set())
            told = {x for span in (r.removed_lines or "").split(",") if span for x in range(int(span.split("-")[0]), int(span.split("-")[-1]) + 1)}
            assert told == lost and r.n_removed_lines == len(lost) and r.n_removed_words == sum(len(lines[k].split()) for k in lost), r
            assert (clean[r.doc_id] or "") == "\n".join(x for k, x in enumerate(lines) if k not in lost)
            assert all(stands_elsewhere(rows, r.doc_id, k) for k in lost if has_words(lines[k]))
    assert sum(r.n_removed_lines for r in got) > 80 and clean[191] == rows[-3][1]  # a line on its own stays
    assert line_dedup.line_dedup(make([])).count() == line_dedup.cleaned(make([])).count() == 0


def test_share_of_passages_found(make):
    """Passages of three to ten lines, each in two documents of foreign lines: the second copy goes whole if any of
    its chunks lies inside the passage."""
    rng, rows, where = random.Random(8), [], {}
    for k in range(400):
        n = (3, 5, 10)[k % 3]
        passage = [f"passage {k} line {x} " + " ".join(f"w{rng.randrange(9999)}" for _ in range(12)) for x in range(n)]
        for copy in range(2):
            own = [f"own {k} {copy} {x} {rng.random()}" for x in range(8)]
            rows.append((2 * k + copy, "\n".join(own[:4] + passage + own[4:])))
        where[2 * k + 1] = n
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.line_dedup(make(rows)).collect()}
    whole = {n: sum(got[i] == n for i, m in where.items() if m == n) / sum(m == n for m in where.values()) for n in (3, 5, 10)}
    print(whole)
    assert sum(n for i, n in got.items() if i % 2 == 0) == 0 and all(got[i] in (0, n) for i, n in where.items())
    assert whole[3] >= 0.9 and whole[5] > 0.97 and whole[10] > 0.99, whole


def test_chunks_are_shift_resistant():
    body = [f"line number {i} here" for i in range(200)]
    cuts = {tuple(body[s:e]) for s, e in line_dedup.chunks(body)}
    moved = {tuple((["new"] + body)[s:e]) for s, e in line_dedup.chunks(["new"] + body)}
    assert len(cuts & moved) >= len(cuts) - 2
    assert max(e - s for s, e in line_dedup.chunks(["same"] * 1000)) <= line_dedup.MOST_LINES


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_fingerprint_of_short_texts(n):
    text = " ".join("ab cd ef gh ij".split()[:n])
    assert simhash.fingerprint(text, 3) & (1 << 64) - 1 == slow_fingerprint(text)
    assert np.int64(simhash.fingerprint(text, 3)) is not None
