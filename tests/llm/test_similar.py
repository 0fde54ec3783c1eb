import random
import time

import numpy as np
import pyarrow as pa

from trailweave.llm import common
from trailweave.llm import simhash_similar as similar
from trailweave.llm.common import GATHERED, gathered
from trailweave.llm.components import components, joining
from trailweave.operators.common import CLEAN_UP


def test_groups_match_brute_force(make, odd):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    rows = [(100 + i, " ".join(rng.choice(words) for _ in range(300))) for i in range(40)]
    for i in range(40):
        copy = rows[i][1].split()
        for _ in range(1 + i % 12):  # from close copies to ones below the threshold
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((200 + i, " ".join(copy)))
    expected = brute_groups(rows)
    assert len(set(expected.values())) > 50 and sum(expected[200 + i] == 100 + i for i in range(40)) > 10
    rows += [r for r in odd if r[0] not in (None, 4)] + [odd[3]]
    got = {r.doc_id: r.component_id for r in similar.similar_dedup(make(rows)).collect()}
    assert {i: got[i] for i in expected} == expected and set(got) == {i for i, _ in rows}
    assert got[5] == got[4] == 4 and got[2] == got[1] == 1 and got[3] == 3
    kept = similar.kept_rows(make(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))


def test_a_large_group_gives_few_pairs(make, monkeypatch):
    """2,000 near copies of one text: compared pairs stay in proportion to the texts, and one row stays."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(2000):
        copy = list(base)
        for _ in range(i % 3):
            copy[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    compared, overlapping = [], similar.overlapping
    monkeypatch.setattr(similar, "overlapping", lambda docs, pairs, least: (compared.append(pairs.count()), overlapping(docs, pairs, least))[1])
    got = {r.component_id for r in similar.similar_dedup(make(rows)).collect()}
    assert got == {0} and sum(compared) < 4 * len(rows)


def test_dense_buckets_are_compared_whole(make, monkeypatch):
    """Near copies whose buckets stay mixed, with bitmaps from the first round on and few members at a time."""
    monkeypatch.setattr(similar, "DENSE", 1)
    monkeypatch.setattr(similar, "MOST_FIRSTS", 16)
    monkeypatch.setattr(similar, "BUCKET_PART", 20)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for k, at in enumerate(rng.sample(range(0, 200, 6), rng.randrange(7))):
            copy[at] = f"x{i % 40 if k % 2 else i}y{k}"
        rows.append((i, " ".join(copy)))
    expected = brute_groups(rows)
    assert len(set(expected.values())) > 1
    assert {r.doc_id: r.component_id for r in similar.similar_dedup(make(rows)).collect()} == expected


def test_bitmaps_bound_the_overlap(make, spark):
    rng = random.Random(10)
    sets = [np.unique(np.array([rng.getrandbits(63) for _ in range(n)])) for n in (1, 5, 60, 100, 119)]
    sets += [np.unique(np.r_[s, np.array([rng.getrandbits(63) for _ in range(3)])]) for s in sets]
    rows = [(k, len(s), similar.bitmap(s).tolist()) for k, s in enumerate(sets)]
    texts = spark.createDataFrame(rows, "t long, n long, bm array<long>")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    near = {(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    got = {tuple(r) for r in similar.possible(spark.createDataFrame(pairs, "a long, b long"), texts, 0.8).collect()}
    assert near <= got and len(near) == 3 and len(got) < 8


def test_odd_rows(make, odd):
    docs = make(odd)
    assert similar.similar_dedup(docs).count() == len(odd)
    kept = similar.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() <= len(odd)
    assert similar.similar_dedup(make([])).count() == similar.kept_rows(make([])).count() == 0


def brute_groups(rows):
    """The least id of each text's component over all pairs that overlap by 0.8 or more."""
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    return root


def test_copies_like_the_original_but_not_each_other(make):
    """Hundreds of copies at 0.82 to 0.86 like the original, most pairs of copies below 0.8."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(900, " ".join(base))]
    for i in range(200):
        copy = list(base)
        for k, at in enumerate(rng.sample(range(0, 400, 6), 7 + i % 2)):
            copy[at] = f"x{i}y{k}"
        rows.append((i, " ".join(copy)))
    expected = brute_groups(rows)
    assert set(expected.values()) == {0}
    assert {r.doc_id: r.component_id for r in similar.similar_dedup(make(rows)).collect()} == expected


def test_copies_by_cutting_and_repeating(make):
    """Texts against their first part (overlap 0.8 to 0.9) and against themselves with one line many times."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        body = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows += [(i, " ".join(body)), (1000 + i, " ".join(body[: 242 + i % 30]))]
        rows.append((2000 + i, " ".join(body + body[10:20] * 100)))
    expected = brute_groups(rows)
    assert all(expected[k + i] == i for i in range(60) for k in (1000, 2000))
    assert {r.doc_id: r.component_id for r in similar.similar_dedup(make(rows)).collect()} == expected


def test_cells_compare_all_pairs(spark, monkeypatch):
    """Sets dealt over many cells give what whole sets give, also where two buckets name texts alike."""
    monkeypatch.setattr(similar, "CELL", 100)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:k] + ["x"] * (k % 3) + words[k + k % 5 :]) for k in range(24)]
    ids, sets = similar.text_ids(pa.array(texts)), similar.shingle_ids(pa.array(texts), similar.WIDTH)
    known = {t: set(s.tolist()) for t, s in zip(ids, sets)}
    pairs = [(a, b, (a ^ b) % 3) for a in known for b in known if a < b]
    want = {(a, b) for a, b, _ in pairs if len(known[a] & known[b]) >= 0.8 * len(known[a] | known[b])}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = spark.createDataFrame(pairs, "a long, b long, tok long")
    got = [tuple(r) for r in similar.overlapping(docs, rows, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(pairs)


def test_steps_leave_no_shuffle_files(make, spark):
    """Files of a step's shuffles go with the step, not when the driver collects its garbage."""

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {x for x in (blocks.apply(k).toString() for k in range(blocks.size())) if x.startswith("shuffle_")}

    words = [f"w{k}" for k in range(90)]
    docs = make([(k, " ".join(words[k : k + 40])) for k in range(50)])
    setting, before = spark.conf.get(CLEAN_UP), shuffled()
    got = similar.similar_dedup(docs)
    for _ in range(100):  # they go in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(CLEAN_UP) == setting
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups([(k, " ".join(words[k : k + 40])) for k in range(50)])


def test_few_rows_are_gathered(spark):
    rows = spark.range(0, 1000, 1, 40)
    assert gathered(rows).rdd.getNumPartitions() == 1 and gathered(rows.where("id < 0")).count() == 0
    many = gathered(spark.range(0, 2 * GATHERED + 1, 1, 40))
    assert many.rdd.getNumPartitions() == 3 and many.agg({"id": "sum"}).first()[0] == GATHERED * (2 * GATHERED + 1)


def test_few_rows_are_written_in_few_files(spark, monkeypatch):
    """Each file of a local folder costs its executor two processes, each for a moment as large as the executor."""
    files, settle = [], common.settle

    def seen(df):
        out = settle(df)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(common, "settle", seen)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(200).selectExpr("id as a", "id + 200 as b")
        assert {r.label for r in components(edges, 200).collect()} == set(range(200))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 2 and max(files) == 1


def test_a_task_passes_pairs_on_before_it_has_many(monkeypatch):
    t, bits = np.arange(30), np.zeros((30, 2), np.uint64)
    block = (t, np.full(30, 10), np.zeros(30, np.int64), t, bits)
    whole = similar.near_in_blocks(block, block, 0.8)
    monkeypatch.setattr(similar, "PAIRS_HELD", 50)
    turns = list(similar.near_in_turn(block, block, 0.8))
    assert len(whole) == 30 * 29 and np.array_equal(np.concatenate(turns), whole) and max(map(len, turns)) < 50 + 30


def test_a_task_gives_fewer_links_than_it_has_texts(spark):
    """All 1,225 pairs of a group and a chain beside it: the same components by 49 and 9 links."""
    pairs = [(i, j) for i in range(50) for j in range(i)] + [(100 + k, 101 + k) for k in range(9)]
    few = joining(spark.createDataFrame(pairs, "a long, b long").coalesce(1))
    found = {tuple(r) for r in few.collect()}
    assert found <= set(pairs) and len(found) == 49 + 9
    assert {r.node: r.label for r in components(few).collect()} == {k: 0 for k in range(50)} | {100 + k: 100 for k in range(10)}


def test_a_pair_is_named_in_its_first_bucket_alone():
    t, bits = np.arange(20), np.zeros((20, 2), np.uint64)
    toks = [np.array([5, 9, 2] if k % 2 else [9, 2]) for k in range(20)]
    block = (t, np.full(20, 10), np.zeros(20, np.int64), t, bits, toks)
    named = {tok: {tuple(p) for near in similar.near_in_turn(block, block, 0.8, tok) for p in near.tolist()} for tok in (9, 2)}
    odd = {(i, j) for i, j in named[9] if i % 2 and j % 2}
    assert not odd and not named[2] and len(named[9]) == 190 - 45
