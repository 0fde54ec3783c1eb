import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trailweave.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 1000, 4099])
def test_permutation(n):
    assert sorted(sharding.permute(i, n, 7) for i in range(n)) == list(range(n))


def test_shards(make, odd):
    rows = odd * 3
    got = sharding.shard_rows(make(rows), 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.slot) == sharding.place(r.row_number, len(rows), 4, 20_240_601) and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == want
    again = sharding.shard_rows(make(rows, 7), 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard_rows(make([])).count() == 0


def test_a_row_that_makes_up_the_table(spark, monkeypatch):
    docs = spark.range(150_000).selectExpr("cast(1 as long) as doc_id", "'same' as text")
    got = sharding.shard_rows(docs)
    assert got.select("shard", "slot").distinct().count() == 150_000
    monkeypatch.setattr(sharding, "BLOCK", 1000)  # 150 blocks, dealt out by all tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = sharding.shard_rows(docs).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 75_000
