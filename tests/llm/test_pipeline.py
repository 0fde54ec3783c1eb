import os

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from trailweave.llm import exact_dedup, quality, simhash, toxicity
from trailweave.llm.queries import vocabulary

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="demonstration tables are absent")
def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    toxic = toxicity.toxicity(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1")
    left = {i: t for i, t in rows.items() if i not in {r.doc_id for r in toxic.collect()}}
    judged = {i: quality.judge(t, quality.LineRules()) for i, t in left.items()}
    left = {i: x["cleaned"] for i, x in judged.items() if x["kept"]}
    best = {}
    for i, t in left.items():
        key = t.encode().lower()
        best[key] = max(i, best.get(key, i))
    left = {i: left[i] for i in best.values()}
    got = corpus_pipeline.run(spark, DIR).collect()
    kept = {r.doc_id for r in got}
    assert kept <= set(left)
    words = {i: t.encode().lower().split() for i, t in left.items()}
    shingles = {i: set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} for i, w in words.items()}
    alike = lambda i, k: len(shingles[i] & shingles[k]) >= 0.8 * len(shingles[i] | shingles[k])
    root = {i: i for i in left}
    for i in left:
        for k in left:
            if i < k and root[i] != root[k] and alike(i, k):
                lo, hi = sorted((root[i], root[k]))
                root = {x: lo if r == hi else r for x, r in root.items()}
    assert kept == set(root.values())  # one document of each group, the one with the least id
    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for i in kept:
        assert sum(r.length for r in got if r.doc_id == i) == len(tokenizer.encode(left[i], add_special_tokens=False).ids) + 1


def test_stages_keep_columns_and_odd_rows(spark, make, odd, tmp_path):
    spark.createDataFrame([(4, 1, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert exact_dedup.kept_rows(make(odd)).count() >= simhash.kept_rows(make(odd)).count()
