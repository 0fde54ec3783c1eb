"""From raw documents to packed training sequences.

Each stage calls one corpus operator, works on all that its predecessor kept and has its decisions take
effect: toxic documents go, then bad lines and documents of low quality, then all but one of equal texts, then
all but one of near copies; what is left is tokenised and packed. All stages but the last return the columns
of documents. Null texts count as empty, null and repeated ids are rows of their own, columns that a stage does
not use pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import exact_dedup, packing, quality, simhash_similar, toxicity
from trailweave.llm.common import remove, shared_folder, table
from trailweave.llm.queries import vocabulary


#: Packing comes last, in workers beside executors that have held all stages before it, so it remembers less.
PACKING_WORDS = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score under 0.5; a text without words has the score of the bias alone."""
    return toxicity.kept_rows(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass, without their bad lines, and with n_chars as it is then. Null and short texts go."""
    kept = quality.kept_rows(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return kept.withColumn("n_chars", F.length("text").cast(kind)) if kind else kept


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of equal rows one."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that overlap by 0.8 or more, directly or over others, the row with the least doc_id."""
    return simhash_similar.kept_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows; a text without tokens is its end id alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), most_words=PACKING_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each result is written to the shared folder and read again, so an
    executor's loss costs no finished stage; a result goes when the next one is there."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
