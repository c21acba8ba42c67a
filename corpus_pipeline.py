"""The corpus pipeline: five stages from ``documents`` to sharded training rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``.

1. toxicity: the classifier chain is fitted on the labelled rows; documents at or
   over the threshold go.
2. near_duplicates: of each component of texts with 5-word shingle Jaccard of
   0.75 or more, the document with the smallest id stays.
3. decontamination: documents that contain a benchmark window go.
4. mixture: every document stays; sources under the share that the temperature
   gives them are repeated, at most MAX_REPEATS times.
5. sharding: every row gets its virtual slot and its shard of SHARDS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import decontaminate, jaccard, mixture, shards, toxicity
from claimloom.llm.queries import CATEGORIES, table, toxicity_labels
from claimloom.session import scratch_path

MAX_REPEATS = 2.0
SHARDS = 8


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit(docs, toxicity_labels(spark, sf_dir), CATEGORIES)
    return toxicity.keep_clean(docs, chain, "toxic")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_component(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs, max_repeats=MAX_REPEATS, ordered=False).select(*docs.columns)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.assign(docs, shards.balanced_map(docs, SHARDS))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixture", mix_sources),
    ("sharding", put_into_shards),
]

#: SQL cannot fit the chain of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
