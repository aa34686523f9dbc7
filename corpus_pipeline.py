"""Pipeline from raw documents to sharded training text.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Between stages
the rows are written as Parquet to the shared folder and read again. All but the last stage return
the columns of ``documents``; the last adds shard and slot.

Null and empty texts pass through every stage that their score, draw and copies let them pass; a
null doc_id is never a copy of another document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.llm import decontaminate, histogram_shards, near_dedup, quality, raking
from lagwise.llm.columns import apart
from lagwise.llm.queries import fold, table
from lagwise.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), fold(3) != 1)
    own, restore = apart(docs, "_score")
    return restore(quality.scored(own, model, score="_score").where(F.col("_score") >= 0.5).drop("_score"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.without_copies(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked probabilities."""
    return raking.sampled(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard of eight and their slot in it."""
    return histogram_shards.shard_by_bytes(docs, shards=8)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontaminate", uncontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
