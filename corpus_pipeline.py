"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. Nulls, empty texts and repeated rows go through every stage as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm import decontam, mixing, nearcopies, quality, sharding, simhash
from keytide.llm.shared import remove_table, saved, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those linked by 5-gram similarities of 0.8 or more."""
    return simhash.keep_one(docs, nearcopies.near_copies)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whether the item has an id or not."""
    items = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("item_id"), "text")
    return decontam.clean(docs, items)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes at least once, those of small sources again up to the repetition limit."""
    return mixing.mixed(docs).select(docs.columns)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", stage_quality),
    ("simhash near-dedup", stage_simhash),
    ("benchmark decontamination", stage_decontaminate),
    ("temperature mixing", stage_mix),
    ("hash tree sharding", stage_shard),
]

#: SQL can express neither the classifier nor the components; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written goes when the next one has."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{i}")
        if i:
            remove_table(before)
    return docs
