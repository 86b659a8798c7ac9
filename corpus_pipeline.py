"""A training corpus from documents: languages told, near-duplicates and benchmark passages out, sources mixed, shards written.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns a DataFrame with the columns of
documents; the last returns each document's shard.

Cases, the same in all stages: extra columns are carried along; an empty table gives an empty one; very long texts are read whole; rows that
repeat, or share an id, or have none, go or stay by their own texts and never with another row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import decontamination, language, mixing, near_duplicates, sharding
from ripplegraph.llm.common import documents, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stays unknown go: null, empty and blank texts, and texts without letters among them. A null language or source is no evidence."""
    return language.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays; rows that share an id go by their own texts; texts without words and rows without an id are linked with nothing and stay."""
    return near_duplicates.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go; null and empty texts hold none, and an empty benchmark takes nothing away."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their slots: files in the order of their names, rows in the order of their places. A null source is a source of its own."""
    return mixing.in_mixed_order(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stored in compacted shards, each in the order of the mix: doc_id, source, shard and the manifest's version."""
    store, version = sharding.sharded(docs)
    return sharding.read(spark, store, version).select("row.doc_id", "row.source", F.col("shard").cast("bigint").alias("shard"), F.lit(version).cast("bigint").alias("version"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The stages have no SQL form (fitted likelihoods, components, a schedule); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
