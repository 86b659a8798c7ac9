"""The registered queries op1 to op13 and the pipeline, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import conversations, decontamination, hard_negatives, html_text, language, language_model, media, mixing, near_duplicates, packing, pii, sharding, token_counts
from ripplegraph.llm.common import documents, written
from ripplegraph.llm.oracles import ORACLES


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.personal_data(documents(spark, sf_dir))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return got.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.text_image_features(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "payload_bytes", F.col("samples_sha256").alias("payload_sha256"), "tail_crc32", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored_by_pairs(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = language.identified(language.document_rows(documents(spark, sf_dir)))
    return got.select("doc_id", "declared", "language", "confidence", "kept")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = language.identified(language.page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return got.select("page_id", "declared", "suffix", "host", "language", "confidence", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mixed(documents(spark, sf_dir).select("doc_id", "source"))
    return got.select("doc_id", "name", "units", "block", "slot", "release", "due", "place")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, version = sharding.sharded(documents(spark, sf_dir))
    return sharding.read(spark, store, version).select("row.doc_id", F.col("shard").cast("bigint").alias("shard"), F.sha2("row.text", 256).alias("text_sha256"), F.lit(version).cast("bigint").alias("version"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = conversations.damaged(convs)
    audits = written(conversations.audited(rows), "conv-audits")
    got = audits.join(conversations.digests(rows, audits).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    every = convs.select(F.col("conv_id").alias("every")).distinct()
    whole = every.join(got, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(hard_negatives.relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.packed(documents(spark, sf_dir))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_media, op3_decontamination, op4_language_model, op5_language_id, language_id_pages, op6_token_counts, op7_mixing, op8_html_text, op9_sharding, op10_near_duplicates, op11_conversation_repair, op12_hard_negatives, op13_packing, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
