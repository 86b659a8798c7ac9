"""Snapshot folders as tables of files. The content is read only of files that are source code and small enough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import paths

MOST_BYTES = 1 << 20


def files(spark: SparkSession, root: str, most: int = MOST_BYTES) -> DataFrame:
    """path, language, status, size, blob, text of every file below root.

    status: INDEXED, UNSUPPORTED (no source language), EXCLUDED (dependencies, bundles), TOO_LARGE, BINARY, or INVALID_PATH with its reason in
    `reason`. The blob is the content's hash, of a file that is too large to be read its size and time."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    path = F.expr("substring(p, instr(p, b) + length(b))")
    f = raw.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("p"), base.alias("b"), "length", F.col("modificationTime").alias("modified"), "content").withColumn("path", path)
    f = f.withColumn("reason", paths.rejection("path")).withColumn("language", paths.language("path"))
    readable = F.col("reason").isNull() & F.col("language").isNotNull() & ~paths.excluded("path") & (F.col("length") <= most)
    text = F.when(readable, F.try_validate_utf8(F.col("content").cast("string")))
    f = f.withColumn("text", F.when(~F.contains(text, F.lit("\u0000")), text)).withColumn("blob", F.when(F.col("length") <= most, F.sha2("content", 256)).otherwise(F.concat(F.lit("size:"), F.col("length").cast("string"), F.lit(":"), F.unix_micros("modified").cast("string"))))
    status = F.when(F.col("reason").isNotNull(), "INVALID_PATH").when(paths.excluded("path"), "EXCLUDED").when(F.col("language").isNull(), "UNSUPPORTED").when(F.col("length") > most, "TOO_LARGE").when(F.col("text").isNull(), "BINARY").otherwise("INDEXED")
    return f.select("path", "language", status.alias("status"), F.col("length").alias("size"), "reason", "blob", "text")


def one_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """The one file, without listing the others."""
    return spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}").select(F.lit(path).alias("path"), F.col("length").alias("size"), "content")
