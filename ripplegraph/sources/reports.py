"""Test and coverage reports as tables. XML is read by Spark with explicit schemas; a file with an entity declaration is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PROBLEM = "array<struct<_type:string,_message:string,_VALUE:string>>"
_CASE = f"_classname string, _name string, _file string, _time string, failure {_PROBLEM}, error {_PROBLEM}, skipped array<struct<_message:string>>, flakyFailure {_PROBLEM}, flakyError {_PROBLEM}, rerunFailure {_PROBLEM}, rerunError {_PROBLEM}"
_PACKAGE = "_name string, sourcefile array<struct<_name:string,line:array<struct<_nr:int,_ci:bigint>>>>"
MOST_BYTES = 64 << 20


def refuse_entities(spark: SparkSession, path: str) -> None:
    """Raise where a file declares entities or is too large: both can make a small report cost any amount of work."""
    bad = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter((F.col("length") > MOST_BYTES) | F.decode("content", "UTF-8").contains("<!ENTITY")).select("path").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['path']} is too large or declares entities")


def milliseconds(seconds: str) -> Column:
    """Seconds as whole milliseconds; 0 for what is no finite number of at least 0."""
    x = F.expr(f"try_cast({seconds} as double)")
    return F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")), 0).otherwise(F.round(x * 1000)).cast("bigint")


def junit(spark: SparkSession, path: str) -> DataFrame:
    """source, classname, name, file, duration_ms, outcome, failed_attempts, failure_fingerprint of every test case."""
    refuse_entities(spark, path)
    rows = spark.read.format("xml").option("rowTag", "testcase").option("recursiveFileLookup", True).schema(_CASE).load(path).withColumn("source", F.col("_metadata.file_path"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    has = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    outcome = F.when(has("failure"), "FAILED").when(has("error"), "ERROR").when(F.col("skipped").isNotNull(), "SKIPPED").otherwise("PASSED")
    problem = F.when(has("failure"), F.col("failure")[0]).when(has("error"), F.col("error")[0])
    text = F.coalesce(problem["_message"], problem["_VALUE"], F.lit(""))
    print_ = F.when(problem.isNotNull(), F.substring(F.concat(F.coalesce(problem["_type"], F.lit("")), F.lit(": "), F.element_at(F.split(text, "\n"), 1)), 1, 200))
    attempts = n("flakyFailure") + n("flakyError") + n("rerunFailure") + n("rerunError")
    return rows.select("source", F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("_file").alias("file"), milliseconds("_time").alias("duration_ms"), outcome.alias("outcome"), attempts.cast("int").alias("failed_attempts"), print_.alias("failure_fingerprint"))


def jacoco(spark: SparkSession, path: str) -> DataFrame:
    """report, path, line, hit of every line; a file without lines has one row without a line."""
    refuse_entities(spark, path)
    rows = spark.read.format("xml").option("rowTag", "package").option("recursiveFileLookup", True).schema(_PACKAGE).load(path).withColumn("report", F.col("_metadata.file_path"))
    files = rows.select("report", "_name", F.explode("sourcefile").alias("s"))
    name = F.when(F.coalesce(F.col("_name"), F.lit("")) == "", F.col("s._name")).otherwise(F.concat_ws("/", "_name", "s._name"))
    lines = files.select("report", name.alias("path"), F.explode_outer("s.line").alias("l")).select("report", "path", F.col("l._nr").alias("line"), (F.col("l._ci") > 0).alias("hit"))
    return lines.groupBy("report", "path", "line").agg(F.bool_or("hit").alias("hit"))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """report, test, path, line, hit. A record's lines follow its SF line: the running last of TN and SF over a file's lines gives each line its record.

    Raises for a DA line outside a record, and for a record without an end."""
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("report"), F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
    w = Window.partitionBy("report").orderBy("at")
    field = lambda tag: F.when(F.col("text").startswith(tag), F.substring("text", len(tag) + 1, 1 << 30))
    end = F.col("text") == "end_of_record"
    # A record's number: how many have ended before.
    r = lines.withColumn("record", F.sum(F.when(end, 1).otherwise(0)).over(w) - F.when(end, 1).otherwise(0))
    inside = Window.partitionBy("report", "record").orderBy("at")
    r = r.withColumn("path", F.last(field("SF:"), ignorenulls=True).over(inside)).withColumn("test", F.last(field("TN:"), ignorenulls=True).over(inside)).withColumn("ended", F.max(F.when(end, 1).otherwise(0)).over(Window.partitionBy("report", "record")))
    da = F.split(field("DA:"), ",")
    hits = r.filter(F.col("text").startswith("DA:")).select("report", F.when(F.col("test") != "", F.col("test")).alias("test"), "path", "ended", da[0].cast("int").alias("line"), (da[1].cast("double") > 0).alias("hit"))
    checked = hits.withColumn("path", F.when(F.col("path").isNotNull() & (F.col("ended") == 1), F.replace("path", F.lit("\\"), F.lit("/"))).otherwise(F.raise_error(F.concat(F.lit("a DA line outside a whole record in "), "report"))))
    return checked.groupBy("report", "test", "path", "line").agg(F.bool_or("hit").alias("hit"))
