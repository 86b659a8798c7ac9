"""Sharding by size-tiered compaction.

A store holds immutable Parquet files, the shards, and manifests that name the live ones. Rows that are appended arrive as small shards, one
for each task that reads them. Compaction merges shards of a like size (a tier), again and again, until no tier has enough of them or a
merge would pass the target size: the merges are planned on the files' sizes alone, and only files that they move are rewritten, each
once and every new shard in a partition of its own. Files of far more than the target are split.

Every append and every compaction writes to a folder of a new name and takes effect by one rename of a manifest. Whatever stops before
that leaves the last version as it is, and the next attempt is free to go on; `vacuum` removes folders that no manifest names.

Rows keep their order: a shard is sorted by append, then by file and row where the appended rows were read from files, else by task and row.
Shards of a version are numbered from 0 in that order.

Cases: an empty table commits a manifest without new shards; null, empty, repeated and very long rows are kept as they are
(a document of more than the target size makes a shard over the target); extra columns of any name are stored too, for a
document is stored as one struct, `row`. All appends to a store have one schema; another raises ValueError."""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.llm.common import bounded_broadcast, new_folder

#: Bytes of a full shard; shards of one tier that call for a merge; bytes of the smallest tier.
TARGET_BYTES, FANOUT, UNIT_BYTES = 64 << 20, 4, 1 << 20
#: Files of a merge plan that may be broadcast (a name and three numbers each).
BROADCAST_ROWS = 500_000
MANIFEST = "file string, bytes bigint, rows bigint, first struct<batch: bigint, at: struct<file: string, index: bigint>>, shard bigint"
_KEY = "substring_index(_metadata.file_path, '/', -2)"


def _stored(docs: DataFrame) -> DataFrame:
    """row and at, the row's place: file and index. A task that reads several files puts their rows in order."""
    row = F.struct("*").alias("row")
    try:
        return docs.select(row, F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("index")).alias("at")).sortWithinPartitions("at")
    except AnalysisException:  # not a scan of files
        return docs.select(row, F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("index")).alias("at"))


def _listed(spark: SparkSession, store: str, folder: str) -> DataFrame:
    """The files of a data folder as manifest rows; only the places of their rows are read."""
    files = spark.read.parquet(f"{store}/data/{folder}").select(F.expr(_KEY).alias("file"), F.col("_metadata.file_size").alias("bytes"), F.struct("batch", "at").alias("first"))
    return files.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"), F.min("first").alias("first")).select("file", "bytes", "rows", "first")


def _schema(spark: SparkSession, store: str):
    """The schema of the store's rows; None for a new store."""
    fs, path = _fs(spark, store)
    for x in fs.listStatus(path(f"{store}/data")) if fs.exists(path(f"{store}/data")) else []:
        if fs.exists(path(f"{store}/data/{x.getPath().getName()}/_SUCCESS")):
            return spark.read.parquet(f"{store}/data/{x.getPath().getName()}").schema
    return None


def append(docs: DataFrame, store: str) -> int:
    """Add the rows of docs to the store, one shard for each task, and commit the next manifest; returns its version."""
    spark = docs.sparkSession
    before, known = versions(spark, store), _schema(spark, store)
    version, folder = (before or [0])[-1] + 1, uuid.uuid4().hex
    rows = _stored(docs).withColumn("batch", F.lit(version).cast("bigint"))
    if known is not None and known["row"].dataType.simpleString() != rows.schema["row"].dataType.simpleString():
        raise ValueError("the store holds rows of another schema")
    rows.write.option("compression", "zstd").parquet(f"{store}/data/{folder}")
    live = _listed(spark, store, folder)
    if before:
        live = manifest(spark, store, before[-1]).drop("shard").unionByName(live)
    commit(spark, store, version, live)
    return version


def merge_once(shards: DataFrame, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One round over (shard, bytes, members): in each tier with `fanout` shards or more, neighbours in the order of shards become one shard up to the target size.

    A tier is dealt into runs by its running sum of sizes; a run leaves room for the shard that crosses its end, so
    that no merge passes the target."""
    tier = F.when(F.col("bytes") * 2 > target, -1).otherwise(F.floor(F.log(float(fanout), F.greatest(F.col("bytes"), F.lit(UNIT_BYTES)) / F.lit(UNIT_BYTES)))).cast("int")
    in_tier = Window.partitionBy("tier")
    run = Window.partitionBy("tier").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.greatest(F.lit(1), F.lit(target) - F.max("bytes").over(in_tier))
    dealt = shards.withColumn("tier", tier).withColumn("many", F.count(F.lit(1)).over(in_tier)).withColumn("run", F.floor((F.sum("bytes").over(run) - F.col("bytes")) / room))
    alone = (F.col("tier") < 0) | (F.col("many") < fanout)
    dealt = dealt.withColumn("run", F.when(alone, F.col("shard").cast("bigint")).otherwise(F.col("run"))).withColumn("alone", alone)
    return dealt.groupBy("tier", "alone", "run").agg(F.min("shard").alias("shard"), F.sum("bytes").alias("bytes"), F.flatten(F.collect_list("members")).alias("members")).drop("tier", "alone", "run")


def merge_plan(shards: DataFrame, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """shard, into, many (the shards that go there) of (shard, bytes), after all rounds. The table has a row for each shard, none for a document."""
    now = shards.select("shard", "bytes", F.array("shard").alias("members"))
    for _ in range(1 + math.ceil(math.log(max(2, target / UNIT_BYTES), fanout))):
        now = merge_once(now, target, fanout)
    return now.select(F.explode("members").alias("shard"), F.col("shard").alias("into"), F.size("members").alias("many"))


def compact(spark: SparkSession, store: str, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
    """Merge what the tiers call for, split what is far over the target, and commit the next manifest; returns its version, or the last one where nothing is to be done."""
    last = versions(spark, store)[-1]
    live = manifest(spark, store, last)
    pieces = F.when(F.col("bytes") >= 2 * target, F.least(F.ceil(F.col("bytes") / target), F.col("rows"))).otherwise(1).cast("bigint")
    plan = live.join(merge_plan(live, target, fanout), "shard").withColumn("pieces", pieces).filter("many > 1 OR pieces > 1")
    # One row a shard from here: the new shards are numbered.
    new = plan.groupBy("into").agg(F.max("pieces").alias("wide"))
    new = new.withColumn("start", F.sum("wide").over(Window.orderBy("into")) - F.col("wide"))
    plan = plan.join(new, "into").select("file", "rows", "pieces", "start", "wide")
    folder = uuid.uuid4().hex
    plan.write.parquet(f"{store}/plans/{folder}")
    plan = spark.read.parquet(f"{store}/plans/{folder}")
    n = plan.agg(F.max(F.col("start") + F.col("wide"))).first()[0]
    if not n:
        return last
    files = [r["file"] for r in plan.select("file").collect()]
    rows = spark.read.schema(_schema(spark, store)).parquet(*(f"{store}/data/{f}" for f in files)).select("*", F.expr(_KEY).alias("file"), F.col("_metadata.row_index").alias("index"))
    moved = rows.join(bounded_broadcast(plan, BROADCAST_ROWS), "file")
    place = F.expr("cast(start + least(pieces - 1, index * pieces div rows) as int)")
    moved.select("row", "batch", "at", place.alias("to")).repartitionById(n, "to").sortWithinPartitions("batch", "at").drop("to").write.option("compression", "zstd").parquet(f"{store}/data/{folder}")
    kept = live.drop("shard").join(F.broadcast(plan.select("file")) if len(files) <= BROADCAST_ROWS else plan.select("file"), "file", "left_anti")
    commit(spark, store, last + 1, kept.unionByName(_listed(spark, store, folder)))
    return last + 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, store: str) -> list[int]:
    fs, path = _fs(spark, store)
    at = path(f"{store}/manifests")
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit())


def commit(spark: SparkSession, store: str, version: int, live: DataFrame) -> None:
    """Write the manifest under a name of its own, then rename it to its version: readers see all of it or none, and of two writers of a version one fails.

    A rename onto a folder that another has just made moves the draft into it; it is found there and taken away."""
    name = f".draft-{version}-{uuid.uuid4().hex}"
    draft, final = f"{store}/manifests/{name}", f"{store}/manifests/v{version}"
    # One row a shard.
    numbered = live.withColumn("shard", F.row_number().over(Window.orderBy("first", "file")).cast("bigint") - 1)
    numbered.coalesce(1).write.parquet(draft)
    fs, path = _fs(spark, store)
    done = not fs.exists(path(final)) and fs.rename(path(draft), path(final))
    if not done or fs.exists(path(f"{final}/{name}")):
        fs.delete(path(f"{final}/{name}"), True)
        fs.delete(path(draft), True)
        raise RuntimeError(f"version {version} is committed already")


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """file, bytes, rows, first (the place of its first row), shard of every live shard of the version, the last one by default."""
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests/v{version or versions(spark, store)[-1]}")


def read(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """row (a struct of the stored columns), batch and at (its place) and shard, from the files that the manifest names and no others."""
    live = manifest(spark, store, version).select("file", "shard")
    files = [r["file"] for r in live.collect()]
    schema = _schema(spark, store)
    if not files:
        return spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("bigint"))
    rows = spark.read.schema(schema).parquet(*(f"{store}/data/{f}" for f in files)).select("*", F.expr(_KEY).alias("file"))
    return rows.join(bounded_broadcast(live, BROADCAST_ROWS), "file").drop("file")


def vacuum(spark: SparkSession, store: str) -> list[str]:
    """Delete the data folders that no manifest names and return their names. Not to be run beside writers: what they have not committed is such a folder."""
    fs, path = _fs(spark, store)
    named = {r[0].split("/")[0] for v in versions(spark, store) for r in manifest(spark, store, v).select("file").collect()}
    gone = [x for x in sorted(s.getPath().getName() for s in fs.listStatus(path(f"{store}/data"))) if x not in named]
    for x in gone:
        fs.delete(path(f"{store}/data/{x}"), True)
    return gone


def sharded(docs: DataFrame, target: int = TARGET_BYTES, fanout: int = FANOUT) -> tuple[str, int]:
    """Append docs to a new store in the shared folder and compact it: the store's path and version."""
    spark = docs.sparkSession
    store = new_folder(spark, "shards")
    append(docs, store)
    return store, compact(spark, store, target, fanout)
