"""The shared folder of a session, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine, a temporary folder; on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ripplegraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows, else as it is (a shuffled join); no more rows than that are counted."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def placed(df: DataFrame, order: list[Column], place: str, group: list[str] | None = None) -> DataFrame:
    """df with place, the row's number from 1 in the order (a total one), within its group if there is one.

    The rows are sorted by range: no task sees more than its range, however large a group is; only numbers of rows are summed up."""
    group = group or []
    keys = [f"_g{i}" for i in range(len(group))]
    sorted_ = df.repartitionByRange(*(F.col(c) for c in group), *order)
    parts = written(sorted_.withColumn("_part", F.spark_partition_id()), "ranges")
    before = parts.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n"))
    before = before.select(F.col("_part").alias("_p"), "_before", *(F.col(c).alias(k) for c, k in zip(group, keys, strict=True)))
    on = F.col("_part") == F.col("_p")
    for c, k in zip(group, keys, strict=True):
        on &= F.col(c).eqNullSafe(F.col(k))
    own = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    return parts.withColumn("_own", own).join(before, on).withColumn(place, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_part", "_p", "_own", "_before", *keys)
