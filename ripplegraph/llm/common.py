"""What the operators share: the shared folder, written intermediate tables, sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a session on one machine (tests) gets a temporary folder; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ripplegraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows; reads no more than it must to tell."""
    return df.limit(most_rows + 1).count() <= most_rows


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if its row count is within the bound, else df as it is (a shuffled join)."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the greatest counts, no more than `most`; counts are cut at a twentieth of an e-fold, so rows of like counts stay or go together.

    A small histogram finds the cut: no task sends its own top rows anywhere, as a sort with a limit would."""
    level = F.floor(F.log(F.col(count).cast("double")) * 20).cast("bigint")
    cut, rows = None, 0
    for r in sorted(df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r["level"]):
        rows += r["rows"]
        if rows > most:
            break
        cut = r["level"]
    return df.filter(level >= cut) if cut is not None else df.limit(0)
