"""Test runs that keep arriving: appended by micro-batch, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_batch(batch: DataFrame, batch_id: int, store: str) -> None:
    """Write a batch under its number: a batch that is run again replaces itself."""
    batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{store}/results/batch={batch_id}")


def ingest(spark: SparkSession, source: str, schema: str, store: str) -> StreamingQuery:
    """Append the Parquet files that appear in source to the store's results, until all that is there is read."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, i: append_batch(df.select("*"), i, store)).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()


def results(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/results").drop("batch")
