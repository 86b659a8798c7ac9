"""Past changes to be replayed: a JSON file of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CASES = 10_000


def cases(spark: SparkSession, path: str) -> DataFrame:
    """name (base..head where it is not given), base, head, junit (paths). Raises for a file that is no list of cases, or has more than MOST_CASES."""
    one = "name string, base string, head string, junit array<string>"
    rows = spark.read.schema(f"cases array<struct<{one.replace(' string', ': string').replace(' array', ': array')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    found = rows.select(F.explode("cases").alias("c")).select(F.coalesce("c.name", F.concat("c.base", F.lit(".."), "c.head")).alias("name"), "c.base", "c.head", F.coalesce("c.junit", F.array().cast("array<string>")).alias("junit"))
    n, bad = found.agg(F.count(F.lit(1)), F.count(F.when(F.col("base").isNull() | F.col("head").isNull(), 1))).first()
    if not n or bad or n > MOST_CASES:
        raise ValueError(f"{path} must hold 1 to {MOST_CASES} cases, each with base and head")
    return found
