"""Connected components by alternating stars, each round a few joins on written tables.

Cases: an edge with a null end joins nothing and is passed over; repeated edges, loops and either order of the ends change nothing; no edges give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import written


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: the edges are stars."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest reachable node) of every node of edges (u, v) but the roots themselves. Any order of u and v, repeats and loops are allowed.

    A round links every node's larger neighbours to its smallest one, then every node and its smaller neighbours to
    the smallest; it ends when only stars are left, after a number of rounds logarithmic in the longest path."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while not _settled(now):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = written(small.select("u", F.col("m").alias("v")).union(small.filter("v > m").select("v", "m")).toDF("u", "v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
