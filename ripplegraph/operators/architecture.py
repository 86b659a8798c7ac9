"""Layers, their rules, coupling and cycles, in one snapshot and between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.schema import STRUCTURAL_KINDS


def first_match(path: str, rules: list[tuple[str, list[str]]]) -> Column:
    """The name of the first rule one of whose patterns (anchored regular expressions) the path matches; null for none.

    Rules are few and ordered: they become one CASE expression, without a join."""
    out = None
    for name, patterns in rules:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.col(path).rlike(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")


def dependencies(edges: DataFrame, unit: DataFrame) -> DataFrame:
    """edges with a and b, the units (id, unit) of their ends, where both have one and they differ; containment and tests are no dependencies."""
    own, other = unit.select(F.col("id").alias("f"), F.col("unit").alias("a")), unit.select(F.col("id").alias("t"), F.col("unit").alias("b"))
    return edges.filter(~F.col("kind").isin(*STRUCTURAL_KINDS)).join(own, "f").join(other, "t").filter("a <> b")


def unit_edges(deps: DataFrame) -> DataFrame:
    """a, b, edges, example (the first edge in order)."""
    example = F.min(F.struct("f", "t", "kind_ord"))
    return deps.groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges"), example.alias("x")).select("a", "b", "edges", F.concat_ws(" ", "x.f", "x.t").alias("example"))


def violations(deps: DataFrame, rules: DataFrame) -> DataFrame:
    """f, t, kind, a, b, rule: dependencies that a rule (rule, a, deny, allow: arrays, null if not given) forbids; the first such rule."""
    forbids = F.coalesce(F.array_contains("deny", F.col("b")), F.lit(False)) | F.coalesce(~F.array_contains("allow", F.col("b")), F.lit(False))
    return deps.select("f", "t", "kind", "a", "b").join(F.broadcast(rules), "a").filter(forbids).groupBy("f", "t", "kind", "a", "b").agg(F.min("rule").alias("rule"))


def violation_delta(base: DataFrame, head: DataFrame, aliases: DataFrame) -> DataFrame:
    """f, t, kind, status: NEW, PRE_EXISTING or REMOVED; base symbols go by their ids in head (base_id, head_id)."""
    af, at = aliases.select(F.col("base_id").alias("f"), F.col("head_id").alias("nf")), aliases.select(F.col("base_id").alias("t"), F.col("head_id").alias("nt"))
    b = base.select("f", "t", "kind").join(af, "f", "left").join(at, "t", "left").select(F.coalesce("nf", "f").alias("f"), F.coalesce("nt", "t").alias("t"), "kind", F.lit(1).alias("old")).distinct()
    both = b.join(head.select("f", "t", "kind", F.lit(1).alias("new")).distinct(), ["f", "t", "kind"], "full_outer")
    return both.select("f", "t", "kind", F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "REMOVED").otherwise("PRE_EXISTING").alias("status"))


def layer_dependencies(base: DataFrame, head: DataFrame) -> DataFrame:
    """a, b, base_edges, head_edges, reversed: whether a direction that base lacked turns one round that it had."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = base.select("a", "b", F.col("edges").alias("x")).join(head.select("a", "b", F.col("edges").alias("y")), ["a", "b"], "full_outer")
    back = base.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("edges").alias("z"))
    out = both.join(back, ["a", "b"], "left")
    return out.select("a", "b", zero("x").alias("base_edges"), zero("y").alias("head_edges"), ((zero("x") == 0) & (zero("y") > 0) & (zero("z") > 0)).alias("reversed"))


def coupling_delta(base: DataFrame, head: DataFrame, top: int = 100) -> DataFrame:
    """a, b, base_edges, head_edges, change: the pairs whose number of edges changed the most (a report's list)."""
    both = base.select("a", "b", F.col("edges").alias("x")).join(head.select("a", "b", F.col("edges").alias("y")), ["a", "b"], "full_outer")
    n = both.select("a", "b", F.coalesce("x", F.lit(0)).alias("base_edges"), F.coalesce("y", F.lit(0)).alias("head_edges"))
    return n.withColumn("change", F.col("head_edges") - F.col("base_edges")).filter("change <> 0").orderBy(F.desc(F.abs("change")), "a", "b").limit(top)


def cycle_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """members, status: cycles (member, cycle) by their sorted members, NEW, PRE_EXISTING or REMOVED."""
    members = lambda c: c.groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members")).select("members")
    both = members(base).withColumn("old", F.lit(1)).join(members(head).withColumn("new", F.lit(1)), "members", "full_outer")
    return both.select("members", F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "REMOVED").otherwise("PRE_EXISTING").alias("status"))


def clusters(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """a, b, edges: the graph with each module (id, module) of two nodes or more as one node."""
    many = modules.groupBy("module").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("module", F.lit(1).alias("many"))
    node = modules.join(many, "module", "left").select("id", F.when(F.col("many").isNotNull(), F.concat(F.lit("module:"), "module")).otherwise(F.col("id")).alias("node"))
    ends = edges.join(node.toDF("f", "a"), "f").join(node.toDF("t", "b"), "t").filter("a <> b")
    return ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges"))


def is_api(closure: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, api: whether the symbol and all around it can be seen from outside: none is a test, each public or protected, the outermost public."""
    seen = symbols.select("id", "visibility", "is_test")
    chain = closure.select("id", "ancestor", "distance").union(symbols.select("id", F.col("id").alias("ancestor"), F.lit(0)))
    up = chain.join(seen.withColumnRenamed("id", "ancestor"), "ancestor")
    g = up.groupBy("id").agg(F.bool_and(F.col("visibility").isin("public", "protected") & ~F.col("is_test")).alias("open"), F.max(F.struct("distance", "visibility")).alias("outer"))
    return g.select("id", (F.col("open") & (F.col("outer.visibility") == "public")).alias("api"))


def surface_delta(base: DataFrame, head: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """id, change: API symbols (id, parent, api) that are gone (REMOVED), new (ADDED), no longer API (NARROWED) or become so (WIDENED); of what is gone or new only the topmost.

    signed: previous and id of symbols whose signature changed: they are SIGNATURE_CHANGED, neither gone nor new."""
    b, h = base.filter("api").select("id", "parent"), head.filter("api").select("id", "parent")
    ids_b, ids_h = b.select("id"), h.select("id")
    removed = b.join(head.select("id"), "id", "left_anti")
    added = h.join(base.select("id"), "id", "left_anti")
    if signed is not None:
        removed = removed.join(signed.select(F.col("previous").alias("id")), "id", "left_anti")
        added = added.join(signed.select("id"), "id", "left_anti")
    top = lambda x: x.join(x.select(F.col("id").alias("parent")), "parent", "left_anti").select("id")
    narrowed = ids_b.join(head.filter("not api").select("id"), "id", "left_semi")
    widened = ids_h.join(base.filter("not api").select("id"), "id", "left_semi")
    out = top(removed).withColumn("change", F.lit("REMOVED")).union(top(added).withColumn("change", F.lit("ADDED"))).union(narrowed.withColumn("change", F.lit("NARROWED"))).union(widened.withColumn("change", F.lit("WIDENED")))
    if signed is not None:
        out = out.union(signed.join(ids_b.withColumnRenamed("id", "previous"), "previous", "left_semi").select("id", F.lit("SIGNATURE_CHANGED").alias("change")))
    return out


#: Changes of the surface that break its users: fixed values.
BREAKING = ("REMOVED", "NARROWED", "SIGNATURE_CHANGED")


def checked(deps: DataFrame, rules: DataFrame) -> DataFrame:
    """f, t, kind, a, b, rule, status of one snapshot: all that it violates is there already."""
    return violations(deps, rules).withColumn("status", F.lit("PRE_EXISTING"))
