"""How selections would have fared: past changes analysed with the evidence of their time, and held against the results that followed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators import evidence, graph, selection
from ripplegraph.plans.analysis import Evidence, Snapshot, analyze
from ripplegraph.session import placed, written
from ripplegraph.sources.policy import Policy

MODES = ("CONSERVATIVE", "BALANCED", "FAST_FEEDBACK")


class Case(NamedTuple):
    """A change from base to head (commits and snapshots), and the results (test, outcome, duration_ms) of all tests after it."""

    name: str
    base_commit: str
    head_commit: str
    base: Snapshot
    head: Snapshot
    results: DataFrame


def visible_commits(parents: DataFrame, base: str, head: str) -> DataFrame:
    """commit: base and its ancestors in the parents (id, parent); a head among them raises, for its results would be known already."""
    seen = graph.ancestors_of(parents, base).select(F.col("id").alias("commit"))
    if not seen.filter(F.col("commit") == head).isEmpty():
        raise ValueError(f"{head} does not come after {base}")
    return seen


def plan(case: Case, mode: str, tests: DataFrame, reasons: DataFrame) -> tuple[DataFrame, str]:
    """test, place, chosen, failed, duration_ms of every unit test of the head under a mode, and the mode's decision."""
    decision = selection.selected(tests, mode, reasons).first()["decision"]
    few = mode == "FAST_FEEDBACK" and decision == "SELECTED"
    units = selection.units_of(graph.parent_closure(case.head.symbols), case.head.symbols)
    order = selection.unit_order(tests.filter(F.col("place") <= selection.FAST_FEEDBACK) if few else tests, units)
    rows = case.head.symbols.filter("is_unit").select(F.col("id").alias("unit")).join(order, "unit", "left")
    chosen = F.lit(True) if decision == "FULL_SUITE" else F.col("place").isNotNull()
    rows = placed(rows.withColumn("chosen", chosen).withColumnRenamed("place", "wanted"), [F.col("wanted").asc_nulls_last(), F.col("unit")], "place")
    seen = evidence.observed(case.results).select(F.col("test").alias("unit"), "failed", "duration_ms")
    return rows.join(seen, "unit", "left").select(F.col("unit").alias("test"), "place", "chosen", F.coalesce("failed", F.lit(False)).alias("failed"), "duration_ms"), decision


def replay(case: Case, parents: DataFrame, history: DataFrame, policy: Policy) -> DataFrame:
    """name, mode, decision, selected, total, failed, caught, recall, reduction, runtime_reduction, position, time_ms: a row for each mode.

    The change is analysed once, with the history of the base's past alone."""
    known = evidence.visible(history, visible_commits(parents, case.base_commit, case.head_commit))
    a = analyze(case.base, case.head, policy, Evidence(history=known))
    out = None
    for mode in MODES:
        rows, decision = plan(case, mode, a.tests, a.reasons)
        rows = written(rows.withColumn("plan", F.lit(mode)), "plan")
        first = selection.first_failures(rows.filter("chosen").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0))))
        row = selection.scores(rows).join(first, "plan", "left").withColumnRenamed("plan", "mode").withColumn("name", F.lit(case.name)).withColumn("decision", F.lit(decision))
        out = row if out is None else out.unionByName(row)
    return out


def replayed(results: DataFrame) -> DataFrame:
    """mode, cases, recall, mean_reduction, full_suites, mean_runtime_reduction, mean_position, mean_time_ms over the rows of several cases."""
    sums = selection.aggregated(results.withColumn("full", F.col("decision") == "FULL_SUITE"))
    means = results.groupBy("mode").agg(*(F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("runtime_reduction", "position", "time_ms")))
    return sums.join(means, "mode")
