"""Which tests to run: recommendations, their evidence, order and number, and how a selection would have fared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.session import placed

FAST_FEEDBACK = 10


def containers(closure: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, container: the nearest ancestor (id, ancestor, distance) that is a test but no unit."""
    test = symbols.filter("is_test and not is_unit").select(F.col("id").alias("ancestor"))
    return closure.join(test, "ancestor", "left_semi").groupBy("id").agg(F.min(F.struct("distance", "ancestor")).alias("x")).select("id", F.col("x.ancestor").alias("container"))


def units_of(closure: DataFrame, symbols: DataFrame) -> DataFrame:
    """container, unit: every test with the unit tests below it, itself included if it is one."""
    units = symbols.filter("is_unit").select("id")
    below = closure.join(units, "id", "left_semi").join(symbols.filter("is_test").select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return below.select(F.col("ancestor").alias("container"), F.col("id").alias("unit")).union(units.select("id", "id"))


def first_recommendations(found: DataFrame) -> DataFrame:
    """One recommendation (id, reason_ord, depth, strength, seq, ...) for each test: by reason, depth, strength, then order of arrival."""
    rest = [c for c in found.columns if c != "id"]
    key = F.struct("reason_ord", "depth", (-F.col("strength")).alias("s"), "seq")
    first = found.groupBy("id").agg(F.min(F.struct(key.alias("key"), F.struct(*rest).alias("x"))).alias("y"))
    return first.select("id", *(F.col(f"y.x.{c}") for c in rest))


def recommended(changed: DataFrame, impacted: DataFrame, symbols: DataFrame, container: DataFrame) -> DataFrame:
    """id, reason, depth, strength, root.

    Changed tests recommend themselves, other changed symbols their container; impacted units themselves; impacted
    containers themselves unless a unit of theirs is impacted; what else is impacted in a container recommends that. Coverage is recorded by container: one that is reached
    along coverage (impacted has a column `measured`) stays although a unit of its is impacted. Of equal recommendations the one of the first symbol by id counts."""
    s = symbols.select("id", "is_test", "is_unit")
    c = changed.filter("change <> 'DELETED'").select("id").join(s, "id").join(container, "id", "left")
    own = c.select(F.when(F.col("is_test"), F.col("id")).otherwise(F.col("container")).alias("test"), F.lit(0).alias("reason_ord"), F.lit(0).alias("depth"), F.lit(5).alias("strength"), F.col("id").alias("root"), F.col("id").alias("seq"))
    measured = F.coalesce("measured", F.lit(False)) if "measured" in impacted.columns else F.lit(False)
    i = impacted.select("id", "depth", "strength", "root", measured.alias("measured")).join(s, "id").join(container, "id", "left")
    busy = i.filter("is_unit and container is not null").select(F.col("container").alias("id")).distinct().withColumn("busy", F.lit(True))
    units = i.filter("is_unit").select("id", F.lit(1).alias("reason_ord"), "depth", "strength", "root", F.col("id").alias("seq"))
    whole = i.filter("is_test and not is_unit").join(busy, "id", "left").filter("busy is null or measured").select("id", F.lit(1), "depth", "strength", "root", "id")
    inside = i.filter("not is_test and container is not null").select("container", F.lit(1), "depth", "strength", "root", "id")
    every = own.filter("test is not null").toDF("id", "reason_ord", "depth", "strength", "root", "seq").union(units).union(whole).union(inside)
    first = first_recommendations(every)
    return first.select("id", F.when(F.col("reason_ord") == 0, "CHANGED_TEST").otherwise("STATIC_PATH").alias("reason"), "depth", "strength", "root")


def tier(reason: str = "reason", strengths: str = "strengths", observed: str = "observed") -> Column:
    """STRONG: changed itself, or seen by coverage, or every hop exact; WEAK: a hop of mere naming or history; else MEDIUM."""
    return F.when((F.col(reason) == "CHANGED_TEST") | F.exists(observed, lambda x: x) | F.forall(strengths, lambda s: s >= 5), "STRONG").when(F.exists(strengths, lambda s: s <= 2), "WEAK").otherwise("MEDIUM")


def run_order(tests: DataFrame) -> DataFrame:
    """tests with place: by tier, flaky ones last, depth, duration (unknown last) and id; numbered by ranges."""
    order = [F.col("tier_ord"), F.col("flaky"), F.col("depth"), F.coalesce("duration_ms", F.lit((1 << 63) - 1)), F.col("id")]
    return placed(tests, order, "place").withColumn("place", F.col("place").cast("int"))


def sum_known(values: str) -> Column:
    """The sum, null if any value is unknown; 0 of none."""
    return F.when(F.count(F.lit(1)) == F.count(values), F.coalesce(F.sum(values), F.lit(0)))


def selected(ordered: DataFrame, mode: str, fallback: DataFrame, cap: int = FAST_FEEDBACK) -> DataFrame:
    """mode, decision, tests, total_ms. fallback: severity; CONSERVATIVE falls back to all tests on any of them but low ones, BALANCED on high ones, FAST_FEEDBACK takes the first ones."""
    wide = {"CONSERVATIVE": F.col("severity") != "LOW", "BALANCED": F.col("severity") == "HIGH", "FAST_FEEDBACK": F.lit(False)}[mode]
    full = fallback.agg(F.coalesce(F.bool_or(wide), F.lit(False)).alias("full"))
    chosen = ordered.filter(F.col("place") <= cap) if mode == "FAST_FEEDBACK" else ordered
    sums = chosen.agg(F.count(F.lit(1)).alias("tests"), sum_known("duration_ms").alias("total_ms"))
    return sums.crossJoin(full).select(F.lit(mode).alias("mode"), F.when(F.col("full"), "FULL_SUITE").otherwise("SELECTED").alias("decision"), "tests", "total_ms")


def unit_order(selection: DataFrame, units: DataFrame) -> DataFrame:
    """unit, place: the run order of units (place, id → container, unit), each at its first occurrence."""
    return selection.join(units, F.col("id") == F.col("container")).groupBy("unit").agg(F.min("place").alias("place"))


def first_failures(runs: DataFrame) -> DataFrame:
    """plan, position, time_ms: place of the first failing test (plan, place, failed, duration_ms) and the time until it has run."""
    so_far = Window.partitionBy("plan").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = runs.withColumn("t", F.sum("duration_ms").over(so_far))
    return timed.filter("failed").groupBy("plan").agg(F.min(F.struct("place", "t")).alias("x")).select("plan", F.col("x.place").alias("position"), F.col("x.t").alias("time_ms"))


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places, null over nothing."""
    return F.when(b != 0, F.round(a.cast("double") / b, 4))


def scores(plans: DataFrame) -> DataFrame:
    """plan, selected, total, failed, caught, recall (null without failures), reduction, runtime_reduction; plans: plan, test, chosen, failed, duration_ms."""
    g = plans.groupBy("plan").agg(
        F.count(F.when(F.col("chosen"), 1)).alias("selected"),
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("failed"), 1)).alias("failed"),
        F.count(F.when(F.col("failed") & F.col("chosen"), 1)).alias("caught"),
        F.coalesce(F.sum(F.when(F.col("chosen"), F.col("duration_ms"))), F.lit(0)).alias("chosen_ms"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("all_ms"),
    )
    return g.select("plan", "selected", "total", "failed", "caught", ratio(F.col("caught"), F.col("failed")).alias("recall"), ratio(F.col("total") - F.col("selected"), F.col("total")).alias("reduction"), ratio(F.col("all_ms") - F.col("chosen_ms"), F.col("all_ms")).alias("runtime_reduction"))


def aggregated(cases: DataFrame) -> DataFrame:
    """mode, cases, recall (pooled over all failures), mean_reduction (over the known ones), full_suites; cases: mode, failed, caught, reduction, full."""
    g = cases.groupBy("mode").agg(F.count(F.lit(1)).alias("cases"), F.sum("failed").alias("f"), F.sum("caught").alias("c"), F.round(F.avg("reduction"), 4).alias("mean_reduction"), F.count(F.when(F.col("full"), 1)).alias("full_suites"))
    return g.select("mode", "cases", ratio(F.col("c"), F.col("f")).alias("recall"), "mean_reduction", "full_suites")


def nearest_ranks(samples: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, p50, p95, low, high: nearest-rank percentiles. Equal values are counted first, and ranks are numbers of rows up to a range's end:
    neither a list of a group's samples nor one task for it."""
    counts = samples.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    r = placed(counts, [F.col(value)], "k", [group])
    part = F.expr("k div 10000")
    sums = r.groupBy(group, part.alias("part")).agg(F.sum("c").alias("c"))
    before = sums.select(group, "part", (F.sum("c").over(Window.partitionBy(group).orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(group)).alias("n"))
    upto = r.withColumn("part", part).join(before, [group, "part"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(group, "part").orderBy(value)))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p / 100), F.col(value)))
    return upto.groupBy(group).agg(F.max("n").alias("n"), at(50).alias("p50"), at(95).alias("p95"), F.min(value).alias("low"), F.max(value).alias("high"))


#: Reasons to run every test, by how sure they are: fixed values.
HIGH_REASONS = ("MIGRATION", "LOCKFILE", "BUILD_FILE", "CHANGED_FILE_NOT_UNDERSTOOD", "IMPACT_TRUNCATED", "NO_TEST_EVIDENCE")
MEDIUM_REASONS = ("CI", "CONTAINER", "CONFIG", "RESOURCE", "UNRESOLVED_REFERENCE", "UNSUPPORTED_FILE_CHANGED", "CHANGED_CODE_WITHOUT_COVERAGE", "STALE_COVERAGE")


def fallback_reasons(files: DataFrame, more: DataFrame) -> DataFrame:
    """reason, severity, n, example: changed files (path, category, status) and other observations (reason, example) that speak against a selection."""
    reason = F.when(F.col("category") == "BUILD", "BUILD_FILE").when(F.col("category").isNotNull(), F.col("category")).when(F.col("status").isin("TOO_LARGE", "BINARY", "SYNTAX_ERRORS"), "CHANGED_FILE_NOT_UNDERSTOOD").when(F.col("status") == "UNSUPPORTED", "UNSUPPORTED_FILE_CHANGED")
    every = files.select(reason.alias("reason"), F.col("path").alias("example")).unionByName(more.select("reason", "example")).filter("reason is not null")
    severity = F.when(F.col("reason").isin(*HIGH_REASONS), "HIGH").when(F.col("reason").isin(*MEDIUM_REASONS), "MEDIUM").otherwise("LOW")
    return every.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("example").alias("example")).select("reason", severity.alias("severity"), "n", "example")


def resolved_tests(selectors: DataFrame, symbols: DataFrame) -> DataFrame:
    """selector, id: a test's selector as a symbol: its id, else a file, else a Java class by its name; null if none."""
    ids = symbols.select("id")
    out = selectors.select("selector").distinct()
    for n, form in enumerate((F.col("selector"), F.concat(F.lit("file:"), "selector"), F.concat(F.lit("java:"), "selector"))):
        out = out.withColumn("_want", form).join(ids.select(F.col("id").alias("_want"), F.col("id").alias(f"_{n}")), "_want", "left").drop("_want")
    return out.select("selector", F.coalesce("_0", "_1", "_2").alias("id"))
