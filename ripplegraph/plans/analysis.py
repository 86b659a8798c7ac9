"""A whole analysis: two snapshots of a code base and recorded evidence in; changed and impacted symbols, tests, architecture, risk and gates out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.operators import architecture, assessment, changes, evidence, extraction, graph, selection
from ripplegraph.schema import LIST_CAP, ordinal
from ripplegraph.plans import store
from ripplegraph.session import written
from ripplegraph.sources import snapshots
from ripplegraph.sources.policy import Policy


class Snapshot(NamedTuple):
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    unresolved: DataFrame


class Evidence(NamedTuple):
    """What was recorded: covered (test, id, format, commit), measured (file, commit), history (test, run_id, commit, outcome, duration_ms, failed_attempts); stale: whether coverage is of other commits."""

    covered: DataFrame | None = None
    measured: DataFrame | None = None
    history: DataFrame | None = None
    stale: bool = False


class Analysis(NamedTuple):
    files: DataFrame
    changed: DataFrame
    impacted: DataFrame
    tests: DataFrame
    reasons: DataFrame
    selection: DataFrame
    uncertainty: DataFrame
    violations: DataFrame
    cycles: DataFrame
    surface: DataFrame
    owners: DataFrame
    signals: DataFrame
    risk: DataFrame
    gates: DataFrame
    verdict: DataFrame
    truncated: bool
    hunks: DataFrame
    findings: DataFrame


def snapshot(spark: SparkSession, root: str, index: str | None = None) -> Snapshot:
    """The files, symbols, edges and unresolved references below a folder, written once and read from then on.

    index: a store; what it knows of a file's content is not read again. References are resolved anew, for they hang on all files."""
    files = written(snapshots.files(spark, root), "files")
    got = extraction.extracted(files, None if index is None else store.read_files(spark, index, files))
    return Snapshot(parsed(files, written(got.errors, "errors")), got.symbols, written(graph.graph_edges(graph.attached_edges(got.edges, got.symbols)), "edges"), written(got.unresolved, "unresolved"))


def stored(spark: SparkSession, index: str, s: Snapshot) -> dict[str, dict[str, int]]:
    """Bring the store's tables to the snapshot, by difference; what changed in each."""
    files = s.files.select("path", "blob", "language", "status")
    return store.apply(spark, index, {"files": files, "symbols": s.symbols, "edges": s.edges, "unresolved": s.unresolved.distinct()})


def parsed(files: DataFrame, errors: DataFrame) -> DataFrame:
    """files with the status SYNTAX_ERRORS, error_line (the first) and error_lines (their number) where there are errors (path, line, of)."""
    first = errors.groupBy("path").agg(F.min("line").alias("error_line"), F.max("of").alias("error_lines"))
    out = files.join(first, "path", "left")
    return out.withColumn("status", F.when((F.col("status") == "INDEXED") & F.col("error_line").isNotNull(), "SYNTAX_ERRORS").otherwise(F.col("status")))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, old_path, change, category, language, status of every changed file; a renamed file is one row."""
    plain = lambda f: f.select("path", "blob", F.lit("file").alias("kind"))
    diff = written(changes.diff_paths(plain(base), plain(head)).filter("change <> 'UNCHANGED'"), "diff")
    gone, come = (f.join(diff.filter(F.col("change") == c), "path", "left_semi").select("path", "blob", "text") for f, c in ((base, "DELETED"), (head, "ADDED")))
    moved = written(changes.renames(gone, come), "renames")
    rest = diff.join(moved.select(F.col("source").alias("path")), "path", "left_anti").join(moved.select(F.col("target").alias("path")), "path", "left_anti")
    every = rest.select("path", F.lit(None).cast("string").alias("old_path"), "change").union(moved.select(F.col("target"), F.col("source"), F.lit("RENAMED")))
    known = head.select("path", "language", "status").union(base.join(head.select("path"), "path", "left_anti").select("path", "language", "status"))
    return every.join(known, "path", "left").withColumn("category", paths.category("path"))


def _units(s: Snapshot, policy: Policy) -> DataFrame:
    unit = s.symbols.select("id", architecture.first_match("file", policy.layers).alias("unit"), "file").filter("unit is not null")
    return unit.filter(~_matches("file", policy.generated)).select("id", "unit")


def _matches(path: str, patterns: list[str]):
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(path).rlike(p)
    return hit


def layer_state(s: Snapshot, policy: Policy) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dependencies between layers, violations of the rules, and cycles (member, cycle) of one snapshot."""
    deps = written(architecture.dependencies(s.edges, _units(s, policy)), "layers")
    rules = s.files.sparkSession.createDataFrame([(r["rule"], r["a"], r["deny"], r["allow"]) for r in policy.rules], "rule int, a string, deny array<string>, allow array<string>")
    return deps, written(architecture.violations(deps, rules), "violations"), graph.cycles(deps.select("a", "b"))


def check(s: Snapshot, policy: Policy) -> DataFrame:
    """f, t, kind, a, b, rule, status: what one snapshot violates, all of it pre-existing."""
    _, found, _ = layer_state(s, policy)
    return found.withColumn("status", F.lit("PRE_EXISTING"))


def analyze(base: Snapshot, head: Snapshot, policy: Policy, recorded: Evidence | None = None, mode: str | None = None, owner_rules: list | None = None, policy_changed: bool = False, policy_errors: list[str] | None = None) -> Analysis:
    """What the step from base to head changes, what it can break, which tests would show it, and what rules and gates say.

    The policy is the base's; policy_changed and policy_errors tell of the head's file."""
    spark, recorded, mode = base.files.sparkSession, recorded or Evidence(), mode or policy.mode.upper()
    files = written(changed_files(base.files, head.files), "changes")

    # Symbols
    own = lambda s: s.symbols.filter("kind <> 'file'").select("id", "kind", F.col("parent").alias("owner"), "name", "fp")
    what = written(changes.classified(own(base), own(head)), "changed")
    place = head.symbols.select("id", "kind", "file", "is_test", "is_unit").union(base.symbols.join(head.symbols.select("id"), "id", "left_anti").select("id", "kind", "file", "is_test", "is_unit"))
    changed = what.join(place, "id", "left")
    if recorded.covered is not None and recorded.measured is not None:
        changed = changed.join(evidence.coverage_status(head.symbols, recorded.covered, recorded.measured).withColumnRenamed("status", "coverage"), "id", "left")
    else:
        changed = changed.withColumn("coverage", F.lit(None).cast("string"))
    changed = written(changed, "classified")

    hunks = changes.file_hunks(files, base.files, head.files, base.symbols, head.symbols)

    # Impact on both graphs; coverage counts as an edge of the head
    head_edges = head.edges
    if recorded.covered is not None:
        seen = evidence.coverage_edges(recorded.covered, head.symbols)
        tests = seen.select("f", "t", F.lit("TESTS").alias("kind"), F.lit(8).alias("kind_ord"), F.lit(4).alias("strength"), F.lit(1).alias("ev_ord"), F.lit("").alias("file"), F.lit(0).alias("line"), "rule")
        head_edges = written(graph.graph_edges(head.edges.unionByName(tests)), "edges")
    roots = changes.impact_roots(changed)
    there = graph.impact(head_edges, roots.filter("side = 'head'").select("id").join(head.symbols.select("id"), "id", "left_semi"))
    before = graph.impact(base.edges, roots.filter("side = 'base'").select("id").join(base.symbols.select("id"), "id", "left_semi"))
    truncated = there.truncated or before.truncated
    merged = changes.merged_impact(there.reached, before.reached, changed)
    detail = there.reached.withColumn("side", F.lit("head")).unionByName(before.reached.withColumn("side", F.lit("base"))).select("id", "depth", "side", "strength", "root", "hops")
    impacted = written(merged.join(detail, ["id", "depth", "side"]), "impacted")

    # Tests
    container = selection.containers(graph.parent_closure(head.symbols), head.symbols)
    measured = F.exists("hops", lambda h: F.contains(h, F.lit(" TESTS ")))
    found = selection.recommended(changed, impacted.select("id", "depth", "strength", "root", measured.alias("measured")), head.symbols, container)
    hops = impacted.select("id", F.array(measured).alias("observed"))
    found = found.join(hops, "id", "left").withColumn("observed", F.coalesce("observed", F.array(F.lit(False)))).withColumn("strengths", F.array("strength")).withColumn("tier", selection.tier())
    if recorded.history is not None:
        found = found.join(evidence.reliability(recorded.history).select(F.col("test").alias("id"), "reliability", F.col("median_ms").alias("duration_ms")), "id", "left")
    else:
        found = found.withColumn("reliability", F.lit(None).cast("string")).withColumn("duration_ms", F.lit(None).cast("bigint"))
    found = found.withColumn("tier_ord", ordinal("tier", ("STRONG", "MEDIUM", "WEAK"))).withColumn("flaky", F.coalesce(F.col("reliability") == "FLAKY", F.lit(False)))
    tests = written(selection.run_order(found.drop("observed", "strengths")), "tests")

    # What is not known, and what speaks against a selection
    sides = head.files.withColumn("side", F.lit("head")).join(files.select("path"), "path", "left_semi").unionByName(base.files.withColumn("side", F.lit("base")).join(files.select(F.coalesce("old_path", "path").alias("path")), "path", "left_semi"))
    relevant = changed.select("id").union(impacted.select("id"))
    doubt = written(assessment.uncertainty(sides.select("path", "side", "status", "language", "size", "reason", "error_line", "error_lines"), head.files, head.unresolved, relevant, truncated), "uncertainty")
    code = changed.filter("not coalesce(is_test, false)")
    uncovered = code.filter("change <> 'DELETED' and coverage in ('NOT_COVERED', 'NO_DATA')").filter(~_matches("file", policy.generated))
    more = uncovered.filter("change = 'MODIFIED'").select(F.lit("CHANGED_CODE_WITHOUT_COVERAGE").alias("reason"), F.col("id").alias("example"))
    more = more.union(doubt.filter("kind = 'UNRESOLVED_REFERENCE' and severity <> 'low'").select(F.lit("UNRESOLVED_REFERENCE"), F.coalesce("symbol", "detail")))
    more = more.union(doubt.filter("kind = 'IMPACT_TRUNCATED'").select("kind", "detail"))
    if recorded.stale:
        more = more.union(spark.createDataFrame([("STALE_COVERAGE", "coverage of other commits")], "reason string, example string"))
    if not code.isEmpty() and tests.isEmpty():
        more = more.union(code.select(F.lit("NO_TEST_EVIDENCE"), "id"))
    reasons = written(selection.fallback_reasons(files.select("path", "category", "status"), more), "reasons")
    chosen = selection.selected(tests, mode, reasons)

    # Architecture
    aliases = changes.identity_aliases(changed)
    base_deps, base_bad, base_cycles = layer_state(base, policy)
    head_deps, head_bad, head_cycles = layer_state(head, policy)
    violations = written(architecture.violation_delta(base_bad, head_bad, aliases).join(head_deps.select("f", "t", "kind", "ev_ord").distinct(), ["f", "t", "kind"], "left"), "violation-delta")
    cycles = written(architecture.cycle_delta(base_cycles, head_cycles), "cycle-delta")
    api = lambda s: written(architecture.is_api(graph.parent_closure(s.symbols), s.symbols.filter("kind <> 'file'")).join(s.symbols.select("id", "parent"), "id"), "api")
    signed = changed.filter("change = 'SIGNATURE_CHANGED'").select("previous", "id")
    surface = written(architecture.surface_delta(api(base), api(head), signed), "surface")
    breaking = surface.filter(F.col("change").isin(*architecture.BREAKING))
    touched = files.select("path").union(impacted.join(place.select("id", F.col("file").alias("path")), "id").select("path")).distinct()
    owners = assessment.owner_summary(assessment.owners(touched, owner_rules or []))

    # Risk
    of = lambda *names: files.filter(F.col("category").isin(*names))
    layered, critical = bool(policy.layers), bool(policy.critical)
    by_file = changed.select(F.col("file").alias("path")).distinct()
    critical_files = files.filter(_matches("path", policy.critical) | F.coalesce(_matches("old_path", policy.critical), F.lit(False)))
    critical_files = critical_files.filter("language is null").unionByName(critical_files.filter("language is not null").join(by_file, "path", "left_semi"))
    deleted_tests = base.symbols.filter("is_unit").join(changed.filter("change = 'DELETED'"), "id", "left_semi")
    unparsed = doubt.filter("severity = 'high' and kind in ('SYNTAX_ERROR', 'PARSE_FAILURE', 'FILE_TOO_LARGE')").select("file").distinct()
    both_ids = changed.select(F.col("id").alias("symbol")).union(changed.filter("previous is not null").select("previous"))
    counts = [
        ("public_api_changed", breaking),
        ("migration_changed", of("MIGRATION")),
        ("build_or_dependency_changed", of("BUILD", "LOCKFILE", "CI", "CONTAINER", "CONFIG")),
        ("blast_radius", impacted.join(place.filter("not is_test").select("id"), "id", "left_semi")),
        ("deleted_tests", deleted_tests),
        ("parser_uncertainty", unparsed),
        ("unresolved_references_in_changed_code", doubt.filter("kind = 'UNRESOLVED_REFERENCE'").join(both_ids, "symbol", "left_semi")),
        ("config_changed", spark.range(int(policy_changed))),
    ]
    new_bad = violations.filter("status = 'NEW'")
    if critical:
        counts.append(("critical_path_changed", critical_files))
    if layered:
        counts.append(("new_architecture_violation", new_bad))
    if layered and policy.cycles != "off":
        counts.append(("new_layer_cycle", cycles.filter("status = 'NEW'")))
    if recorded.covered is not None:
        counts.append(("changed_code_without_coverage", uncovered))
    if recorded.history is not None:
        counts.append(("flaky_impacted_tests", tests.filter("flaky")))
    dependents = graph.centrality(head.edges, code.filter("change <> 'DELETED'")).unionByName(graph.centrality(base.edges, code.filter("change in ('DELETED', 'SIGNATURE_CHANGED')").select(F.coalesce("previous", "id").alias("id"))))
    measured = assessment.measured(counts).union(dependents.agg(F.lit("changed_symbol_centrality"), F.coalesce(F.max("dependents"), F.lit(0))))
    signals = written(assessment.signal_points(measured, assessment.signal_table(spark)), "signals")

    # Gates
    inferred = F.coalesce(F.col("ev_ord") != 0, F.lit(True)).alias("inferred")
    sure = F.lit(False).alias("inferred")
    found_ = files.limit(0).select(F.lit("").alias("gate"), sure)
    gate = lambda df, name, how=sure: df.select(F.lit(name).alias("gate"), how)
    if layered:
        found_ = found_.union(gate(new_bad, "new_architecture_violation", inferred)).union(gate(violations.filter("status <> 'REMOVED'"), "architecture_violation", inferred))
    if layered and policy.cycles != "off":
        found_ = found_.union(gate(cycles.filter("status = 'NEW'"), "new_cycle"))
    found_ = found_.union(gate(unparsed, "parse_failure_in_changed_file")).union(gate(breaking, "breaking_api_change"))
    if critical:
        targets = base.symbols.filter(_matches("file", policy.critical)).select("id")
        found_ = found_.union(gate(graph.first_critical(base.edges, deleted_tests, targets), "removed_test_on_critical_path"))
    found_ = found_.union(gate(spark.range(int(policy_changed)), "config_changed")).union(gate(spark.range(len(policy_errors or [])), "config_invalid"))
    levels = spark.createDataFrame(sorted(policy.levels.items()), "gate string, level string")
    gates = written(assessment.verdicts(found_, levels), "gates")
    # Findings: where the new violations, breaking changes, unparsed files and the policy's errors are
    at = head_deps.groupBy("f", "t", "kind").agg(F.min(F.struct("file", "line")).alias("at"))
    bad = new_bad.select("f", "t", "kind").join(head_bad, ["f", "t", "kind"]).join(at, ["f", "t", "kind"])
    lines = head.symbols.select("id", "file", "start_line").union(base.symbols.join(head.symbols.select("id"), "id", "left_anti").select("id", "file", "start_line"))
    api_at = breaking.select("id", "change").join(lines, "id")
    row = lambda df, rule, path, line, message, *identity: df.select(F.lit(rule).alias("rule"), path.alias("path"), line.cast("int").alias("line"), message.alias("message"), F.array(*identity).alias("identity"))
    candidates = row(bad, "new_architecture_violation", F.col("at.file"), F.col("at.line"), F.concat("a", F.lit(" must not depend on "), "b", F.lit(": "), "f", F.lit(" -> "), "t"), F.col("f"), F.col("t"), F.col("kind"), F.col("rule").cast("string"))
    candidates = candidates.union(row(api_at, "breaking_api_change", F.col("file"), F.col("start_line"), F.concat_ws(" ", F.lit("public API"), "change", "id"), F.col("change"), F.col("id")))
    not_read = doubt.filter("severity = 'high' and kind in ('SYNTAX_ERROR', 'PARSE_FAILURE', 'FILE_TOO_LARGE') and file is not null")
    candidates = candidates.union(row(not_read, "parse_failure_in_changed_file", F.col("file"), F.col("line"), F.concat("detail", F.lit("; symbols in it may be missing")), F.col("file"), F.col("kind")))
    errors = spark.createDataFrame([(e,) for e in policy_errors or []], "error string")
    candidates = candidates.union(row(errors, "config_invalid", F.lit(None).cast("string"), F.lit(None), F.concat(F.lit("the policy cannot be read: "), "error"), F.col("error")))
    findings = written(assessment.located_findings(candidates, gates), "findings")
    return Analysis(files, changed, impacted, tests, reasons, chosen, doubt, violations, cycles, surface, owners, signals, assessment.risk(signals), gates, assessment.worst(gates), truncated, hunks, findings)


def report(a: Analysis) -> dict[str, DataFrame]:
    """The analysis as a report's lists: each in its order, cut to its cap, with the number of all in `of`."""
    return {
        "files": assessment.listed(a.files, ["path"], LIST_CAP),
        "hunks": assessment.listed(a.hunks, ["path", "new_start", "old_start"], LIST_CAP),
        "changed": assessment.listed(a.changed, ["file", "id"], LIST_CAP),
        "impacted": assessment.listed(a.impacted, ["depth", "id"], LIST_CAP),
        "tests": assessment.listed(a.tests, ["place"], LIST_CAP),
        "uncertainty": assessment.listed(a.uncertainty.withColumn("ord", ordinal("severity", assessment.SEVERITIES)), ["ord", "kind", "file", "line", "symbol", "detail"], LIST_CAP),
        "violations": assessment.listed(a.violations, ["f", "t", "kind"], LIST_CAP),
        "api": assessment.listed(a.surface, ["id", "change"], LIST_CAP),
        "findings": assessment.listed(a.findings, ["path", "line", "rule", "fingerprint"], LIST_CAP),
        "owners": assessment.listed(a.owners, ["owner"], LIST_CAP),
    }
