"""Owners, risk, policy and findings of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.session import placed

#: The risk model: fixed values. signal, bands (None: linear), weight, cap.
SIGNALS = (
    ("public_api_changed", None, 8, 24),
    ("migration_changed", None, 15, 15),
    ("build_or_dependency_changed", None, 5, 10),
    ("blast_radius", (1, 6, 21, 101), 5, 20),
    ("changed_symbol_centrality", (3, 10, 30), 5, 15),
    ("critical_path_changed", None, 10, 20),
    ("new_architecture_violation", None, 10, 20),
    ("new_layer_cycle", None, 10, 10),
    ("changed_code_without_coverage", None, 3, 15),
    ("flaky_impacted_tests", None, 3, 9),
    ("deleted_tests", None, 5, 15),
    ("parser_uncertainty", None, 5, 15),
    ("unresolved_references_in_changed_code", None, 1, 5),
    ("config_changed", None, 5, 5),
)
RISK_CAP, LEVELS = 100, ((70, "CRITICAL"), (40, "HIGH"), (15, "MEDIUM"))
#: Gates in order: fixed values.
GATES = ("new_architecture_violation", "architecture_violation", "new_cycle", "parse_failure_in_changed_file", "removed_test_on_critical_path", "breaking_api_change", "config_changed", "config_invalid")
EVIDENCE_CAP = 50


def units(value: Column, bands: Column) -> Column:
    """The value itself, or where there are bands the number of them that it reaches."""
    return F.when(bands.isNull(), value).otherwise(F.size(F.filter(bands, lambda b: value >= b)).cast("bigint"))


def signal_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, list(b) if b else None, w, c) for i, (n, b, w, c) in enumerate(SIGNALS)], "ord int, signal string, bands array<bigint>, weight bigint, cap bigint")


def signal_points(measured: DataFrame, spec: DataFrame) -> DataFrame:
    """signal, value, units, points of every measured signal (signal, value); signals without a measurement count nothing."""
    both = F.broadcast(spec).join(measured, "signal", "left")
    u = units(F.col("value"), F.col("bands"))
    return both.select("signal", "value", u.alias("units"), F.coalesce(F.when(u.isNotNull(), F.least(u * F.col("weight"), F.col("cap"))), F.lit(0)).alias("points"))


def risk(points: DataFrame) -> DataFrame:
    """score and level: one row."""
    score = F.least(F.coalesce(F.sum("points"), F.lit(0)), F.lit(RISK_CAP))
    level = F.lit("LOW")
    for least, name in reversed(LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return points.agg(score.alias("score")).withColumn("level", level)


def verdicts(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """gate, status: PASS where nothing was found; else the gate's level (gate, level: FAIL, WARN or OFF), a failure on inferred evidence alone only a warning."""
    g = findings.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), F.bool_and("inferred").alias("inferred_only"))
    both = policy.join(g, "gate", "left")
    status = F.when(F.col("n").isNull() | (F.col("level") == "OFF"), "PASS").when((F.col("level") == "FAIL") & F.col("inferred_only"), "WARN").otherwise(F.col("level"))
    return both.select("gate", status.alias("status"))


def worst(status: DataFrame) -> DataFrame:
    n = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return status.agg(F.max(n).alias("n")).select(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("n") + 1).alias("result"))


def capped(items: DataFrame, group: str, item: str, cap: int = EVIDENCE_CAP) -> DataFrame:
    """group, item: the first cap distinct items of each group in order, and further: how many more there are. Ranked by ranges, no list is gathered."""
    distinct = items.select(group, item).distinct()
    r = placed(distinct, [F.col(item)], "k", [group])
    return r.filter(F.col("k") <= cap).join(distinct.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group).select(group, item, F.greatest(F.col("n") - cap, F.lit(0)).alias("further"))


def owners(files: DataFrame, rules: list[tuple[int, str, list[str]]], path: str = "path") -> DataFrame:
    """path, line, owners by the last rule (line, pattern, owners) that matches; null without one. The rules become one CASE expression, the last first."""
    line = None
    for number, pattern, _ in reversed(rules):
        hit = F.col(path).rlike(pattern)
        line = F.when(hit, number) if line is None else line.when(hit, number)
    line = line if line is not None else F.lit(None).cast("int")
    names = F.create_map(*[x for n, _, o in rules for x in (F.lit(n), F.array(*map(F.lit, o)).cast("array<string>"))]) if rules else F.lit(None).cast("map<int,array<string>>")
    return files.select(path, line.alias("line")).withColumn("owners", F.try_element_at(names, F.col("line")))


def owner_summary(owned: DataFrame) -> DataFrame:
    """owner, files of each owner; null: unowned."""
    return owned.select(F.explode_outer("owners").alias("owner")).groupBy("owner").agg(F.count(F.lit(1)).alias("files"))


def findings(candidates: DataFrame) -> DataFrame:
    """One finding for each (rule, fingerprint) of candidates (rule, level, path, line, message), the first by place; the fingerprint leaves lines out."""
    print_ = F.md5(F.concat_ws("\n", "rule", "path", "message"))
    # A struct with a null compares as the smaller one, as the order wants it.
    first = candidates.withColumn("fingerprint", print_).groupBy("rule", "fingerprint").agg(F.min(F.struct("path", "line", "level", "message")).alias("x"))
    return first.select("rule", "x.level", "x.path", "x.line", "x.message", "fingerprint")


def leveled(candidates: DataFrame, gates: DataFrame) -> DataFrame:
    """candidates (rule and more) with level: error, warning or note, as the gate (gate, status) of the rule's name fails, warns, or neither."""
    status = gates.select(F.col("gate").alias("rule"), "status")
    level = F.when(F.col("status") == "FAIL", "error").when(F.col("status") == "WARN", "warning").otherwise("note")
    return candidates.join(F.broadcast(status), "rule", "left").withColumn("level", level).drop("status")


def located_findings(candidates: DataFrame, gates: DataFrame) -> DataFrame:
    """rule, level, path, line, message, fingerprint of candidates (rule, path, line, message, identity: an array of strings), one for each rule and identity, the first by place.

    The fingerprint is that of the rule and the identity, which holds no lines: it stays when code above moves."""
    print_ = F.md5(F.concat_ws("", F.transform(F.concat(F.array("rule"), "identity"), lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))))
    rows = leveled(candidates, gates).withColumn("fingerprint", print_)
    first = rows.groupBy("rule", "fingerprint").agg(F.min(F.struct("path", F.when(F.col("line").isNotNull(), F.greatest("line", F.lit(1))).alias("line"), "level", "message")).alias("x"))
    return first.select("rule", "x.level", "x.path", "x.line", "x.message", "fingerprint")


#: Uncertainties by severity, in order: fixed values.
SEVERITIES = ("high", "medium", "low")
_ROW = "severity string, kind string, file string, line int, symbol string, detail string"


def uncertainty(changed: DataFrame, head: DataFrame, unresolved: DataFrame, relevant: DataFrame, truncated: bool = False, cap: int = 200) -> DataFrame:
    """severity, kind, file, line, symbol, detail: what an analysis could not know.

    changed: path, side (head or base), status, language, size, reason (and error_line, error_lines) of the changed files of both sides; head: path, status of all files;
    unresolved: id, file, line, detail, of which those of relevant symbols (id) count, cap of them at most and a row that counts the rest."""
    spark = changed.sparkSession
    status, text = F.col("status"), F.lit(None).cast("string")
    is_head = F.col("side") == "head"
    unread = F.col("unread").isNotNull()
    known = changed.withColumn("unread", paths.unread_language("path"))
    known = known if "error_line" in known.columns else known.withColumn("error_line", F.lit(None).cast("int")).withColumn("error_lines", F.lit(None).cast("int"))
    cases = [
        (status == "SYNTAX_ERRORS", F.when(is_head, "high").otherwise("medium"), "SYNTAX_ERROR", F.concat(F.lit("syntax errors in the "), "side", F.lit(" revision"), F.coalesce(F.concat(F.lit(", in "), F.col("error_lines").cast("string"), F.lit(" lines")), F.lit("")))),
        (status == "PARSE_FAILED", F.lit("high"), "PARSE_FAILURE", F.concat("side", F.lit(" revision not parsed"))),
        (status == "TOO_LARGE", F.lit("high"), "FILE_TOO_LARGE", F.concat("side", F.lit(" revision has "), F.col("size").cast("string"), F.lit(" bytes"))),
        ((status == "BINARY") & F.col("language").isNotNull(), F.lit("medium"), "BINARY_FILE", F.concat("side", F.lit(" revision is no text"))),
        (status == "UNSUPPORTED", F.when(unread, "medium").otherwise("low"), "UNSUPPORTED_LANGUAGE", F.when(unread, F.concat(F.lit("source code in "), "unread", F.lit(" is not analysed"))).otherwise("not a supported language")),
        (status == "EXCLUDED", F.lit("low"), "EXCLUDED_FILE", F.lit("not indexed")),
        (status.isin("SYMLINK", "SUBMODULE"), F.lit("low"), "SYMLINK_OR_SUBMODULE", F.lit("not followed")),
        (status == "INVALID_PATH", F.lit("medium"), "REJECTED_PATH", F.col("reason")),
    ]
    out = None
    for when, severity, kind, detail in cases:
        rows = known.filter(when).select(severity.alias("severity"), F.lit(kind).alias("kind"), F.col("path").alias("file"), F.when(status == "SYNTAX_ERRORS", F.col("error_line")).cast("int").alias("line"), text.alias("symbol"), detail.alias("detail"))
        out = rows if out is None else out.union(rows)
    failures = head.filter(F.col("status").isin("PARSE_FAILED", "TOO_LARGE")).join(changed.filter(is_head).select("path"), "path", "left_anti").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    out = out.union(failures.select(F.lit("medium"), F.lit("PARSE_FAILURE"), text, F.lit(None).cast("int"), text, F.concat(F.col("n").cast("string"), F.lit(" unchanged files could not be indexed"))))
    open_ = unresolved.join(relevant.select("id").distinct(), "id", "left_semi").distinct()
    first = open_.orderBy("id", "file", "line", "detail").limit(cap)
    out = out.union(first.select(F.lit("medium"), F.lit("UNRESOLVED_REFERENCE"), "file", F.col("line").cast("int"), F.col("id"), F.col("detail")))
    rest = open_.agg((F.count(F.lit(1)) - cap).alias("n")).filter("n > 0")
    out = out.union(rest.select(F.lit("medium"), F.lit("UNRESOLVED_REFERENCE"), text, F.lit(None).cast("int"), text, F.concat(F.col("n").cast("string"), F.lit(" further unresolved references"))))
    if truncated:
        out = out.union(spark.createDataFrame([("high", "IMPACT_TRUNCATED", None, None, None, "the impacted set is a lower bound")], _ROW))
    return out.distinct()


def measured(counts: list[tuple[str, DataFrame]]) -> DataFrame:
    """signal, value: the number of rows of each list, one row a signal; what is not evaluated is left out."""
    out = None
    for signal, df in counts:
        row = df.agg(F.lit(signal).alias("signal"), F.count(F.lit(1)).alias("value"))
        out = row if out is None else out.union(row)
    return out


def listed(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first cap rows in the order, with `of`, the number of all: a report's list."""
    every = rows.agg(F.count(F.lit(1)).alias("of"))
    return rows.orderBy(*(F.col(c).asc_nulls_first() for c in order)).limit(cap).crossJoin(F.broadcast(every))


def capped_uncertainty(rows: DataFrame, cap: int = 200) -> DataFrame:
    """kind, file, line, detail: the first cap rows in order, and a row that counts the rest. The cut is a top-k, not a sort of all."""
    order = [F.col(c).asc_nulls_first() for c in ("file", "line", "detail")]
    first = rows.select("kind", "file", "line", "detail").orderBy(*order).limit(cap)
    rest = rows.agg((F.count(F.lit(1)) - cap).alias("n")).filter("n > 0").select(F.lit("SUMMARY").alias("kind"), F.lit(None).cast("string").alias("file"), F.lit(None).cast(dict(rows.dtypes)["line"]).alias("line"), F.concat(F.col("n").cast("string"), F.lit(" further")).alias("detail"))
    return first.union(rest)
