"""Recorded evidence: test runs, coverage, and how they name files and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.operators.changes import innermost_symbols


def merged_lines(lines: DataFrame) -> DataFrame:
    """report, path, line, hit: a line reported more than once counts as hit if any report of it does."""
    return lines.groupBy("report", "path", "line").agg(F.bool_or("hit").alias("hit"))


def test_history(results: DataFrame, runs: DataFrame) -> DataFrame:
    """test, run_id, commit, outcome, duration_ms, failed_attempts in the order of ingestion (run, test)."""
    return results.join(runs.select("run_id", "commit"), "run_id").select("test", "run_id", "commit", "outcome", "duration_ms", "failed_attempts")


def visible(history: DataFrame, commits: DataFrame) -> DataFrame:
    """The entries of the commits (commit) that are allowed to be seen."""
    return history.join(commits.select("commit"), "commit", "left_semi")


def latest_coverage(reports: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """The last report (greatest id) of each test, reports of no test being one group; commits are restricted first."""
    seen = visible(reports, commits) if commits is not None else reports
    rest = [c for c in seen.columns if c not in ("test", "id")]
    return seen.groupBy("test").agg(F.max(F.struct("id", *rest)).alias("x")).select("test", "x.*")


def upper_medians(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key, name: the value at index n div 2 of the sorted ones. Equal values are counted first; no list is gathered."""
    counts = rows.groupBy(key, value).agg(F.count(value).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(key).orderBy(value))).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    return upto.groupBy(key).agg(F.min(F.when(F.col("upto") >= F.expr("n div 2 + 1"), F.col(value))).alias(name))


def reliability(history: DataFrame) -> DataFrame:
    """test, runs, failures, flaky_commits, median_ms, last_outcome, reliability of each test that was executed.

    A commit is flaky if it has both outcomes, or a passing run with failed attempts. Runs are summed by commit first."""
    ran = history.filter("outcome <> 'SKIPPED'").withColumn("failed", F.col("outcome").isin("FAILED", "ERROR"))
    by_commit = ran.groupBy("test", "commit").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count(F.when(F.col("failed"), 1)).alias("failures"),
        F.bool_or(~F.col("failed") & (F.col("failed_attempts") > 0)).alias("retried"),
        F.max(F.struct("run_id", "outcome")).alias("last"),
    )
    flaky = F.col("retried") | ((F.col("failures") > 0) & (F.col("failures") < F.col("runs")))
    tests = by_commit.groupBy("test").agg(
        F.sum("runs").alias("runs"),
        F.sum("failures").alias("failures"),
        F.count(F.when(flaky, 1)).alias("flaky_commits"),
        F.max(F.struct("last", (F.col("failures") == F.col("runs")).alias("all_failed"))).alias("x"),
    )
    medians = upper_medians(ran, "test", "duration_ms", "median_ms")
    label = F.when(F.col("flaky_commits") > 0, "FLAKY").when(F.col("runs") < 3, "INSUFFICIENT_DATA").when(F.col("x.all_failed"), "CONSISTENTLY_FAILING").otherwise("STABLE")
    return tests.join(medians, "test").select("test", "runs", "failures", "flaky_commits", "median_ms", F.col("x.last.outcome").alias("last_outcome"), label.alias("reliability"))


def evidence_summary(reports: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """reports, runs, tests, other_commit_reports: one row; current: the commits analysed."""
    r = reports.join(F.broadcast(current.select("commit", F.lit(1).alias("own"))), "commit", "left").agg(F.count(F.lit(1)).alias("reports"), F.count(F.when(F.col("own").isNull(), 1)).alias("other_commit_reports"))
    h = history.agg(F.count_distinct("run_id").alias("runs"), F.count_distinct("test").alias("tests"))
    return r.crossJoin(h).select("reports", "runs", "tests", "other_commit_reports")


def coverage_edges(covered: DataFrame, symbols: DataFrame) -> DataFrame:
    """f, t, rule: a test covers a symbol (test, id, format, commit) that is no test and not itself; the first rule of a pair stays."""
    tests = symbols.select(F.col("id").alias("test"))
    targets = symbols.filter("not is_test").select("id")
    rule = F.concat(F.lit("coverage."), "format", F.lit("@"), F.substring("commit", 1, 10))
    both = covered.join(tests, "test", "left_semi").join(targets, "id", "left_semi").filter("test <> id")
    return both.groupBy(F.col("test").alias("f"), F.col("id").alias("t")).agg(F.min(rule).alias("rule"))


def coverage_status(symbols: DataFrame, covered: DataFrame, measured: DataFrame) -> DataFrame:
    """id, status: COVERED, NOT_COVERED (its file was measured) or NO_DATA."""
    c, m = covered.select("id", F.lit(1).alias("c")).distinct(), measured.select("file", F.lit(1).alias("m")).distinct()
    out = symbols.select("id", "file").join(c, "id", "left").join(m, "file", "left")
    return out.select("id", F.when(F.col("c").isNotNull(), "COVERED").when(F.col("m").isNotNull(), "NOT_COVERED").otherwise("NO_DATA").alias("status"))


def base_only_status(symbols: DataFrame, covered: DataFrame, measured: DataFrame, base_commit: str) -> DataFrame:
    """id, status of deleted symbols: as coverage_status, but only reports (commit) of the base commit count."""
    return coverage_status(symbols, covered.filter(F.col("commit") == base_commit), measured.filter(F.col("commit") == base_commit))


def covered_symbols(lines: DataFrame, paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """report, id, hits: the innermost symbols of the lines that were hit (report, path, line, hit); paths: raw, path (mapped_paths). Paths that map to no file and files no line of which is executable count nothing."""
    hit = lines.filter("hit").join(paths.filter("path is not null").select(F.col("raw").alias("path"), F.col("path").alias("file")), "path")
    found = innermost_symbols(hit.select("file", "line").distinct(), symbols)
    return hit.join(found, ["file", "line"]).groupBy("report", "id").agg(F.count(F.lit(1)).alias("hits"))


def unmapped_files(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """report, unmapped: how many of a report's paths are no file of the snapshot."""
    return lines.select("report", "path").distinct().join(paths.select(F.col("raw").alias("path"), F.col("path").alias("file")), "path", "left").groupBy("report").agg(F.count(F.when(F.col("file").isNull(), 1)).alias("unmapped"))


def mapped_paths(raw: DataFrame, files: DataFrame, work_dir: str | None = None) -> DataFrame:
    """raw, path: a tool's path as a repository path (path): equal, or the only one that ends in it at a component's border.

    work_dir, the folder in which the tool ran, is cut off first, whatever the case of its letters. Every suffix of a repository path is a row, so that the match is an equi-join."""
    parts = F.split("path", "/")
    suffixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("raw"))
    one = suffixes.groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select("raw", F.col("path").alias("by_suffix"))
    exact = files.select(F.col("path").alias("raw"), F.col("path").alias("same")).distinct()
    plain = F.regexp_replace(F.replace("raw", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    if work_dir:
        prefix = work_dir.replace("\\", "/").rstrip("/") + "/"
        plain = F.when(F.startswith(F.lower(plain), F.lit(prefix.lower())), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)
    asked = raw.select("raw").distinct().select(F.col("raw").alias("asked"), plain.alias("raw"))
    return asked.join(exact, "raw", "left").join(one, "raw", "left").select(F.col("asked").alias("raw"), F.coalesce("same", "by_suffix").alias("path"))


def mapped_cases(cases: DataFrame, tests: DataFrame) -> DataFrame:
    """case_id, id: a case (case_id, classname, name, and file where the tool tells it) as a test (id, owner, name).

    A TypeScript test is known by its file and title, the file being told as such or as the class; a Java test by its owner and name, if there is just one."""
    one = tests.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1")
    out = cases.join(one.withColumnRenamed("owner", "classname"), ["classname", "name"], "left").withColumnRenamed("id", "by_name")
    titled = lambda column: F.concat(F.lit("ts:"), column, F.lit("#test:"), "name")
    for n, column in enumerate([c for c in ("file", "classname") if c in cases.columns]):
        out = out.withColumn("_want", titled(column)).join(tests.select(F.col("id").alias("_want"), F.col("id").alias(f"_{n}")).distinct(), "_want", "left").drop("_want")
    return out.select("case_id", F.coalesce(*[c for c in ("_0", "_1") if c in out.columns], "by_name").alias("id"))


def observed(results: DataFrame) -> DataFrame:
    """test, failed (in any run), duration_ms (the longest)."""
    return results.groupBy("test").agg(F.bool_or(F.col("outcome").isin("FAILED", "ERROR")).alias("failed"), F.max("duration_ms").alias("duration_ms"))
