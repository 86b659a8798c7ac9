import re

from ripplegraph.functions import paths
from ripplegraph.operators import assessment, changes, evidence


def test_globs():
    hit = lambda g, p: bool(re.search(paths.glob_regex(g), p))
    assert hit("src/*.ts", "src/a.ts") and not hit("src/*.ts", "src/b/a.ts")
    assert hit("src/**/*.ts", "src/a.ts") and hit("src/**/*.ts", "src/b/c/a.ts") and hit("**/x", "x") and hit("a/**", "a/b/c")
    assert hit("{a,b}/?.[ch]", "b/x.c") and not hit("{a,b}/?.[ch]", "c/x.c") and hit("[!a]x", "bx") and not hit("[!a]x", "ax")
    assert hit(r"a\*", "a*") and not hit(r"a\*", "ab") and not hit("a.b", "axb")


def test_owner_patterns():
    hit = lambda g, p: bool(re.search(paths.owners_regex(g), p))
    assert hit("*.ts", "a/b.ts") and hit("docs", "x/docs/y") and hit("docs/", "x/docs/y") and not hit("docs/", "docs")
    assert hit("/src", "src/a") and not hit("/src", "x/src/a") and hit("src/*", "src/a") and not hit("src/*", "src/a/b")
    assert hit("a/**/b", "a/b") and hit("a/**/b", "a/x/y/b/c")


def test_paths_and_names(spark):
    rows = [("", "Empty"), ("/a", "Absolute"), ("C:/a", "Absolute"), ("a\tb", "ControlCharacter"), ("a\\b", "Backslash"), ("a/../b", "NonNormalComponent"), ("a//b", "NonNormalComponent"), ("x/.Git/y", "GitDirectory"), ("src/a.ts", None)]
    got = spark.createDataFrame(rows, "p string, want string").withColumn("got", paths.rejection("p")).collect()
    assert all(r["got"] == r["want"] for r in got)
    rel = spark.createDataFrame([("a/b", "../c", "a/c"), ("a", "../../c", None), ("", "./x", "x"), ("a/b", "c/./d/..", "a/b/c")], "d string, r string, want string")
    assert all(r["got"] == r["want"] for r in rel.withColumn("got", paths.joined_relative("d", "r")).collect())


def test_history(spark):
    rows = [("t", 1, "c1", "PASSED", 10, 0), ("t", 2, "c1", "FAILED", 30, 0), ("t", 3, "c2", "SKIPPED", None, 0), ("t", 4, "c2", "PASSED", 20, 0), ("t", 5, "c3", "PASSED", 40, 0), ("bad", 1, "c1", "PASSED", 1, 0), ("bad", 2, "c2", "FAILED", 1, 0), ("bad", 3, "c2", "ERROR", 1, 0), ("few", 1, "c1", "PASSED", 1, 0), ("re", 1, "c1", "PASSED", 1, 2)]
    df = spark.createDataFrame(rows, "test string, run_id bigint, commit string, outcome string, duration_ms bigint, failed_attempts int")
    got = {r["test"]: r for r in evidence.reliability(df).collect()}
    assert {k: v["reliability"] for k, v in got.items()} == {"t": "FLAKY", "bad": "CONSISTENTLY_FAILING", "few": "INSUFFICIENT_DATA", "re": "FLAKY"}
    assert (got["t"]["runs"], got["t"]["failures"], got["t"]["median_ms"]) == (4, 1, 30)


def test_greedy_pairs_equal_the_loop(spark):
    rows = [("a", "x", 90), ("a", "y", 80), ("b", "x", 90), ("b", "y", 70), ("c", "y", 80), ("d", "z", 55)]
    left, want, used = sorted(rows, key=lambda r: (-r[2], r[0], r[1])), [], set()
    for s, t, n in left:
        if not {("s", s), ("t", t)} & used:
            used |= {("s", s), ("t", t)}
            want.append((s, t, n))
    got = changes.greedy_pairs(spark.createDataFrame(rows, "source string, target string, similarity bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_risk(spark):
    measured = spark.createDataFrame([("public_api_changed", 3), ("blast_radius", 7), ("config_changed", 1), ("changed_code_without_coverage", 9)], "signal string, value bigint")
    points = assessment.signal_points(measured, assessment.signal_table(spark))
    assert {r["signal"]: r["points"] for r in points.filter("points > 0").collect()} == {"public_api_changed": 24, "blast_radius": 10, "config_changed": 5, "changed_code_without_coverage": 15}
    assert tuple(assessment.risk(points).first()) == (54, "HIGH")
