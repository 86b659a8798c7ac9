"""Work that grows with the tables: how many rows are written on the way, and the same results as the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import changes, graph
from ripplegraph.plans.queries import ORACLES, QUERIES
from tests.test_graph import brute, edges


@pytest.fixture
def rows_written(monkeypatch):
    """The rows of every table that a module writes on the way."""
    counts = []

    def watch(module):
        plain = module.written

        def counted(df, name):
            out = plain(df, name)
            counts.append(out.count())
            return out

        monkeypatch.setattr(module, "written", counted)
        return counts

    return watch


def test_first_critical_symbols_need_no_rows_of_tests_and_symbols(spark, rows_written):
    # 40 tests that all use ten functions, which all use 30 others.
    rows = [(f"t{i:02}", f"a{j}", "CALLS", 5, 1) for i in range(40) for j in range(10)] + [(f"a{j}", f"b{k:02}", "CALLS", 5, 1) for j in range(10) for k in range(30)]
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    counts = rows_written(graph)
    got = graph.first_critical(edges(spark, rows), one(f"t{i:02}" for i in range(40)), one(["b07", "b05"]), 3).collect()
    assert {tuple(r) for r in got} == {(f"t{i:02}", "b05", 2) for i in range(40)}
    assert max(counts) <= len(rows)


def test_overrides_make_no_pairs_of_methods(spark):
    r = random.Random(5)
    methods = [(i, f"o{r.randrange(4)}", f"m{r.randrange(2)}", str(r.randrange(2)), str(r.randrange(4))) for i in range(400)]
    supers = [(f"o{i}", f"o{j}", i - j) for i in range(4) for j in range(i)]
    m = spark.createDataFrame(methods, "id int, owner string, name string, params string, signature string")
    want = {}
    for i, owner, name, params, signature in methods:
        found = [(d, j, 5 if signature == s else 3) for o, above, d in supers if o == owner for j, other, n, p, s in methods if (other, n, p) == (above, name, params)]
        if found:
            want[i] = min(found)[1:]
    got = graph.overrides(m, spark.createDataFrame(supers, "owner string, above string, distance int"))
    assert {x["f"]: (x["t"], x["strength"]) for x in got.collect()} == want and len(want) > 100
    # No method meets another one: methods are joined with what is above their owners, of which there is one a name and parameters.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join") and plan.count("Aggregate") >= 3


def test_lines_without_their_ends(spark):
    d = spark.createDataFrame([("d/1.ts", "a\nb\nc"), ("d/2.ts", "p\n"), ("d/3.ts", "")], "path string, text string")
    a = spark.createDataFrame([("a/1.ts", "x\nc\nb\n"), ("a/2.ts", "p"), ("a/3.ts", "")], "path string, text string")
    got = {tuple(r) for r in changes.rename_candidates(d, a, ends=False).collect()}
    # c with and without an end is one line; after p's end there is an empty line, which equals an empty text.
    assert got == {("d/1.ts", "a/1.ts", 57), ("d/2.ts", "a/2.ts", 66), ("d/3.ts", "a/3.ts", 100), ("d/2.ts", "a/3.ts", 66)}


def test_impact_writes_no_graph(spark, rows_written):
    rows = [("b", "a", "CALLS", 5, 1), ("c", "b", "CALLS", 5, 2)] + [(f"x{i}", f"y{i}", "CALLS", 5, 1) for i in range(300)]
    counts = rows_written(graph)
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    got = graph.impact(edges(spark, rows), one("a")).reached.collect()
    assert {(r["id"], r["depth"]) for r in got} == {("b", 1), ("c", 2)}
    assert [h["t"] for h in graph.dependency_path(edges(spark, rows), "c", "a").hops.orderBy("hop").collect()] == ["b", "a"]
    assert max(counts) <= 2


def test_impact_of_a_frontier_that_is_not_broadcast(spark, monkeypatch):
    r = random.Random(11)
    rows = list({(f"s{r.randrange(40):02}", f"s{r.randrange(40):02}", r.choice(["CALLS", "OVERRIDES", "CONTAINS"])): 0 for _ in range(150)})
    # Of edges of one (f, t, kind) the one with the best evidence counts, whether they were brought down to it before or not.
    rows = [(*x, s, line) for x in rows for s, line in ((5, 2), (3, 1))]
    roots = spark.createDataFrame([(f"s{i:02}",) for i in range(6)], "id string")
    for cap in (5000, 9):
        want = graph.impact(graph.graph_edges(edges(spark, rows)), roots, max_impacted=cap)
        monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
        got = graph.impact(edges(spark, rows), roots, max_impacted=cap)
        monkeypatch.undo()
        assert sorted(map(str, got.reached.collect())) == sorted(map(str, want.reached.collect())) and got.truncated == want.truncated


def test_innermost_symbols_equal_all_pairs(spark, rows_written):
    r = random.Random(9)
    syms = [(f"s{i:03}", f"f{r.randrange(2)}", a, a + r.choice([-1, 0, 0, 1, 2, 5, 30, 200])) for i, a in ((i, r.randrange(-5, 300)) for i in range(300))]
    points = [(f"f{r.randrange(3)}", r.randrange(-10, 350)) for _ in range(400)]
    counts = rows_written(changes)
    s = spark.createDataFrame(syms, "id string, file string, start_line int, end_line int")
    got = {(x["file"], x["line"]): x["id"] for x in changes.innermost_symbols(spark.createDataFrame(points, "file string, line int").distinct(), s).collect()}
    want = {}
    for file, line in points:
        around = [(b - a, i) for i, f, a, b in syms if f == file and a <= line <= b]
        want[file, line] = min(around)[1] if around else f"file:{file}"
    # A span of 200 lines has 14 blocks at most; no row for a line and a symbol around it.
    assert got == want and max(counts) <= 14 * len(syms)


def test_calls_of_one_kind_are_told_once(spark, rows_written):
    from ripplegraph.operators import hierarchy

    types = spark.createDataFrame([("B",), ("A",)], "id string")
    closure = spark.createDataFrame([("B", "B", 0), ("B", "A", 1), ("A", "A", 0)], "id string, above string, distance int")
    methods = spark.createDataFrame([(f"m{i:02}", "A", "f", f"s{i % 10}", 1, False) for i in range(30)] + [("n", "B", "f", "s3", 1, False)], "id string, owner string, name string, signature string, params int, varargs boolean")
    calls = spark.createDataFrame([(f"c{i:02}", "B", "f", 1 if i % 2 else None) for i in range(60)] + [("c00", "A", "f", 1), ("d", "A", "g", None), ("d", "A", "g", 2)], "call string, type string, name string, arity int")
    counts = rows_written(hierarchy)
    got = [tuple(r) for r in hierarchy.method_candidates(calls, closure, types.filter("id = 'A'"), methods).collect()]
    want = {f"m{i:02}" for i in range(10) if i != 3} | {"n"}
    # c00 has a row of A too, of which m03 is as near as n is of B.
    kept = lambda i, m: "m03" if (i, m) == (0, "n") else m
    assert sorted(got, key=str) == sorted([(f"c{i:02}", kept(i, m), 3, "FOUND") for i in range(60) for m in want] + 2 * [("d", None, None, "EXTERNAL")], key=str)
    assert max(counts) <= 63


def test_impact_of_every_part_goes_all_the_way(spark):
    got = QUERIES["impact_of_every_part"](spark, "/root/testdata/sf0.001")
    assert {r["depth"] for r in got.select("depth").distinct().collect()} == {1, 2, 3, 4, 5, 6}
    one = QUERIES["impact_bfs"](spark, "/root/testdata/sf0.001").select("id", "depth", "strength", "parent")
    assert sorted(map(tuple, got.filter("query = 7").select(one.columns).collect())) == sorted(map(tuple, one.collect()))


def test_symbols_that_lead_nowhere_have_no_row_for_each_query(spark, rows_written):
    # Ten methods in a line, each with 40 callers that nothing depends on.
    rows = [(f"m{i}", f"m{i - 1}", "OVERRIDES", 5, 1) for i in range(1, 10)] + [(f"c{i}-{j:02}", f"m{i}", "CALLS", 5, 1) for i in range(10) for j in range(40)]
    counts = rows_written(graph)
    got = graph.impact_many(edges(spark, rows), spark.createDataFrame([(i, f"m{i}") for i in range(10)], "query int, id string"))
    steps = 18 + 400
    assert max(counts) <= steps
    # Five steps to either side, and the callers of these; six for methods.
    assert got.count() == sum(abs(i - j) <= 6 for i in range(10) for j in range(10)) - 10 + 40 * sum(abs(i - j) <= 5 for i in range(10) for j in range(10))


def test_impact_of_many_roots_by_short_lists(spark, monkeypatch):
    r = random.Random(21)
    rows = list({(f"s{r.randrange(30):02}", f"s{r.randrange(14):02}", r.choice(["CALLS", "CALLS", "OVERRIDES", "CONTAINS"])): 0 for _ in range(90)})
    rows = [(*x, s, line) for x in rows for s, line in ((r.choice([3, 4]), 2), (r.choice([3, 5]), 1))]
    # Roots that lead nowhere, that lead further, that are no symbols of the graph, and twice the same.
    roots = [(q, f"s{(q * 7 + k * 11) % 32:02}") for q in range(12) for k in range(3)] + [(3, "s21")]
    want = {(q, k, *v[:3]) for q in range(12) for k, v in brute(rows, {i for p, i in roots if p == q}, depth=3)[0].items()}
    for name, value in (("LISTED", 2), ("TASK_WAYS", 5), ("BROADCAST_ROWS", 1)):
        monkeypatch.setattr(graph, name, value)
    df = spark.createDataFrame(roots, "query int, id string")
    got = [tuple(x) for x in graph.impact_many(edges(spark, rows), df, 3).collect()]
    assert len(got) == len(set(got)) == len(want) > 100 and set(got) == want
    assert graph.impact_many(edges(spark, rows), df, 0).count() == 0
