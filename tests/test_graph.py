import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ripplegraph.operators import graph
from ripplegraph.schema import EDGE_KINDS

E = "f string, t string, kind string, kind_ord int, strength int, ev_ord int, file string, line int, rule string"


def edges(spark, rows):
    return spark.createDataFrame([(f, t, k, EDGE_KINDS.index(k), s, 5 - s, "file", line, "rule") for f, t, k, s, line in rows], E)


def reach(spark, rows, *roots, **options):
    got = graph.impact(edges(spark, rows), spark.createDataFrame([(r,) for r in roots], "id string"), **options)
    return {r["id"]: r for r in got.reached.collect()}, got.truncated


def brute(rows, roots, depth=6, cap=5000):
    """The traversal row by row."""
    seen, frontier, found = {r: 5 for r in roots}, set(roots), {}
    for d in range(1, depth + 1):
        best = {}
        for f, t, k, s, line in rows:
            hops = [(t, f, False)] if k not in ("CONTAINS", "IMPORTS") else []
            hops += [(f, t, True)] if k == "OVERRIDES" else []
            for n, nxt, via in hops:
                if n in frontier and nxt not in seen:
                    key = (-min(seen[n], s), n, f, t, EDGE_KINDS.index(k), 5 - s, "file", line, "rule", via)
                    best[nxt] = min(best.get(nxt, key), key)
        left = cap - len(found)
        taken = sorted(best)[:left]
        for n in taken:
            seen[n] = -best[n][0]
            found[n] = (d, -best[n][0], best[n][1], best[n][-1])
        if len(best) > left:
            return found, True
        frontier = set(taken)
    return found, False


def test_depth_cycle_containment_and_dispatch(spark):
    rows = [("b", "a", "CALLS", 5, 1), ("c", "b", "CALLS", 5, 2), ("a", "c", "CALLS", 5, 3), ("p", "a", "CONTAINS", 5, 1), ("i", "a", "IMPORTS", 5, 1), ("impl", "decl", "OVERRIDES", 3, 1), ("user", "decl", "CALLS", 5, 1)]
    got, _ = reach(spark, rows, "a")
    assert {k: v["depth"] for k, v in got.items()} == {"b": 1, "c": 2} and got["c"]["hops"] == ["b CALLS a", "c CALLS b"]
    got, _ = reach(spark, rows, "impl")
    assert got["decl"]["via_dispatch"] and (got["user"]["depth"], got["user"]["strength"]) == (2, 3)
    assert reach(spark, rows, "unknown") == ({}, False)


def test_better_evidence_and_truncation(spark):
    rows = [("x", "a", "CALLS", 3, 1), ("y", "a", "CALLS", 5, 1), ("z", "x", "CALLS", 5, 1), ("z", "y", "CALLS", 4, 1)]
    got, _ = reach(spark, rows, "a")
    assert (got["z"]["parent"], got["z"]["strength"]) == ("y", 4)
    got, truncated = reach(spark, rows, "a", max_impacted=1)
    assert set(got) == {"x"} and truncated
    got, truncated = reach(spark, rows, "a", max_depth=1)
    assert set(got) == {"x", "y"} and not truncated


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11), st.sampled_from(["CALLS", "REFERENCES", "OVERRIDES", "CONTAINS"]), st.integers(1, 5), st.integers(1, 9)), max_size=40), st.integers(1, 12))
def test_random_graphs_equal_brute_force(spark, found, cap):
    rows = list({(f, t, k): (f"s{f:02}", f"s{t:02}", k, s, line) for f, t, k, s, line in found}.values())
    got, truncated = reach(spark, rows, "s00", "s01", max_impacted=cap)
    want, cut = brute(rows, ["s00", "s01"], cap=cap)
    assert {k: (v["depth"], v["strength"], v["parent"], v["via_dispatch"]) for k, v in got.items()} == want and truncated == cut
    for k, v in got.items():
        assert len(v["hops"]) == v["depth"] and v["root"] in ("s00", "s01")
    many = graph.impact_many(edges(spark, rows), spark.createDataFrame([(1, "s00"), (1, "s01"), (2, "s05")], "query int, id string"))
    want, _ = brute(rows, ["s00", "s01"])
    assert {r["id"]: (r["depth"], r["strength"], r["parent"]) for r in many.filter("query = 1").collect()} == {k: v[:3] for k, v in want.items()}


def test_paths(spark):
    rows = [("a", "b", "CALLS", 5, 1), ("b", "c", "IMPORTS", 5, 1), ("a", "x", "CONTAINS", 5, 1), ("x", "c", "CALLS", 5, 1)]
    g = edges(spark, rows)
    assert [(r["f"], r["t"]) for r in graph.dependency_path(g, "a", "c").hops.orderBy("hop").collect()] == [("a", "b"), ("b", "c")]
    assert graph.dependency_path(g, "c", "a").hops.count() == 0 and graph.dependency_path(g, "a", "a").hops.count() == 0
    assert graph.dependency_path(g, "a", "c", max_depth=1).hops.count() == 0
    # No path, and a search that gave up, are told apart.
    wide = edges(spark, [("a", f"n{i}", "CALLS", 5, 1) for i in range(20)] + [("n7", "end", "CALLS", 5, 1)])
    assert graph.dependency_path(wide, "a", "end", max_visited=10).truncated and not graph.dependency_path(wide, "a", "none").truncated
    back = graph.path_either_way(g, "c", "a")
    assert back.hops.count() == 2 and back.hops.first()["reversed"]


def first_by_queue(rows, test, critical, max_depth, max_seen):
    out = {}
    for f, t, kind, *_ in rows:
        if kind not in ("CONTAINS", "IMPORTS", "TESTS"):
            out.setdefault(f, set()).add(t)
    seen, queue = {test}, [(test, 0)]
    for at, depth in queue:
        if depth and at in critical:
            return at, depth
        if depth >= max_depth or len(seen) >= max_seen:
            continue
        for t in sorted(out.get(at, ())):
            if t not in seen:
                seen.add(t)
                queue.append((t, depth + 1))
    return None


@pytest.mark.parametrize(("max_depth", "max_seen"), [(6, 5000), (4, 7), (3, 3), (1, 5000)])
def test_first_critical_symbol_is_that_of_a_queue(spark, max_depth, max_seen):
    r = random.Random(max_seen)
    rows = list({(f"s{r.randrange(40):02}", f"s{r.randrange(40):02}", r.choice(["CALLS", "CALLS", "REFERENCES", "TESTS", "IMPORTS"])): 0 for _ in range(90)})
    rows = [(*x, 5, 1) for x in rows]
    tests, critical = [f"s{i:02}" for i in range(15)], {f"s{i:02}" for i in range(30, 40)} | {"s03"}
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "id string")
    got = {x["test"]: (x["id"], x["depth"]) for x in graph.first_critical(edges(spark, rows), one(tests), one(critical), max_depth, max_seen).collect()}
    want = {t: first_by_queue(rows, t, critical, max_depth, max_seen) for t in tests}
    assert got == {t: w for t, w in want.items() if w}


def test_ancestors_of_one_commit(spark):
    r = random.Random(3)
    up = [(f"c{i}", f"c{i - 1}") for i in range(1, 300)] + [(f"c{i}", f"c{r.randrange(i)}") for i in range(20, 300, 17)] + [("x", "y"), ("c5", None), ("z", "z")]
    df = spark.createDataFrame(up, "id string, parent string")
    assert {x["id"] for x in graph.ancestors_of(df, "c250").collect()} == {f"c{i}" for i in range(251)}
    assert [x["id"] for x in graph.ancestors_of(df, "none").collect()] == ["none"]
    with pytest.raises(ValueError):
        graph.ancestors_of(df, "c250", most=100)


def test_ancestors_that_grow_are_not_broadcast(spark, monkeypatch):
    chain = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 200)] + [(f"c{i}", f"s{i}") for i in range(0, 200, 9)], "id string, parent string")
    plans = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    monkeypatch.setattr(graph, "FEW_ABOVE", 0, raising=False)
    assert graph.ancestors_of(chain, "c150").count() == 151 + 17
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert graph.ancestors_of(chain, "c150", most=None).count() == 151 + 17
    with pytest.raises(ValueError):
        graph.ancestors_of(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"), "a", most=None)


def test_more_roots_than_may_be_reached(spark):
    rows = [(f"u{i}", f"r{i}", "CALLS", 5, 1) for i in range(5500, 6000)]
    g = edges(spark, rows)
    got = graph.impact(g, spark.range(6000).selectExpr("concat('r', id) AS id"))
    assert got.reached.count() == 500 and not got.truncated
    got = graph.impact(g, spark.range(6000).selectExpr("concat('r', id) AS id"), max_impacted=499)
    assert got.reached.count() == 499 and got.truncated


def test_long_chains_of_parents(spark):
    chain = spark.range(1, 41).selectExpr("cast(id as string) AS id", "cast(id - 1 as string) AS parent")
    got = {(r["id"], r["ancestor"]): r["distance"] for r in graph.parent_closure(chain).collect()}
    assert got == {(str(i), str(j)): i - j for i in range(1, 41) for j in range(i)}
    # Several parents and a cycle.
    rows = [("m", "a"), ("m", "b"), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "y")]
    got = {(r["id"], r["ancestor"]): r["distance"] for r in graph.parent_closure(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got == {("m", "a"): 1, ("m", "b"): 1, ("m", "r"): 2, ("a", "r"): 1, ("b", "a"): 1, ("b", "r"): 2, ("x", "y"): 1, ("x", "z"): 2, ("y", "z"): 1, ("z", "y"): 1}


def strong(pairs):
    """Cycles by reaching to and fro."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    all_ = {x: reach(x) for p in pairs for x in p}
    return {x: min(y for y in r | {x} if y == x or (y in r and x in all_[y])) for x, r in all_.items() if any(y != x and x in all_[y] for y in r)}


@pytest.mark.parametrize("task_edges", [200_000, 40, 6, 0])
def test_cycles_of_random_graphs(spark, task_edges):
    r = random.Random(task_edges)
    pairs = list({(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(75)}) + [("x", "x"), ("p", "q"), ("q", "p"), ("q", "r")]
    got = graph.cycles(spark.createDataFrame(pairs, "a string, b string"), task_edges).collect()
    assert len(got) == len({x["member"] for x in got}) and {x["member"]: x["cycle"] for x in got} == strong(pairs)


def test_components_of_chains_and_rings(spark):
    pairs = [(i, i + 1) for i in range(400)] + [(1000 + i, 1000 + (i * 7 + 3) % 50) for i in range(50)] + [(2000, 2000)]
    got = {x["id"]: x["component"] for x in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(401)) and got[2000] == 2000
    assert {got[a] == got[b] for a, b in pairs} == {True}


def test_a_ring_of_ten_thousand(spark):
    got = graph.cycles(spark.range(10_000).selectExpr("id AS a", "(id + 1) % 10000 AS b")).agg({"cycle": "max", "member": "count"}).first()
    assert tuple(got) in ((0, 10_000), (10_000, 0))


def test_a_large_ring_is_one_cycle(spark):
    ring = spark.range(131).selectExpr("format_string('n%03d', id) AS a", "format_string('n%03d', (id + 1) % 131) AS b")
    got = graph.cycles(ring)
    assert got.count() == 131 and {r["cycle"] for r in got.collect()} == {"n000"}
    assert graph.cycle_edges(ring.union(spark.createDataFrame([("n000", "out")], "a string, b string")), got).count() == 131


def test_symbol_bundle_slice_and_suggestions(spark):
    g = edges(spark, [("b", "a", "CALLS", 5, 1), ("t", "b", "TESTS", 5, 1), ("a", "x", "CALLS", 5, 1)])
    syms = spark.createDataFrame([(i, "function", "f.ts", i == "t", "m" if i < "t" else "n") for i in "abtx"], "id string, kind string, file string, is_test boolean, module string")
    reached = graph.impact(g, spark.createDataFrame([("a",)], "id string")).reached
    assert tuple(graph.symbol_info(g, syms, reached, "a").first()) == ("a", "function", "f.ts", 1, 1, 2, 1)
    nodes = graph.slice_nodes(syms.filter("id = 'a'"), reached, 2)
    assert [r["id"] for r in nodes.collect()] == ["a", "b"]
    assert graph.touched_modules(syms.filter("id = 'a'"), reached, syms).first()["modules"] == 2
    assert graph.with_hub(g, syms).first()["id"] == "a" and graph.involving(g, "x").count() == 1
    ids = spark.createDataFrame([("java:shop.Cart#sum()",), ("java:shop.Cart",), ("java:shop.Price",)], "id string")
    assert [r["id"] for r in graph.suggestions(ids, "store.Cart#sum(int)").collect()] == ["java:shop.Cart#sum()"]
    assert [r["id"] for r in graph.suggestions(ids, "shop.price").collect()] == ["java:shop.Price"]


def test_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("y", "x")], "a string, b string")
    assert sorted(map(tuple, graph.cycles(pairs).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_shuffled_edges_give_the_same(spark):
    rows = [(f"n{i % 17:02}", f"n{(i * 7) % 13:02}", "CALLS", 1 + i % 5, i % 4 + 1) for i in range(60)]
    a = graph.graph_edges(edges(spark, rows)).orderBy("f", "t").collect()
    assert a == graph.graph_edges(edges(spark, rows[::-1]).repartition(7)).orderBy("f", "t").collect()
