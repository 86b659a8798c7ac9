import random

from pyspark.sql import functions as F

from ripplegraph.operators import assessment, changes, evidence, lines, selection
from ripplegraph.session import placed


def greedy(rows):
    s, t, out = set(), set(), []
    for a, b, x in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in s and b not in t:
            s.add(a)
            t.add(b)
            out.append((a, b, x))
    return sorted(out)


def test_greedy_pairs_are_all_found(spark, monkeypatch):
    # A chain of ties that a round can only shorten by one, and random candidates.
    chain = [(f"s{i:03}", f"t{i:03}", 90) for i in range(120)] + [(f"s{i:03}", f"t{i - 1:03}", 90) for i in range(1, 120)]
    r = random.Random(1)
    wild = list({(f"s{r.randrange(60)}", f"t{r.randrange(60)}"): 0 for _ in range(500)})
    wild = [(a, b, r.randrange(50, 101)) for a, b in wild]
    for rows, few, rounds in ((chain, 20_000, 8), (wild, 20_000, 8), (wild, 30, 8), (chain + wild, 10, 1)):
        monkeypatch.setattr(changes, "FEW_PAIRS", few)
        monkeypatch.setattr(changes, "ROUNDS", rounds)
        got = changes.greedy_pairs(spark.createDataFrame(rows, "source string, target string, similarity bigint")).collect()
        assert sorted(map(tuple, got)) == greedy(rows)


def test_files_that_are_all_alike_take_one_round(spark, monkeypatch):
    monkeypatch.setattr(changes, "FEW_PAIRS", 50)
    monkeypatch.setattr(changes, "ROUNDS", 2)
    monkeypatch.setattr(changes, "_by_component", lambda left: (_ for _ in ()).throw(AssertionError("candidates are left")))
    blocks = [(f"s{k}-{i:03}", f"t{k}-{j:03}", 60 + k) for k, (n, m) in enumerate(((60, 60), (20, 5), (3, 30))) for i in range(n) for j in range(m)]
    # A block is not even where one of its files has a better candidate.
    blocks += [("s3-a", "t3-a", 80), ("s3-a", "t3-b", 80), ("s3-b", "t3-a", 90), ("s3-b", "t3-b", 70)]
    got = changes.greedy_pairs(spark.createDataFrame(blocks, "source string, target string, similarity bigint"))
    assert sorted(map(tuple, got.collect())) == greedy(blocks)


def test_even_blocks_are_those_of_the_greedy_order(spark):
    r = random.Random(7)
    for _ in range(3):
        rows = {(f"s{r.randrange(12)}", f"t{r.randrange(12)}"): r.choice([60, 60, 70, 80]) for _ in range(40)}
        rows = [(a, b, x) for (a, b), x in rows.items()]
        got = {tuple(x) for x in changes._even_blocks(spark.createDataFrame(rows, "source string, target string, similarity bigint")).collect()}
        assert got <= set(greedy(rows))


def test_rename_candidates_equal_all_pairs(spark):
    r = random.Random(4)
    common = ["{", "}", "", "return;"]

    def text():
        return "\n".join(r.choice(common) if r.random() < 0.5 else f"line {r.randrange(25)}" for _ in range(r.randrange(1, 30)))

    d, a = ([(f"{side}/{i}.{'ts' if i % 3 else 'java'}", text()) for i in range(40)] for side in "da")
    got = changes.rename_candidates(spark.createDataFrame(d, "path string, text string"), spark.createDataFrame(a, "path string, text string"))
    want = set()
    for p, x in d:
        for q, y in a:
            u, v = lines.split_lines(x), lines.split_lines(y)
            sim = 200 * sum(min(u.count(z), v.count(z)) for z in set(u)) // (len(u) + len(v)) if u or v else 0
            if p.rsplit(".", 1)[1] == q.rsplit(".", 1)[1] and sim >= 50:
                want.add((p, q, sim))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 20
    exact = {(p, q, lines.similarity(x, y)) for p, x in d for q, y in a if p.rsplit(".", 1)[1] == q.rsplit(".", 1)[1]}
    files = (spark.createDataFrame(x, "path string, text string") for x in (d, a))
    assert {tuple(x) for x in changes.alike(*files).collect()} == {x for x in exact if x[2] >= 50} != want


def test_renames_take_equal_files_first(spark):
    d = spark.createDataFrame([("a.ts", "h1", "x\ny\nz"), ("b.ts", "h1", "x\ny\nz"), ("c.ts", "h2", "p\nq\nr\ns"), ("e.ts", "h3", None)], "path string, blob string, text string")
    a = spark.createDataFrame([("n.ts", "h1", "x\ny\nz"), ("m.ts", "h9", "p\nq\nr\nt"), ("o.ts", "h8", "nothing")], "path string, blob string, text string")
    assert sorted(map(tuple, changes.renames(d, a).collect())) == [("a.ts", "n.ts", 100), ("c.ts", "m.ts", 75)]


def test_insertions_belong_to_the_symbols_around(spark):
    syms = spark.createDataFrame([("one", "f", 1, 5), ("two", "f", 6, 9), ("in", "f", 2, 4)], "id string, file string, start_line int, end_line int")
    hunks = spark.createDataFrame([("f", 5, 0), ("f", 2, 0), ("f", 4, 3), ("f", 20, 1)], "file string, start int, len int")
    got = {}
    for r in changes.touched_symbols(hunks, syms).collect():
        got.setdefault(r["start"], set()).add(r["id"])
    # Between line 5 and 6 only the file is around both; between 2 and 3 the inner symbol is, between 4 and 5 the outer one.
    assert got == {2: {"in"}, 4: {"in", "one", "two"}, 5: {"file:f"}, 20: {"file:f"}}
    got = changes.touched_symbols(spark.createDataFrame([("f", 4, 0)], "file string, start int, len int"), syms).collect()
    assert [r["id"] for r in got] == ["one"]


def test_hunks_of_files_and_what_they_touch(spark):
    body = "class A {\n  f() {\n    one\n  }\n}\n"
    more = "class A {\n  f() {\n    two\n  }\n  g() {\n  }\n}\n"
    base = spark.createDataFrame([("a", body), ("old", body), ("gone", "x\n"), ("bin", None)], "path string, text string")
    head = spark.createDataFrame([("a", more), ("new", body + "\n"), ("come", "y\nz\n"), ("bin", "t\n")], "path string, text string")
    changed = spark.createDataFrame([("a", None, "MODIFIED"), ("new", "old", "RENAMED"), ("gone", None, "DELETED"), ("come", None, "ADDED"), ("bin", None, "MODIFIED")], "path string, old_path string, change string")
    syms = lambda rows: spark.createDataFrame(rows, "id string, kind string, file string, start_line int, end_line int")
    before = syms([("A", "class", "a", 1, 5), ("A.f", "method", "a", 2, 4), ("O", "class", "old", 1, 5)])
    after = syms([("A", "class", "a", 1, 7), ("A.f", "method", "a", 2, 4), ("A.g", "method", "a", 5, 6), ("N", "class", "new", 1, 5)])
    got = sorted(tuple(r) for r in changes.file_hunks(changed, base, head, before, after).collect())
    assert got == [
        ("a", "a", 3, 1, 3, 3, ["A.f"], ["A.f", "A.g"]),
        ("come", None, 0, 0, 1, 2, [], ["file:come"]),
        ("gone", "gone", 1, 1, 0, 0, ["file:gone"], []),
        ("new", "old", 5, 0, 6, 1, ["file:old"], ["file:new"]),
    ]

def test_classification_with_signatures_and_moves(spark):
    schema = "id string, kind string, owner string, name string, fp string"
    base = spark.createDataFrame([("C#f(int)", "method", "C", "f", "1"), ("C#g", "method", "C", "g", "2"), ("D#h", "method", "D", "h", "3"), ("D#k", "method", "D", "k", "4")], schema)
    head = spark.createDataFrame([("C#f(long)", "method", "C", "f", "9"), ("C#g", "method", "C", "g", "5"), ("E#h", "method", "E", "h", "3"), ("E#n", "method", "E", "n", "8")], schema)
    got = {r["id"]: (r["change"], r["previous"], r["probable_move"]) for r in changes.classified(base, head).collect()}
    assert got == {"C#f(long)": ("SIGNATURE_CHANGED", "C#f(int)", False), "C#g": ("MODIFIED", None, False), "D#h": ("DELETED", None, False), "D#k": ("DELETED", None, False), "E#h": ("ADDED", "D#h", True), "E#n": ("ADDED", None, False)}
    roots = {tuple(r) for r in changes.impact_roots(changes.classified(base, head)).collect()}
    assert {("head", "C#f(long)"), ("base", "C#f(int)"), ("base", "D#k")} <= roots


def test_places_by_ranges(spark):
    df = spark.range(2000).selectExpr("cast(id % 7 = 0 as int) AS g", "(id * 7919) % 1999 AS v", "id").withColumn("g", F.when(F.col("id") % 11 != 0, F.col("g")))
    got = sorted((str(r["g"]), r["v"], r["id"], r["n"]) for r in placed(df, [F.col("v"), F.col("id")], "n", ["g"]).collect())
    seen = {}
    for g, _, _, n in got:
        seen[g] = seen.get(g, 0) + 1
        assert n == seen[g]


def test_medians_and_ranks(spark):
    rows = [("a", x) for x in (5, 1, 3, 3)] + [("b", 7)] + [("c", None)]
    got = dict(map(tuple, evidence.upper_medians(spark.createDataFrame(rows, "k string, v bigint"), "k", "v", "m").collect()))
    assert got == {"a": 3, "b": 7, "c": None}
    r = random.Random(2)
    xs = [(f"g{i % 3}", float(r.randrange(300))) for i in range(900)]
    for row in selection.nearest_ranks(spark.createDataFrame(xs, "g string, v double"), "g", "v").collect():
        s = sorted(v for g, v in xs if g == row["g"])
        assert (row["n"], row["p50"], row["p95"], row["low"], row["high"]) == (300, s[149], s[284], s[0], s[-1])


def test_cases_selectors_and_tool_paths(spark):
    tests = spark.createDataFrame([("java:C#t", "C", "t"), ("ts:web/a.test.ts#test:adds", "web/a.test.ts", "adds")], "id string, owner string, name string")
    cases = spark.createDataFrame([(1, "C", "t", None), (2, "other", "adds", "web/a.test.ts"), (3, "web/a.test.ts", "adds", None), (4, "C", "no", None)], "case_id int, classname string, name string, file string")
    got = dict(map(tuple, evidence.mapped_cases(cases, tests).collect()))
    assert got == {1: "java:C#t", 2: "ts:web/a.test.ts#test:adds", 3: "ts:web/a.test.ts#test:adds", 4: None}
    syms = spark.createDataFrame([("file:a.ts",), ("java:p.C",), ("x",)], "id string")
    got = dict(map(tuple, selection.resolved_tests(spark.createDataFrame([("a.ts",), ("p.C",), ("x",), ("y",)], "selector string"), syms).collect()))
    assert got == {"a.ts": "file:a.ts", "p.C": "java:p.C", "x": "x", "y": None}
    files = spark.createDataFrame([("src/a.ts",), ("lib/b.ts",), ("web/b.ts",)], "path string")
    raw = spark.createDataFrame([("C:\\Work\\src\\a.ts",), ("./a.ts",), ("b.ts",), ("lib/b.ts",)], "raw string")
    got = dict(map(tuple, evidence.mapped_paths(raw, files, "c:/work").collect()))
    assert got == {"C:\\Work\\src\\a.ts": "src/a.ts", "./a.ts": "src/a.ts", "b.ts": None, "lib/b.ts": "lib/b.ts"}


def test_lists_tell_how_many_there_are(spark):
    got = assessment.listed(spark.range(30).selectExpr("id"), ["id"], 5).collect()
    assert [r["id"] for r in got] == list(range(5)) and {r["of"] for r in got} == {30}
