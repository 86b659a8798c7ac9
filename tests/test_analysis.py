import pytest

from ripplegraph.operators import extraction
from ripplegraph.plans import analysis, replay, store
from ripplegraph.sources import cases, policy
from ripplegraph.sources.policy import parse_policy

BASE = {
    "src/main/shop/Price.java": """package shop;
/* two
   lines { */
public class Price {
  public int total(int n) {
    return n * unit("{");  // }
  }
  private int unit(String s) { return 3; }
}
""",
    "src/main/shop/api/Cart.java": """package shop.api;
import shop.Price;
public class Cart extends Base {
  public int sum() {
    Price p = new Price();
    return p.total(2);
  }
  public int old() { return 1; }
}
""",
    "src/main/shop/api/Base.java": "package shop.api;\npublic class Base {\n}\n",
    "src/test/shop/CartTest.java": """package shop.api;
class CartTest {
  @Test
  void sums() {
    new Cart().sum();
  }
}
""",
    "web/cart.ts": "import { price } from './lib/price';\nexport function show(n: number) {\n  return price(n);\n}\n",
    "web/lib/price.ts": "export const price = (n: number) => {\n  return n;\n};\n",
    "db/migrate/1.sql": "create table a;",
}
POLICY = parse_policy('version: 1\narchitecture:\n  layers: [{name: api, match: ["src/main/shop/api/**"]}, {name: core, match: ["src/main/shop/*"]}]\n  rules: [{from: core, deny: [api]}]\n')


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    head = dict(BASE)
    head["src/main/shop/Price.java"] = BASE["src/main/shop/Price.java"].replace("return 3;", "return new shop.api.Base().hashCode();").replace("two", "three")
    head["src/main/shop/api/Cart.java"] = BASE["src/main/shop/api/Cart.java"].replace("  public int old() { return 1; }\n", "")
    head["db/migrate/2.sql"] = "alter table a;"
    return analysis.snapshot(spark, put(tmp_path_factory.mktemp("base"), BASE)), analysis.snapshot(spark, put(tmp_path_factory.mktemp("head"), head))


def test_symbols(two):
    got = {r["id"]: r for r in two[0].symbols.collect()}
    total = got["java:shop.Price#total"]
    assert (total["start_line"], total["end_line"], total["parent"], total["visibility"]) == (5, 7, "java:shop.Price", "public")
    assert got["java:shop.Price"]["end_line"] == 9 and got["java:shop.Price"]["parent"] == "file:src/main/shop/Price.java"
    assert (got["java:shop.Price#unit"]["start_line"], got["java:shop.Price#unit"]["end_line"], got["java:shop.Price#unit"]["visibility"]) == (8, 8, "private")
    assert got["java:shop.api.CartTest#sums"]["is_unit"] and got["java:shop.api.CartTest"]["is_test"]
    assert "typescript:web/lib/price.ts#price" in got and got["typescript:web/cart.ts#show"]["kind"] == "function"


def test_edges(two):
    got = {(r["f"], r["kind"], r["t"]) for r in two[0].edges.collect()}
    assert {
        ("java:shop.Price#total", "CALLS", "java:shop.Price#unit"),
        ("java:shop.api.Cart#sum", "CALLS", "java:shop.Price#total"),
        ("java:shop.api.Cart#sum", "INSTANTIATES", "java:shop.Price"),
        ("java:shop.api.Cart", "EXTENDS", "java:shop.api.Base"),
        ("java:shop.api.CartTest#sums", "CALLS", "java:shop.api.Cart#sum"),
        ("file:src/main/shop/api/Cart.java", "IMPORTS", "java:shop.Price"),
        ("file:web/cart.ts", "IMPORTS", "file:web/lib/price.ts"),
        ("typescript:web/cart.ts#show", "CALLS", "typescript:web/lib/price.ts#price"),
        ("java:shop.Price", "CONTAINS", "java:shop.Price#total"),
    } <= got


def test_analysis(spark, two):
    a = analysis.analyze(*two, POLICY)
    changed = {r["id"]: r["change"] for r in a.changed.collect()}
    assert changed["java:shop.Price#unit"] == "MODIFIED" and changed["java:shop.api.Cart#old"] == "DELETED" and "java:shop.Price#total" not in changed
    reached = {r["id"]: r["depth"] for r in a.impacted.collect()}
    assert reached["java:shop.Price#total"] == 1 and reached["java:shop.api.CartTest#sums"] <= 3
    tests = {r["id"]: r for r in a.tests.collect()}
    assert tests["java:shop.api.CartTest#sums"]["tier"] == "MEDIUM" and sorted(r["place"] for r in tests.values()) == list(range(1, len(tests) + 1))
    assert ("REMOVED", "java:shop.api.Cart#old") in {(r["change"], r["id"]) for r in a.surface.collect()}
    signals = {r["signal"]: (r["value"], r["points"]) for r in a.signals.collect()}
    assert len(signals) == 14 and signals["migration_changed"] == (1, 15) and signals["public_api_changed"] == (1, 8) and not a.truncated
    assert signals["critical_path_changed"] == (None, 0) and signals["flaky_impacted_tests"] == (None, 0)
    # core -> api is new and denied
    assert signals["new_architecture_violation"] == (1, 10) and signals["new_layer_cycle"] == (1, 10)
    gates = {r["gate"]: r["status"] for r in a.gates.collect()}
    assert len(gates) == 8 and gates["new_cycle"] == gates["breaking_api_change"] == "WARN" and gates["config_invalid"] == "PASS" and a.verdict.first()["result"] == "WARN"
    assert {r["reason"]: r["severity"] for r in a.reasons.collect()}["MIGRATION"] == "HIGH"
    assert tuple(a.selection.first())[:2] == ("BALANCED", "FULL_SUITE")
    found = {(r["rule"], r["level"], r["path"]) for r in a.findings.collect()}
    assert ("breaking_api_change", "warning", "src/main/shop/api/Cart.java") in found and {x[0] for x in found} >= {"breaking_api_change", "new_architecture_violation"}
    hunks = {(r["path"], r["old_start"], r["new_start"]): r for r in a.hunks.collect()}
    assert any("java:shop.Price#unit" in r["head_symbols"] for r in hunks.values()) and ("db/migrate/2.sql", 0, 1) not in hunks
    lists = analysis.report(a)
    assert all(df.count() >= 0 for df in lists.values()) and lists["changed"].first()["of"] == len(changed)
    assert analysis.check(two[1], POLICY).count() == 1


def test_analysis_with_evidence_and_a_changed_policy(spark, two):
    covered = spark.createDataFrame([("java:shop.api.CartTest#sums", "java:shop.Price#unit", "jacoco", "c1")], "test string, id string, format string, commit string")
    measured = spark.createDataFrame([("src/main/shop/Price.java", "c1"), ("src/main/shop/api/Cart.java", "c1")], "file string, commit string")
    test = "java:shop.api.CartTest#sums"
    history = spark.createDataFrame([(test, 1, "c0", "PASSED", 5, 0), (test, 2, "c0", "FAILED", 9, 0), (test, 3, "c1", "PASSED", 7, 0)], "test string, run_id bigint, commit string, outcome string, duration_ms bigint, failed_attempts int")
    rules_of = parse_policy('version: 1\ncritical: ["src/main/shop/*"]\npolicy:\n  fail_on: [config_changed]\n')
    rules = [(1, "^src/.*$", ["@code"])]
    a = analysis.analyze(*two, rules_of, analysis.Evidence(covered, measured, history), "FAST_FEEDBACK", rules, True, ["head: bad"])
    coverage = {r["id"]: r["coverage"] for r in a.changed.collect()}
    assert coverage["java:shop.Price#unit"] == "COVERED"
    row = {r["id"]: r for r in a.tests.collect()}[test]
    # Coverage leads straight from the test to the changed symbol.
    assert (row["depth"], row["tier"], row["reliability"], row["duration_ms"]) == (1, "STRONG", "FLAKY", 7)
    signals = {r["signal"]: r["value"] for r in a.signals.collect()}
    assert signals["critical_path_changed"] == 1 and signals["flaky_impacted_tests"] == 1 and signals["config_changed"] == 1 and signals["new_layer_cycle"] is None
    gates = {r["gate"]: r["status"] for r in a.gates.collect()}
    assert gates["config_changed"] == gates["config_invalid"] == "FAIL" and a.verdict.first()["result"] == "FAIL"
    assert {r["owner"] for r in a.owners.collect()} == {"@code", None}
    assert tuple(a.selection.first())[:3] == ("FAST_FEEDBACK", "SELECTED", 1)


def test_strings_and_comments_do_not_break_the_nesting(spark):
    java = '''package p;
class A {
  void one(String x) { // "not a string
    if (x.equals("http://y")) {
      String a = "a/*"; char c = '"'; String b = "*/b";
    }
  }
  void two() { three("{"); }
  /* { " */
  void three(String s) {
    String t = """
      a { "b" // c
      """;
  }
}
class B extends A {
  void three(String other) { unknown(); two(); }
  void two(int n) { other.three(n); }
}
'''
    ts = "export function f(g: string) {\n  const u = `a ${g} { // `;\n  return h('src/**/*.ts');\n}\nexport function h(x: string) {\n  return x;\n}\n"
    files = spark.createDataFrame([("A.java", "java", java), ("f.ts", "typescript", ts)], "path string, language string, text string")
    syms, edges, open_, _ = extraction.extracted(files)
    got = {r["id"]: (r["start_line"], r["end_line"]) for r in syms.collect() if r["kind"] != "file"}
    assert got == {"java:p.A": (2, 15), "java:p.A#one": (3, 7), "java:p.A#two": (8, 8), "java:p.A#three": (10, 14), "java:p.B": (16, 19), "java:p.B#three": (17, 17), "java:p.B#two": (18, 18), "typescript:f.ts#f": (1, 4), "typescript:f.ts#h": (5, 7)}
    have = {(r["f"], r["kind"], r["t"]) for r in edges.collect()}
    assert ("typescript:f.ts#f", "CALLS", "typescript:f.ts#h") in have
    # Erased parameters decide: two(int) overrides nothing.
    assert {(f, t) for f, k, t in have if k == "OVERRIDES"} == {("java:p.B#three", "java:p.A#three")}
    # The name is known, but not which declaration is meant; names that nobody declares are of no interest.
    assert {(r["id"], r["detail"]) for r in open_.collect()} == {("java:p.B#two", "call of three")}
    # A call without a receiver goes by the type's hierarchy and the number of arguments.
    assert {("java:p.A#two", "CALLS", "java:p.A#three"), ("java:p.B#three", "CALLS", "java:p.A#two")} <= have


def test_store_applies_by_difference(spark, two, tmp_path):
    tables = lambda s: {"symbols": s.symbols.select("id", "kind", "fp"), "files": s.files.select("path", "blob")}
    first = store.apply(spark, str(tmp_path), tables(two[0]))
    assert first["files"] == {"added": 7, "removed": 0, "updated": 0, "unchanged": 0}
    second = store.apply(spark, str(tmp_path), tables(two[1]))
    assert second["files"] == {"added": 1, "removed": 0, "updated": 2, "unchanged": 5} and second["symbols"]["removed"] == 1
    assert sorted(map(tuple, store.load(spark, str(tmp_path), "symbols").collect())) == sorted(map(tuple, tables(two[1])["symbols"].collect()))
    assert {r["path"] for r in store.missing_facts(two[1].files, two[0].files).collect()} == {"src/main/shop/Price.java", "src/main/shop/api/Cart.java", "db/migrate/2.sql"}


def test_versions_hold_what_changed(spark, tmp_path):
    import random

    r, rows, root = random.Random(3), {i: f"v{i}" for i in range(400)}, str(tmp_path)
    table = lambda: {"files": spark.createDataFrame([(f"p{i}", v) for i, v in rows.items()], "path string, blob string")}
    store.apply(spark, root, table())
    for step in range(11):
        before = dict(rows)
        for _ in range(4):
            rows.pop(r.choice(list(rows)))
            rows[r.choice(list(rows))] = f"new{step}"
            rows[1000 + r.randrange(1000)] = "added"
        n = store.apply(spark, root, table())["files"]
        changed = sum(before.get(i) != rows.get(i) for i in {*before, *rows})
        assert n["added"] + n["removed"] + n["updated"] == changed and n["unchanged"] == sum(before.get(i) == v for i, v in rows.items())
        written_ = spark.read.parquet(f"{root}/index/v{step + 2}/files").count()
        assert written_ in (changed, len(rows)) and (step > 6 or written_ == changed)
        if step in (0, 5, 10):
            assert {x["path"]: x["blob"] for x in store.load(spark, root, "files").collect()} == {f"p{i}": v for i, v in rows.items()}
            assert {x["path"]: x["blob"] for x in store.load(spark, root, "files", step + 1).collect()} == {f"p{i}": v for i, v in before.items()}
    # At some time the parts are one again; nothing new is no part at all.
    parts = store._parts(spark, root, 12)["files"]
    assert len(parts) <= store.MOST_PARTS + 1 and parts[0] > 1
    assert store.apply(spark, root, table())["files"]["unchanged"] == len(rows) and store._parts(spark, root, 13)["files"] == parts
    more = {"files": table()["files"].selectExpr("*", "'ts' AS language")}
    assert store.apply(spark, root, more)["files"]["added"] == len(rows) and store.load(spark, root, "files").columns == ["path", "blob", "language"]


def test_an_indexed_snapshot_reads_only_what_is_new(spark, tmp_path):
    index, head = str(tmp_path / "index"), dict(BASE)
    head["web/cart.ts"] = BASE["web/cart.ts"].replace("price(n)", "price(n + 1)")
    head["web/new.ts"] = "export function more() {\n}\n"
    del head["src/main/shop/api/Base.java"]
    first = analysis.snapshot(spark, put(tmp_path / "b", BASE), index)
    analysis.stored(spark, index, first)
    assert spark.read.parquet(f"{index}/read/files").count() == 6
    again = analysis.snapshot(spark, put(tmp_path / "h", head), index)
    got = analysis.stored(spark, index, again)
    assert {x["path"] for x in spark.read.parquet(f"{index}/read/files").groupBy("path").count().filter("count > 1").collect()} == {"web/cart.ts"} and spark.read.parquet(f"{index}/read/files").count() == 8
    assert got["files"] == {"added": 1, "removed": 1, "updated": 1, "unchanged": 5}
    plain = analysis.snapshot(spark, str(tmp_path / "h"))
    rows = lambda df, columns: sorted(map(str, df.select(*columns).collect()))
    for name, df in (("symbols", plain.symbols), ("edges", plain.edges), ("unresolved", plain.unresolved)):
        assert rows(store.load(spark, index, name), df.columns) == rows(df, df.columns), name


def test_empty_sources(spark):
    none = spark.createDataFrame([], "path string, language string, text string")
    syms, edges, open_, errors = extraction.extracted(none)
    assert syms.count() == edges.count() == open_.count() == errors.count() == 0


def test_replay_of_a_past_change(spark, two):
    unit = "java:shop.api.CartTest#sums"
    parents = spark.createDataFrame([("c1", "c0"), ("c2", "c1")], "id string, parent string")
    results = spark.createDataFrame([(unit, "FAILED", 7)], "test string, outcome string, duration_ms bigint")
    history = spark.createDataFrame([(unit, 1, "c0", "PASSED", 5, 0), (unit, 2, "c2", "FAILED", 9, 0)], "test string, run_id bigint, commit string, outcome string, duration_ms bigint, failed_attempts int")
    case = replay.Case("one", "c1", "c2", *two, results)
    got = {r["mode"]: r for r in replay.replay(case, parents, history, POLICY).collect()}
    assert got["FAST_FEEDBACK"]["decision"] == "SELECTED" and got["BALANCED"]["decision"] == "FULL_SUITE"  # a migration changed
    assert all((r["caught"], r["failed"], r["recall"], r["position"], r["time_ms"]) == (1, 1, 1.0, 1, 7) for r in got.values())
    means = {r["mode"]: r for r in replay.replayed(replay.replay(case, parents, history, POLICY)).collect()}
    assert means["BALANCED"]["full_suites"] == 1 and means["BALANCED"]["mean_position"] == 1.0
    assert [r["commit"] for r in replay.visible_commits(parents, "c1", "c2").orderBy("commit").collect()] == ["c0", "c1"]
    with pytest.raises(ValueError):
        replay.visible_commits(parents, "c2", "c1")


def test_command_line_policy_owners_and_cases(spark, tmp_path, capsys):
    from ripplegraph.__main__ import main

    base = put(tmp_path / "b", {"a/A.java": "package a;\npublic class A {\n  public int f() { return 1; }\n}\n", "policy.yml": "version: 1\npolicy: {fail_on: [breaking_api_change]}\n", "CODEOWNERS": "*.java @me\n"})
    head = put(tmp_path / "h", {"a/A.java": "package a;\npublic class A {\n}\n", "policy.yml": "version: 1\npolicy: {fail_on: [breaking_api_change]}\n", "docs/CODEOWNERS": "* @docs\n", "CODEOWNERS": "*.java @me\n"})
    assert main(["analyze", base, head, "--out", str(tmp_path / "out")], spark) == 1
    assert spark.read.json(f"{tmp_path}/out/api").first()["change"] == "REMOVED"
    assert main(["analyze", head, head], spark) == 0
    assert main(["check", base], spark) == 0 and main(["index", base, str(tmp_path / "store")], spark) == 0
    assert "added" in capsys.readouterr().out
    assert policy.read_owners(spark, head)[0][0][2] == ["@me"] and policy.read_owners(spark, str(tmp_path))[0] == []
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "policy.yml").write_text("version: 7\n")
    assert policy.read_policy(spark, f"{tmp_path}/bad", "policy.yml")[1] == ["version must be 1"]
    (tmp_path / "cases.json").write_text('{"cases": [{"base": "a", "head": "b", "junit": ["x.xml"]}, {"name": "n", "base": "b", "head": "c"}]}')
    got = cases.cases(spark, f"{tmp_path}/cases.json").collect()
    assert [(r["name"], r["junit"]) for r in got] == [("a..b", ["x.xml"]), ("n", [])]
    (tmp_path / "none.json").write_text('{"cases": []}')
    with pytest.raises(ValueError):
        cases.cases(spark, f"{tmp_path}/none.json")


def test_facts_and_coverage_are_stored(spark, tmp_path):
    fact = lambda payload: spark.createDataFrame([("a.ts", "b1", "x1", payload)], "path string, blob string, extractor string, payload string")
    store.put_facts(spark, str(tmp_path), fact("old"))
    store.put_facts(spark, str(tmp_path), fact("new"))
    assert [r["payload"] for r in store.facts(spark, str(tmp_path)).collect()] == ["new"]
    results = spark.createDataFrame([("t", "PASSED", 5, 1, 2), ("t", "FAILED", 3, 9, 1), ("u", "PASSED", 1, 0, 1)], "test string, outcome string, duration_ms bigint, failed_attempts int, place int")
    store.add_runs(spark, str(tmp_path), 1, "c1", results)
    store.add_runs(spark, str(tmp_path), 2, "c1", results.drop("place").coalesce(1))
    assert {(r["run_id"], r["test"]): r["outcome"] for r in spark.read.parquet(f"{tmp_path}/results").collect()} == {(1, "t"): "PASSED", (2, "t"): "FAILED", (1, "u"): "PASSED", (2, "u"): "PASSED"}
    lines = spark.createDataFrame([("t", "lcov", "a.ts", 1, True)], "test string, format string, path string, line int, hit boolean")
    store.add_coverage(spark, str(tmp_path), 3, "c1", lines)
    assert spark.read.parquet(f"{tmp_path}/coverage").first()["commit"] == "c1"
