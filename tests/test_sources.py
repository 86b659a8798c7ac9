import pytest

from ripplegraph.sources import policy, reports, snapshots
from ripplegraph.streaming import runs


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path.parent)


def test_junit(spark, tmp_path):
    d = put(
        tmp_path / "r.xml",
        """<testsuites><testsuite><testcase classname="a.B" name="ok" time="0.0015"/><testcase classname="a.B" name="bad" time="x"><failure type="E" message="first&#10;second"/><error type="F" message="m"/></testcase>
        <testcase classname="a.B" name="err" time="-1"><error type="F" message="boom"/></testcase><testcase classname="a.B" name="skip"><skipped/></testcase><testcase classname="a.B" name="flaky" time="1"><flakyFailure type="E" message="m"/><rerunError type="E" message="m"/></testcase></testsuite></testsuites>""",
    )
    got = {r["name"]: r for r in reports.junit(spark, d).collect()}
    assert {k: v["outcome"] for k, v in got.items()} == {"ok": "PASSED", "bad": "FAILED", "err": "ERROR", "skip": "SKIPPED", "flaky": "PASSED"}
    assert [got[k]["duration_ms"] for k in ("ok", "bad", "err", "flaky")] == [2, 0, 0, 1000] and got["flaky"]["failed_attempts"] == 2
    assert got["bad"]["failure_fingerprint"] == "E: first" and got["ok"]["failure_fingerprint"] is None


def test_entities_are_refused(spark, tmp_path):
    d = put(tmp_path / "r.xml", '<!DOCTYPE x [<!ENTITY a "b">]><testsuite><testcase name="&a;"/></testsuite>')
    with pytest.raises(ValueError):
        reports.junit(spark, d)


def test_jacoco(spark, tmp_path):
    d = put(tmp_path / "j.xml", '<report name="r"><package name="a/b"><sourcefile name="C.java"><line nr="1" mi="0" ci="2"/><line nr="2" mi="3" ci="0"/><line nr="2" mi="0" ci="1"/></sourcefile><sourcefile name="I.java"/></package></report>')
    got = {(r["path"], r["line"], r["hit"]) for r in reports.jacoco(spark, d).collect()}
    assert got == {("a/b/C.java", 1, True), ("a/b/C.java", 2, True), ("a/b/I.java", None, None)}


def test_lcov(spark, tmp_path):
    d = put(tmp_path / "l" / "a.info", "TN:one\nSF:src\\a.ts\nDA:1,2\nDA:2,0\nDA:2,1.5\nend_of_record\nTN:\nSF:src/b.ts\nDA:7,0\nend_of_record\n")
    got = {(r["test"], r["path"], r["line"], r["hit"]) for r in reports.lcov(spark, d).collect()}
    assert got == {("one", "src/a.ts", 1, True), ("one", "src/a.ts", 2, True), (None, "src/b.ts", 7, False)}
    for text in ("DA:1,1\nend_of_record\n", "SF:a\nDA:1,1\n"):
        bad = put(tmp_path / str(len(text)) / "b.info", text)
        with pytest.raises(Exception, match="whole record"):
            reports.lcov(spark, bad).collect()


def test_snapshot(spark, tmp_path):
    for path, text in {"src/A.java": "class A {}", "src/b c.ts": "let b", "node_modules/x/i.js": "x", "lib.min.js": "x", "README.md": "hi", "bin.ts": b"\x00\xff", "big.ts": "y" * 3000}.items():
        put(tmp_path / "snap" / path, text)
    got = {r["path"]: r for r in snapshots.files(spark, str(tmp_path / "snap"), 2000).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"src/A.java": "INDEXED", "src/b c.ts": "INDEXED", "node_modules/x/i.js": "EXCLUDED", "lib.min.js": "EXCLUDED", "README.md": "UNSUPPORTED", "bin.ts": "BINARY", "big.ts": "TOO_LARGE"}
    assert got["src/A.java"]["text"] == "class A {}" and got["src/A.java"]["language"] == "java"
    assert snapshots.one_file(spark, str(tmp_path / "snap"), "README.md").first()["size"] == 2


POLICY = """
version: 1
architecture:
  layers: [{name: api, match: ["src/api/**"]}, {name: db, match: ["src/db/**"]}]
  rules: [{from: api, deny: [db]}, {from: db, allow: [db]}]
  cycles: forbid
tests: {mode: conservative}
policy: {fail_on: [breaking_api_change], warn_on: [config_changed]}
"""


def test_policy():
    p = policy.parse_policy(POLICY)
    assert [n for n, _ in p.layers] == ["api", "db"] and p.mode == "conservative"
    assert (p.levels["breaking_api_change"], p.levels["config_changed"], p.levels["new_cycle"], p.levels["architecture_violation"]) == ("FAIL", "WARN", "FAIL", "OFF")
    assert policy.parse_policy("version: 1").levels["new_architecture_violation"] == "WARN"
    for wrong in ("version: 2", "version: 1\nmore: 1", POLICY.replace("[db]}, {from", "[no]}, {from"), POLICY.replace("conservative", "fast"), POLICY.replace("config_changed", "breaking_api_change"), POLICY.replace("name: db", "name: api")):
        with pytest.raises(ValueError):
            policy.parse_policy(wrong)


def test_owners_file():
    rules, errors = policy.parse_owners("# all\n* @team\nsrc/ @a a@b.c # note\n!x @a\ny nobody\n/z\n")
    assert [(n, o) for n, _, o in rules] == [(2, ["@team"]), (3, ["@a", "a@b.c"]), (6, [])] and [n for n, _ in errors] == [4, 5]


def test_stream_of_runs(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([(1, "t", "PASSED")], "run_id bigint, test string, outcome string").write.parquet(source)
    for _ in range(2):
        runs.ingest(spark, source, "run_id bigint, test string, outcome string", store).awaitTermination(60)
    spark.createDataFrame([(2, "t", "FAILED")], "run_id bigint, test string, outcome string").write.mode("append").parquet(source)
    runs.ingest(spark, source, "run_id bigint, test string, outcome string", store).awaitTermination(60)
    assert sorted(r["run_id"] for r in runs.results(spark, store).collect()) == [1, 2]
