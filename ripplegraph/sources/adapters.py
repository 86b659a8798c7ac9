"""The driver's tables as symbols, edges, snapshots and test runs.

Each view is one SQL text for both engines: {name} stands for a table or an earlier view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_EDGE = "cast({k} as int) AS kind_ord, cast({s} as int) AS strength, cast(5 - ({s}) as int) AS ev_ord"
_FLAG = "CASE l_returnflag WHEN 'N' THEN 5 WHEN 'A' THEN 4 ELSE 3 END"
_STATUS = "CASE l_linestatus WHEN 'O' THEN 5 ELSE 3 END"
_SIZE = "CASE WHEN p_size % 3 = 0 THEN 3 ELSE 5 END"


def _edge(kind_ord: int, strength: str) -> str:
    return _EDGE.format(k=kind_ord, s=strength)


VIEWS = {
    "sym": """
        SELECT concat('region:', cast(r_regionkey as string)) AS id, 'file' AS kind, r_name AS name, r_name AS module, concat('geo/', r_name, '.ts') AS file, 1 AS start_line, 1000 AS end_line,
               cast(null as string) AS parent, 'public' AS visibility, false AS is_test, false AS is_unit, md5(r_name) AS fp FROM {region}
        UNION ALL SELECT concat('nation:', cast(n_nationkey as string)), 'class', n_name, n_name, concat('geo/', n_name, '.ts'), 1, 500,
               concat('region:', cast(n_regionkey as string)), CASE WHEN n_nationkey % 3 = 0 THEN 'package' ELSE 'public' END, false, false, md5(n_name) FROM {nation}
        UNION ALL SELECT concat('supplier:', cast(s_suppkey as string)), 'method', s_name, concat('nation', cast(s_nationkey as string)), concat('src/supplier/', cast(s_nationkey as string), '.ts'), cast(s_suppkey as int), cast(s_suppkey + 5 + s_suppkey % 7 as int),
               concat('nation:', cast(s_nationkey as string)), CASE WHEN s_suppkey % 4 = 0 THEN 'private' ELSE 'public' END, false, false, md5(s_name) FROM {supplier}
        UNION ALL SELECT concat('customer:', cast(c_custkey as string)), 'class', c_name, c_mktsegment, concat('tests/', c_mktsegment, '.ts'), cast(c_custkey * 10 as int), cast(c_custkey * 10 + 9 as int),
               concat('nation:', cast(c_nationkey as string)), 'public', true, false, md5(c_name) FROM {customer}
        UNION ALL SELECT concat('orders:', cast(o_orderkey as string)), 'method', concat('order', cast(o_orderkey % 5 as string)), o_orderpriority, concat('tests/', o_orderpriority, '.ts'), cast(o_orderkey as int), cast(o_orderkey + 3 as int),
               concat('customer:', cast(o_custkey as string)), 'public', true, true, md5(concat(o_orderstatus, o_orderpriority)) FROM {orders}
        UNION ALL SELECT concat('part:', cast(p_partkey as string)), 'function', p_name, p_brand, concat('src/part/', cast(p_size as string), '.ts'), cast(p_partkey as int), cast(p_partkey + p_size as int),
               cast(null as string), CASE WHEN p_size % 5 = 0 THEN 'private' ELSE 'public' END, false, false, md5(concat(p_name, p_type)) FROM {part}""",
    "edge_raw": f"""
        SELECT concat('orders:', cast(l_orderkey as string)) AS f, concat('part:', cast(l_partkey as string)) AS t, 'CALLS' AS kind, {_edge(5, _FLAG)}, concat('calls/', l_returnflag) AS file, l_linenumber AS line, concat('call.', l_linestatus) AS rule FROM {{lineitem}}
        UNION ALL SELECT concat('part:', cast(l_partkey as string)), concat('supplier:', cast(l_suppkey as string)), 'REFERENCES', {_edge(7, _STATUS)}, 'refs', l_linenumber, concat('ref.', l_linestatus) FROM {{lineitem}}
        UNION ALL SELECT concat('supplier:', cast(s_suppkey as string)), concat('nation:', cast(s_nationkey as string)), 'REFERENCES', {_edge(7, "5")}, 'home', 1, 'ref.home' FROM {{supplier}}
        UNION ALL SELECT concat('part:', cast(p_partkey as string)), concat('part:', cast(before as string)), 'OVERRIDES', {_edge(4, _SIZE)}, 'brand', 1, 'override' FROM (SELECT p_partkey, p_size, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM {{part}}) x WHERE before IS NOT NULL
        UNION ALL SELECT concat('customer:', cast(o_custkey as string)), concat('orders:', cast(o_orderkey as string)), 'CONTAINS', {_edge(0, "5")}, 'tests', 1, 'declaration' FROM {{orders}}
        UNION ALL SELECT concat('nation:', cast(n_nationkey as string)), concat('region:', cast(n_regionkey as string)), 'IMPORTS', {_edge(1, "5")}, 'geo', 1, 'import' FROM {{nation}}""",
    "base": "SELECT concat('orders:', cast(o_orderkey as string)) AS id, concat('src/', cast(o_orderkey % 10 as string), '/', cast(o_orderkey as string), '.ts') AS path, 'file' AS kind, cast(o_custkey as string) AS owner, o_orderpriority AS name, md5(concat(o_orderstatus, CASE WHEN o_orderkey % 23 = 0 THEN 'x' ELSE '' END)) AS fp, md5(concat(cast(o_custkey as string), o_orderstatus)) AS body FROM {orders} WHERE o_orderkey % 17 <> 0",
    "head": "SELECT concat('orders:', cast(o_orderkey as string)) AS id, concat('src/', cast(o_orderkey % 10 as string), '/', cast(o_orderkey as string), '.ts') AS path, CASE WHEN o_orderkey % 101 = 0 THEN 'symlink' ELSE 'file' END AS kind, cast(o_custkey as string) AS owner, o_orderpriority AS name, md5(o_orderstatus) AS fp, md5(concat(cast(o_custkey as string), o_orderstatus)) AS body FROM {orders} WHERE o_orderkey % 19 <> 0",
    "gone": "SELECT b.* FROM {base} b WHERE NOT EXISTS (SELECT 1 FROM {head} h WHERE h.id = b.id)",
    "come": "SELECT h.* FROM {head} h WHERE NOT EXISTS (SELECT 1 FROM {base} b WHERE b.id = h.id)",
    "runs": "SELECT concat('user:', cast(user_id as string), '/', cast(event_id % 7 as string)) AS test, event_id AS run_id, cast(date_trunc('hour', ts) as string) AS commit, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'SKIPPED' ELSE 'PASSED' END AS outcome, cast(floor(value * 10) as bigint) AS duration_ms, CASE WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 1 ELSE 0 END AS failed_attempts FROM {events}",
    "files": "SELECT doc_id, concat(source, '/', cast(doc_id as string), '.', lang) AS path, md5(text) AS blob, text FROM {documents}",
    "dep": "SELECT concat('l', cast(l_orderkey as string)) AS f, concat('p', cast(l_partkey as string)) AS t, 'CALLS' AS kind, 5 AS kind_ord, c.n_name AS a, s.n_name AS b, cr.r_name AS ra, sr.r_name AS rb, l_shipdate FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} c ON c_nationkey = c.n_nationkey JOIN {region} cr ON c.n_regionkey = cr.r_regionkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} s ON s_nationkey = s.n_nationkey JOIN {region} sr ON s.n_regionkey = sr.r_regionkey",
    "dep_base": "SELECT * FROM {dep} WHERE l_shipdate < TIMESTAMP '1998-07-01 00:00:00' AND a <> b",
    "dep_head": "SELECT * FROM {dep} WHERE a <> b",
    "reports": "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN cast(null as string) ELSE concat('t', cast(doc_id % 40 as string)) END AS test, concat('commit-', cast(doc_id % 6 as string), '-of-many') AS commit, concat('f', cast(doc_id % 3 as string)) AS format FROM {documents}",
}
_NAME = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view over the tables of sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def _needed(name: str) -> list[str]:
    out: list[str] = []
    for n in _NAME.findall(VIEWS[name]):
        if n in VIEWS:
            out += [x for x in _needed(n) if x not in out]
    return [*out, name]


def sql(text: str) -> str:
    """text with every {view} that it names as a common table expression before it; a text that begins with WITH goes on with its own."""
    views: list[str] = []
    for n in _NAME.findall(text):
        if n in VIEWS:
            views += [x for x in _needed(n) if x not in views]
    plain = _NAME.sub(r"\1", text).strip()
    if not views:
        return plain
    tables = ", ".join(f"{v} AS ({_NAME.sub(r'\1', VIEWS[v])})" for v in views)
    if plain[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {tables}, {plain[14:]}"
    return f"WITH {tables}, {plain[4:]}" if plain[:4].upper() == "WITH" else f"WITH {tables} {plain}"
