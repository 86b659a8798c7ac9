"""Registered queries of what is read from code (brackets, exports, methods up a hierarchy) and of the stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.operators import assessment, changes, exports, hierarchy, syntax
from ripplegraph.plans import store
from ripplegraph.plans.queries import Tables, query
from ripplegraph.session import shared_dir

#: Lines of documents with some letters as brackets.
BRACKETS = "SELECT cast(doc_id as string) AS path, translate(text, 'kvpgbf', '(){}[]') AS text FROM {documents} WHERE text IS NOT NULL"


def _lost(kind: str) -> str:
    """Brackets of one kind, character by character: one that closes at a new least level, or opens at a level that is not come down to again."""
    open_, close = kind
    return f"""(SELECT path, line FROM (SELECT path, line, c, low_before, low, lvl - low AS own, min(lvl - low) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (
    SELECT *, least(0, min(lvl) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS low, least(0, coalesce(min(lvl) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low_before FROM (
    SELECT *, sum(CASE c WHEN '{open_}' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lvl FROM chars WHERE c IN ('{open_}', '{close}')) x) y) z
    WHERE (c = '{close}' AND low < low_before) OR (c = '{open_}' AND (later IS NULL OR later >= own)))"""


@query(f"""WITH d AS ({BRACKETS}), l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d),
chars AS MATERIALIZED (SELECT path, line, c, row_number() OVER (PARTITION BY path ORDER BY line, k) AS pos FROM (SELECT path, line, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM l) u WHERE c IN ('(', ')', '[', ']', '{{', '}}'))
SELECT path, cast(line as int) AS line, cast(count(*) as int) AS n FROM ({_lost('()')} UNION ALL {_lost('[]')} UNION ALL {_lost('{}')}) q GROUP BY ALL""")
def bracket_errors(t: Tables) -> DataFrame:
    """The lines at which brackets do not close."""
    text = F.translate("text", "kvpgbf", "(){}[]")
    d = t.documents.filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), text.alias("text")).select("path", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return syntax.bracket_errors(d.select("path", (F.col("at") + 1).cast("int").alias("line"), "text"))


#: Modules of four parts each; what they declare, pass on by name, as a namespace or as a whole; rings and modules outside among them.
EXPORTS = """SELECT concat('m', cast(floor(p_partkey / 4) as int)) AS module, CASE WHEN p_size % 7 >= 4 THEN cast(null as string) ELSE concat('n', cast(p_size % 5 as string)) END AS name,
CASE p_size % 7 WHEN 0 THEN 'decl' WHEN 1 THEN 'named' WHEN 2 THEN 'named' WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 'namespace' ELSE 'decl' END ELSE 'all' END AS kind,
CASE WHEN p_size % 7 = 0 OR (p_size % 7 = 3 AND p_size % 2 = 1) THEN concat('part:', cast(p_partkey as string)) END AS value,
CASE WHEN p_size % 7 = 0 OR (p_size % 7 = 3 AND p_size % 2 = 1) OR p_partkey % 23 = 0 THEN cast(null as string) WHEN p_partkey % 11 = 0 THEN concat('m', cast(floor(p_partkey / 4) + 1 as int)) ELSE concat('m', cast(floor(p_partkey / (8 + p_size % 3)) as int)) END AS to_module,
CASE WHEN p_size % 7 IN (1, 2) THEN concat('n', cast((p_size + 1) % 5 as string)) END AS to_name,
p_size % 7 NOT IN (0, 3) AND p_partkey % 29 = 0 AS external, cast(p_partkey as int) AS place FROM {part}"""
EXPORTS = EXPORTS.replace("cast(floor(p_partkey / 4) as int)", "cast(cast(floor(p_partkey / 4) as int) as string)").replace("cast(floor(p_partkey / 4) + 1 as int)", "cast(cast(floor(p_partkey / 4) + 1 as int) as string)").replace("cast(floor(p_partkey / (8 + p_size % 3)) as int)", "cast(cast(floor(p_partkey / (8 + p_size % 3)) as int) as string)")


@query(f"""WITH RECURSIVE x AS MATERIALIZED ({EXPORTS}), m AS (SELECT DISTINCT module FROM x), w AS (SELECT module, concat('n', cast(k as varchar)) AS name FROM m, range(0, 5) r(k)),
own AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY place) AS rn FROM x WHERE kind <> 'all') y WHERE rn = 1),
star AS MATERIALIZED (SELECT DISTINCT module, to_module, external FROM x WHERE kind = 'all'),
reach AS (SELECT module AS of_module, name AS of_name, module, name, true AS straight FROM w
    UNION SELECT r.of_module, r.of_name, CASE WHEN o.module IS NOT NULL THEN o.to_module ELSE s.to_module END, CASE WHEN o.module IS NOT NULL THEN o.to_name ELSE r.name END, straight AND o.module IS NOT NULL
    FROM reach r LEFT JOIN own o ON o.module = r.module AND o.name = r.name LEFT JOIN star s ON s.module = r.module AND o.module IS NULL
    WHERE (o.kind = 'named' AND o.to_module IS NOT NULL AND NOT o.external) OR (o.module IS NULL AND s.to_module IS NOT NULL AND NOT s.external)),
f AS (SELECT of_module, of_name, CASE WHEN o.kind = 'decl' THEN o.value WHEN o.kind = 'namespace' AND o.to_module IS NOT NULL AND NOT o.external THEN concat('ns:', o.to_module) END AS v,
    straight AND (coalesce(o.kind IN ('named', 'namespace') AND o.external, false) OR (o.module IS NULL AND r.module IN (SELECT module FROM star WHERE external))) AS away
    FROM reach r LEFT JOIN own o ON o.module = r.module AND o.name = r.name)
SELECT of_module AS module, of_name AS name, coalesce(min(v), CASE WHEN bool_or(away) THEN 'external' END) AS value, CASE WHEN count(DISTINCT v) > 1 THEN 3 ELSE 5 END AS strength FROM f GROUP BY ALL""")
def export_resolution(t: Tables) -> DataFrame:
    """What every module provides under every name."""
    x = t.spark.sql(EXPORTS, part=t.part)
    names = x.select("module").distinct().withColumn("name", F.explode(F.array(*(F.lit(f"n{k}") for k in range(5)))))
    return exports.resolved_exports(names, x)


TYPES = "SELECT concat('T', cast(s_suppkey as string)) AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'interface' WHEN s_suppkey % 17 = 0 THEN 'enum' ELSE 'class' END AS kind, s_suppkey % 3 <> 0 AS extends, s_suppkey % 13 = 0 AS external FROM {supplier}"
ABOVE = "SELECT concat('T', cast(s_suppkey as string)) AS id, concat('T', cast(cast(floor(s_suppkey / 3) as int) as string)) AS parent FROM {supplier} WHERE s_suppkey >= 3 UNION ALL SELECT concat('T', cast(s_suppkey as string)), concat('T', cast(cast(floor(s_suppkey / 2) as int) as string)) FROM {supplier} WHERE s_suppkey % 4 = 1 AND s_suppkey >= 2"
OWNED = "SELECT concat('part:', cast(p_partkey as string)) AS id, concat('T', cast(cast(floor(p_partkey / 20) as int) + 1 as string)) AS owner, concat('f', cast(p_partkey % 7 as string)) AS name, concat(cast(p_size % 4 as string), CASE WHEN p_size % 9 = 0 THEN '...' ELSE '' END) AS signature, cast(p_size % 4 as int) AS params, p_size % 9 = 0 AS varargs FROM {part}"
CALLED = "SELECT l_orderkey * 10 + l_linenumber AS call, concat('T', cast(l_suppkey as string)) AS type, CASE WHEN l_partkey % 41 = 0 THEN 'toString' ELSE concat('f', cast(l_partkey % 8 as string)) END AS name, CASE WHEN l_linenumber < 5 THEN l_linenumber - 1 END AS arity FROM {lineitem}"


@query(f"""WITH RECURSIVE ty AS ({TYPES}), up AS ({ABOVE}), me AS ({OWNED}), ca AS ({CALLED}),
walk AS (SELECT id, id AS above, 0 AS distance FROM ty UNION SELECT w.id, up.parent, w.distance + 1 FROM walk w JOIN up ON up.id = w.above AND up.parent <> w.id),
lv AS MATERIALIZED (SELECT id, above, min(distance) AS distance FROM walk GROUP BY ALL),
out AS (SELECT DISTINCT lv.id FROM lv JOIN ty ON ty.id = lv.above WHERE ty.external OR (ty.kind = 'class' AND NOT ty.extends) OR ty.kind = 'enum'),
hit AS (SELECT ca.call, me.id AS method, row_number() OVER (PARTITION BY ca.call, me.signature ORDER BY lv.distance, me.id) AS rn FROM ca JOIN lv ON lv.id = ca.type JOIN me ON me.owner = lv.above AND me.name = ca.name
    WHERE ca.arity IS NULL OR CASE WHEN me.varargs THEN ca.arity + 1 >= me.params ELSE ca.arity = me.params END),
best AS (SELECT call, method, count(*) OVER (PARTITION BY call) AS n FROM hit WHERE rn = 1)
SELECT call, method, CASE WHEN n > 1 THEN 3 ELSE 5 END AS strength, 'FOUND' AS status FROM best
UNION ALL SELECT call, NULL, NULL, CASE WHEN name IN {hierarchy.OBJECT_METHODS} OR type IN (SELECT id FROM out) THEN 'EXTERNAL' ELSE 'NOT_FOUND' END FROM ca WHERE call NOT IN (SELECT call FROM best)""")
def method_lookup(t: Tables) -> DataFrame:
    """What every call by name and number of arguments may mean, up the hierarchy of its receiver's type."""
    types = t.spark.sql(TYPES, supplier=t.supplier)
    closure = hierarchy.levels(types, t.spark.sql(ABOVE, supplier=t.supplier))
    return hierarchy.method_candidates(t.spark.sql(CALLED, lineitem=t.lineitem), closure, hierarchy.outside(types, closure), t.spark.sql(OWNED, part=t.part))


@query("SELECT id, path, kind, owner, name, fp, body FROM {head}")
def stored_index(t: Tables) -> DataFrame:
    """The index after two versions, of which the second holds what changed."""
    where = f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
    for side in (t.base, t.head):
        store.apply(t.spark, where, {"symbols": side})
    return store.load(t.spark, where, "symbols")


@query("WITH p AS (SELECT coalesce(b.path, h.path) AS path FROM {base} b FULL OUTER JOIN {head} h ON b.path = h.path WHERE b.body IS DISTINCT FROM h.body OR b.kind IS DISTINCT FROM h.kind), o AS (SELECT id FROM {base} WHERE path IN (SELECT path FROM p) UNION SELECT id FROM {head} WHERE path IN (SELECT path FROM p)) SELECT o.id, CASE WHEN b.id IS NULL THEN 'ADDED' WHEN h.id IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change FROM o LEFT JOIN {base} b ON b.id = o.id LEFT JOIN {head} h ON h.id = o.id WHERE b.id IS NULL OR h.id IS NULL OR b.fp IS DISTINCT FROM h.fp")
def classify_in_changed_files(t: Tables) -> DataFrame:
    """Symbols of the changed files alone."""
    files = lambda df: df.select("path", F.col("body").alias("blob"), "kind")
    diff = changes.diff_paths(files(t.base), files(t.head)).filter("change <> 'UNCHANGED'")
    own = lambda df: df.select("id", F.col("path").alias("file"), "fp")
    return changes.classify_symbols(*changes.in_changed_files(own(t.base), own(t.head), diff))


@query("WITH o AS (SELECT DISTINCT f, t, kind FROM {dep_base}), n AS (SELECT DISTINCT f, t, kind FROM {dep} WHERE l_shipdate >= TIMESTAMP '1993-01-01 00:00:00') SELECT *, 'ADDED' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) x UNION ALL SELECT *, 'REMOVED' FROM (SELECT * FROM o EXCEPT SELECT * FROM n) y")
def unresolved_delta(t: Tables) -> DataFrame:
    """References that only one of two versions has."""
    key = ["f", "t", "kind"]
    return changes.row_delta(t.dep_base.select(*key), t.dep.filter("l_shipdate >= timestamp '1993-01-01 00:00:00'").select(*key))


@query("SELECT o_custkey AS owner, md5(string_agg(md5(concat(o_orderstatus, o_orderpriority)), '' ORDER BY o_orderkey)) AS fp FROM {orders} GROUP BY o_custkey")
def merged_fingerprint(t: Tables) -> DataFrame:
    """The fingerprint of a declaration that is made of several parts."""
    parts = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("place"), F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("fp"))
    return parts.groupBy("owner").agg(paths.merged_fingerprint("place", "fp").alias("fp"))


GATES = "SELECT r_name AS gate, CASE r_regionkey % 3 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM {region} WHERE r_regionkey < 4"
SPOTS = "SELECT r_name AS rule, CASE WHEN s_suppkey % 5 = 0 THEN cast(null as string) ELSE concat('src/', n_name) END AS path, cast(s_suppkey % 7 - 1 as int) AS line, s_name AS message, n_name AS x, cast(s_suppkey % 3 as string) AS y FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"


@query(f"""WITH g AS ({GATES}), c AS ({SPOTS}), l AS (SELECT c.*, CASE g.status WHEN 'FAIL' THEN 'error' WHEN 'WARN' THEN 'warning' ELSE 'note' END AS level, md5(concat(length(rule), ':', rule, length(x), ':', x, length(y), ':', y)) AS fingerprint FROM c LEFT JOIN g ON g.gate = c.rule)
SELECT rule, level, path, line, message, fingerprint FROM (SELECT rule, level, path, greatest(line, 1) AS line, message, fingerprint, row_number() OVER (PARTITION BY rule, fingerprint ORDER BY path NULLS FIRST, greatest(line, 1), level, message) AS k FROM l) z WHERE k = 1""")
def located_findings(t: Tables) -> DataFrame:
    """Findings with the levels that their gates give them, one for each identity."""
    spots = t.spark.sql(SPOTS, supplier=t.supplier, nation=t.nation, region=t.region).withColumn("identity", F.array("x", "y"))
    return assessment.located_findings(spots, t.spark.sql(GATES, region=t.region))
