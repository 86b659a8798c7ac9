"""More registered queries: those behind a report, and whole compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.operators import architecture as arch
from ripplegraph.operators import assessment, changes, evidence, graph, lines, selection
from ripplegraph.plans.queries import DEPS, DETAIL, GRAPH, MAX_IMPACTED, Tables, _deps, _impact, graph_of, impact_sql, query
from ripplegraph.schema import COUPLING_CAP, LIST_CAP, SLICE_NODES
from ripplegraph.session import written

REACHED = "SELECT id, depth, strength, parent, root, via_dispatch FROM v6 WHERE depth > 0"


def reached_sql(select: str, root: str = "part:7") -> str:
    return impact_sql(root, MAX_IMPACTED).replace(REACHED, select)


# Changes


@query("SELECT a.doc_id, cast(200 * coalesce(c, 0) // (len(string_split(coalesce(a.text, ''), chr(10))) + len(string_split(coalesce(b.text, ''), chr(10)))) as bigint) AS similarity FROM {documents} a JOIN {documents} b ON b.doc_id = a.doc_id + 1 LEFT JOIN (SELECT x.doc_id, sum(least(x.n, y.n)) AS c FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {documents}) u GROUP BY ALL) x JOIN (SELECT doc_id - 1 AS doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {documents}) u GROUP BY ALL) y ON x.doc_id = y.doc_id AND x.line = y.line GROUP BY x.doc_id) s ON s.doc_id = a.doc_id")
def line_multiset_similarity(t: Tables) -> DataFrame:
    """How alike each document is to the next one."""
    nxt = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return changes.line_similarity(t.documents.select("doc_id", "text").join(nxt, "doc_id"), "doc_id", "text", "other")


@query()
def rename_pairs(t: Tables) -> DataFrame:
    """Deleted and added files paired off: equal ones, then alike ones in the greedy order."""
    f = t.files.select("path", "blob", "text", "doc_id")
    return changes.renames(f.filter("doc_id % 2 = 0").drop("doc_id"), f.filter("doc_id % 2 = 1").drop("doc_id"))


#: A document and an edit of it: lines added, changed and taken away.
EDITS = "SELECT doc_id, text AS before, replace(replace(replace(replace(text, concat('e.', chr(10)), concat('e.', chr(10), 'new', chr(10))), concat('n.', chr(10)), concat('n!', chr(10))), concat('t.', chr(10)), 't. '), concat('s.', chr(10)), concat(chr(10), 's.', chr(10), chr(10))) AS after FROM {documents}"


def _split(c: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({c}, ''), chr(10)), lambda p, i: CASE WHEN i < len(string_split(coalesce({c}, ''), chr(10))) THEN p || chr(10) ELSE p END), lambda p: p <> '')"


#: x: both sides' lines; h and k: what they begin and end with; r: the rest, backwards; c: the table of common lengths by (i, j).
ALIGNED = f"""WITH RECURSIVE l AS (SELECT doc_id, {_split('before')} AS a, {_split('after')} AS b FROM ({EDITS}) e),
heads AS (SELECT *, least(len(a), len(b)) AS most, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS h FROM l),
tails AS (SELECT *, coalesce(list_min(list_filter(range(1, most - h + 1), lambda i: a[len(a) + 1 - i] <> b[len(b) + 1 - i])) - 1, most - h) AS k FROM heads),
r AS MATERIALIZED (SELECT doc_id, len(a) AS na, len(b) AS nb, h, k, list_reverse(a[h + 1 : len(a) - k]) AS a, list_reverse(b[h + 1 : len(b) - k]) AS b FROM tails),
c AS (SELECT doc_id, 0 AS i, unnest(range(0, len(b) + 1)) AS j, 0 AS n FROM r
      UNION ALL SELECT doc_id, i, j, max(n) OVER (PARTITION BY doc_id ORDER BY j) FROM (SELECT c.doc_id, c.i + 1 AS i, c.j, CASE WHEN c.j > 0 AND r.a[c.i + 1] = r.b[c.j] THEN lag(n) OVER (PARTITION BY c.doc_id ORDER BY c.j) + 1 ELSE n END AS n FROM c JOIN r ON r.doc_id = c.doc_id WHERE c.i < len(r.a)) y)"""


@query(f"{ALIGNED} SELECT r.doc_id, cast(CASE WHEN na + nb = 0 THEN 100 ELSE 200 * (h + k + n) // (na + nb) END as int) AS similarity FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = len(a) AND c.j = len(b)")
def line_similarity(t: Tables) -> DataFrame:
    """How alike each document and an edit of it are, the order of lines counted."""
    return lines.line_similarity(t.spark.sql(EDITS, documents=t.documents), "doc_id", "before", "after")


@query(f"""{ALIGNED}, w AS (
    SELECT doc_id, len(a) AS i, len(b) AS j, 0 AS step, '' AS op, 0 AS fi, 0 AS fj FROM r
    UNION ALL SELECT doc_id, CASE op WHEN '+' THEN i ELSE i - 1 END, CASE op WHEN '-' THEN j ELSE j - 1 END, step + 1, op, i, j FROM (
        SELECT w.doc_id, w.i, w.j, step, CASE WHEN w.i > 0 AND w.j > 0 AND r.a[w.i] = r.b[w.j] THEN '=' WHEN w.j > 0 AND (w.i = 0 OR x.n = y.n) THEN '+' ELSE '-' END AS op
        FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN c x ON x.doc_id = w.doc_id AND x.i = w.i AND x.j = w.j LEFT JOIN c y ON y.doc_id = w.doc_id AND y.i = w.i AND y.j = w.j - 1 WHERE w.i > 0 OR w.j > 0) s),
g AS (SELECT *, sum(CASE WHEN op = '=' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY step) AS part FROM w WHERE step > 0),
p AS (SELECT doc_id, part, max(fi) AS i, max(fj) AS j, count(CASE WHEN op = '-' THEN 1 END) AS gone, count(CASE WHEN op = '+' THEN 1 END) AS come FROM g WHERE op <> '=' GROUP BY ALL)
SELECT p.doc_id, cast(h + len(a) - i + CASE WHEN gone > 0 THEN 1 ELSE 0 END as int) AS old_start, cast(gone as int) AS old_len, cast(h + len(b) - j + CASE WHEN come > 0 THEN 1 ELSE 0 END as int) AS new_start, cast(come as int) AS new_len FROM p JOIN r ON r.doc_id = p.doc_id""")
def line_hunks(t: Tables) -> DataFrame:
    """The hunks between each document and an edit of it."""
    return lines.line_hunks(t.spark.sql(EDITS, documents=t.documents), "doc_id", "before", "after")


HUNKS = "SELECT DISTINCT concat('src/part/', cast(p_size as string), '.ts') AS file, cast(p_partkey as int) AS start, cast(p_partkey % 4 as int) AS len FROM {part}"
INNERMOST = "(SELECT file, line, coalesce(id, concat('file:', file)) AS id FROM (SELECT l.file, l.line, s.id, row_number() OVER (PARTITION BY l.file, l.line ORDER BY s.end_line - s.start_line, s.id) AS rn FROM (SELECT DISTINCT file, line FROM l) l LEFT JOIN {sym} s ON s.file = l.file AND l.line BETWEEN s.start_line AND s.end_line) x WHERE rn = 1)"


@query(f"""WITH h AS ({HUNKS}), l AS (SELECT file, start, unnest(range(start, start + len)) AS line FROM h WHERE len > 0), i AS {INNERMOST}
SELECT DISTINCT l.file, l.start, i.id FROM l JOIN i ON i.file = l.file AND i.line = l.line
UNION ALL SELECT file, start, coalesce(id, concat('file:', file)) FROM (SELECT h.file, h.start, s.id, row_number() OVER (PARTITION BY h.file, h.start ORDER BY s.end_line - s.start_line, s.id) AS rn FROM h LEFT JOIN {{sym}} s ON s.file = h.file AND s.start_line <= h.start AND s.end_line >= h.start + 1 WHERE h.len = 0) x WHERE rn = 1""")
def touched_symbols(t: Tables) -> DataFrame:
    return changes.touched_symbols(t.spark.sql(HUNKS, part=t.part), t.sym)


@query("WITH RECURSIVE p AS (SELECT doc_id AS c, doc_id - 1 AS p FROM {documents} WHERE doc_id // 40 = (doc_id - 1) // 40 AND doc_id > 0), a AS (SELECT c AS start, p AS ancestor, 1 AS distance FROM p UNION ALL SELECT a.start, p.p, a.distance + 1 FROM a JOIN p ON p.c = a.ancestor) SELECT cast(start as string) AS id, cast(ancestor as string) AS ancestor, distance FROM a")
def deep_ancestors(t: Tables) -> DataFrame:
    """Chains of 40."""
    up = t.documents.filter("doc_id div 40 = (doc_id - 1) div 40 AND doc_id > 0")
    return graph.parent_closure(up.select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") - 1).cast("string").alias("parent")))


# Evidence


@query("SELECT cast(d.doc_id as string) AS id, CASE WHEN q.doc_id IS NOT NULL THEN 'COVERED' WHEN m.source IS NOT NULL THEN 'NOT_COVERED' ELSE 'NO_DATA' END AS status FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels} WHERE quality = 1 AND doc_id % 2 = 0) q ON d.doc_id = q.doc_id LEFT JOIN (SELECT DISTINCT source FROM {documents} JOIN {labels} USING (doc_id) WHERE toxic = 1 AND doc_id % 2 = 0) m ON m.source = d.source")
def coverage_status_deleted(t: Tables) -> DataFrame:
    """Only what was covered at the base commit counts."""
    commit = F.concat(F.lit("c"), (F.col("doc_id") % 2).cast("string")).alias("commit")
    symbols = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file"))
    covered = t.labels.filter("quality = 1").select(F.col("doc_id").cast("string").alias("id"), commit)
    measured = t.documents.join(t.labels.filter("toxic = 1"), "doc_id").select(F.col("source").alias("file"), commit)
    return evidence.base_only_status(symbols, covered, measured, "c0")


COVER = "SELECT l_linenumber AS report, concat('part/', cast(p_size as string), '.ts') AS path, cast(p_partkey + 2 as int) AS line, l_quantity > 25 AS hit FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"


@query(f"WITH c AS (SELECT report, path, line FROM ({COVER}) x GROUP BY ALL HAVING bool_or(hit)), l AS (SELECT report, concat('src/', path) AS file, line FROM c), i AS {INNERMOST} SELECT l.report, i.id, count(*) AS hits FROM l JOIN i ON i.file = l.file AND i.line = l.line GROUP BY ALL")
def covered_symbols(t: Tables) -> DataFrame:
    lines = evidence.merged_lines(t.spark.sql(COVER, lineitem=t.lineitem, part=t.part))
    mapped = evidence.mapped_paths(lines.select(F.col("path").alias("raw")), t.sym.select(F.col("file").alias("path")).distinct())
    return evidence.covered_symbols(lines, mapped, t.sym)


@query("SELECT selector, coalesce((SELECT min(id) FROM {sym} s WHERE s.id = x.selector), (SELECT min(id) FROM {sym} s WHERE s.id = concat('file:', x.selector)), (SELECT min(id) FROM {sym} s WHERE s.id = concat('java:', x.selector))) AS id FROM (SELECT DISTINCT concat(CASE WHEN o_orderkey % 3 = 0 THEN 'nothing:' ELSE 'orders:' END, cast(o_orderkey as string)) AS selector FROM {orders}) x")
def test_selector(t: Tables) -> DataFrame:
    return selection.resolved_tests(t.spark.sql("SELECT concat(CASE WHEN o_orderkey % 3 = 0 THEN 'nothing:' ELSE 'orders:' END, cast(o_orderkey as string)) AS selector FROM {orders}", orders=t.orders), t.sym)


# Graph


@query(f"SELECT id, cast(coalesce(n, 0) as bigint) AS dependents FROM (SELECT DISTINCT id FROM {{sym}}) s LEFT JOIN (SELECT t, count(DISTINCT f) AS n FROM {GRAPH} g WHERE kind NOT IN ('CONTAINS', 'IMPORTS', 'TESTS') GROUP BY t) c ON s.id = c.t ORDER BY dependents DESC, id LIMIT 1")
def hub(t: Tables) -> DataFrame:
    return graph.with_hub(graph_of(t), t.sym)


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM {dep_base}), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT x.a AS member, least(x.a, min(x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1) SELECT e.a, e.b, x.cycle FROM e JOIN m x ON x.member = e.a JOIN m y ON y.member = e.b WHERE x.cycle = y.cycle")
def cycle_edges(t: Tables) -> DataFrame:
    pairs = t.dep_base.select("a", "b").distinct()
    return graph.cycle_edges(pairs, graph.cycles(pairs))


@query(reached_sql(f"SELECT s.id, s.kind, s.file, (SELECT count(*) FROM e WHERE t = 'part:7') AS incoming, (SELECT count(*) FROM e WHERE f = 'part:7') AS outgoing, (SELECT count(*) FROM v6 WHERE depth > 0) AS impacted, (SELECT count(*) FROM v6 v JOIN {{sym}} y ON y.id = v.id WHERE v.depth > 0 AND y.is_test) AS tests FROM {{sym}} s WHERE s.id = 'part:7'"))
def symbol_info(t: Tables) -> DataFrame:
    e = graph_of(t)
    reached = graph.impact(t.edge_raw, t.spark.createDataFrame([("part:7",)], "id string")).reached
    return graph.symbol_info(e, t.sym, written(reached, "reached"), "part:7")


@query(reached_sql(f"SELECT id FROM (SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM {{sym}} WHERE kind = 'class' UNION ALL SELECT id, depth FROM v6 WHERE depth > 0) x GROUP BY id) y ORDER BY depth, id LIMIT {SLICE_NODES}"))
def graph_slice_nodes(t: Tables) -> DataFrame:
    """The nodes of a slice: changed symbols first, then the impacted by depth, no more than a slice holds."""
    return graph.slice_nodes(t.sym.filter("kind = 'class'").select("id", "kind"), _impact(t, "part:7").select("id", "depth"))


@query(reached_sql("SELECT count(DISTINCT module) AS modules FROM {sym} WHERE id = 'part:7' OR id IN (SELECT id FROM v6 WHERE depth > 0)"))
def touched_modules(t: Tables) -> DataFrame:
    return graph.touched_modules(t.spark.createDataFrame([("part:7",)], "id string"), _impact(t, "part:7"), t.sym)


@query("SELECT id FROM {sym} WHERE contains(lower(id), 'supplier:1') ORDER BY id LIMIT 5")
def did_you_mean(t: Tables) -> DataFrame:
    """No id holds the whole text, so that its last segment decides."""
    return graph.suggestions(t.sym, "no.such.Owner.supplier:1(int)")


# Architecture and assessment


@query(f"SELECT f, t, kind, a, b, min(CASE WHEN a = 'tests' AND b = 'domain' THEN 0 ELSE 1 END) AS rule, 'PRE_EXISTING' AS status FROM {DEPS} d WHERE (a = 'tests' AND b = 'domain') OR (a = 'domain' AND b <> 'domain') GROUP BY ALL")
def architecture_check(t: Tables) -> DataFrame:
    """One snapshot against its rules."""
    rules = t.spark.createDataFrame([(0, "tests", ["domain"], None), (1, "domain", None, ["domain"])], "rule int, a string, deny array<string>, allow array<string>")
    return arch.checked(_deps(t), rules)


@query(f"SELECT f, t, kind, a, b FROM {DEPS} d WHERE f = 'part:7' OR t = 'part:7'")
def dependencies_of_symbol(t: Tables) -> DataFrame:
    return graph.involving(_deps(t), "part:7").select("f", "t", "kind", "a", "b")


PATTERNS = ["*.ts", "/src/part/", "part/*", "tests/**", "/geo/[A-M]*", "src", "1-*", "**/supplier"]


@query("""SELECT DISTINCT file AS path, file LIKE '%.ts' AS m0, file LIKE 'src/part/%' AS m1, file LIKE 'part/%' AND len(string_split(file, '/')) = 2 AS m2, file LIKE 'tests/%' AS m3, file LIKE 'geo/%' AND substr(file, 5, 1) BETWEEN 'A' AND 'M' AS m4,
    list_contains(string_split(file, '/'), 'src') AS m5, len(list_filter(string_split(file, '/'), lambda x: x LIKE '1-%')) > 0 AS m6, list_contains(string_split(file, '/'), 'supplier') AS m7 FROM {sym}""")
def codeowners_match(t: Tables) -> DataFrame:
    """Each pattern of an owners file against every path."""
    return t.sym.select(F.col("file").alias("path")).distinct().select("path", *(F.col("path").rlike(paths.owners_regex(p)).alias(f"m{i}") for i, p in enumerate(PATTERNS)))


STATUS = "CASE p_partkey % 8 WHEN 0 THEN 'SYNTAX_ERRORS' WHEN 1 THEN 'TOO_LARGE' WHEN 2 THEN 'BINARY' WHEN 3 THEN 'UNSUPPORTED' WHEN 4 THEN 'EXCLUDED' WHEN 5 THEN 'SYMLINK' WHEN 6 THEN 'INVALID_PATH' ELSE 'INDEXED' END"
SIDES = f"SELECT concat('f', cast(p_partkey as string), CASE p_size % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.md' END) AS path, CASE WHEN p_size % 2 = 0 THEN 'head' ELSE 'base' END AS side, {STATUS} AS status, CASE WHEN p_size % 3 = 1 THEN 'typescript' END AS language, p_partkey AS size, 'Empty' AS reason FROM {{part}}"
OPEN = "SELECT concat('part:', cast(l_partkey as string)) AS id, concat('f', cast(l_suppkey % 9 as string)) AS file, l_linenumber AS line, concat('call of m', cast(l_orderkey as string)) AS detail FROM {lineitem}"


@query(f"""WITH c AS ({SIDES}), o AS (SELECT DISTINCT x.* FROM ({OPEN}) x JOIN {{part}} ON x.id = concat('part:', cast(p_partkey as string)) WHERE p_size = 7),
    u AS (SELECT *, row_number() OVER (ORDER BY id, file, line, detail) AS k FROM o)
    SELECT severity, kind, file, cast(line as int) AS line, symbol, detail FROM (
    SELECT CASE WHEN side = 'head' THEN 'high' ELSE 'medium' END AS severity, 'SYNTAX_ERROR' AS kind, path AS file, NULL AS line, NULL AS symbol, concat('syntax errors in the ', side, ' revision') AS detail FROM c WHERE status = 'SYNTAX_ERRORS'
    UNION ALL SELECT 'high', 'FILE_TOO_LARGE', path, NULL, NULL, concat(side, ' revision has ', cast(size as string), ' bytes') FROM c WHERE status = 'TOO_LARGE'
    UNION ALL SELECT 'medium', 'BINARY_FILE', path, NULL, NULL, concat(side, ' revision is no text') FROM c WHERE status = 'BINARY' AND language IS NOT NULL
    UNION ALL SELECT CASE WHEN path LIKE '%.py' THEN 'medium' ELSE 'low' END, 'UNSUPPORTED_LANGUAGE', path, NULL, NULL, CASE WHEN path LIKE '%.py' THEN 'source code in Python is not analysed' ELSE 'not a supported language' END FROM c WHERE status = 'UNSUPPORTED'
    UNION ALL SELECT 'low', 'EXCLUDED_FILE', path, NULL, NULL, 'not indexed' FROM c WHERE status = 'EXCLUDED'
    UNION ALL SELECT 'low', 'SYMLINK_OR_SUBMODULE', path, NULL, NULL, 'not followed' FROM c WHERE status = 'SYMLINK'
    UNION ALL SELECT 'medium', 'REJECTED_PATH', path, NULL, NULL, reason FROM c WHERE status = 'INVALID_PATH'
    UNION ALL SELECT 'medium', 'UNRESOLVED_REFERENCE', file, line, id, detail FROM u WHERE k <= 200
    UNION ALL SELECT 'medium', 'UNRESOLVED_REFERENCE', NULL, NULL, NULL, concat(cast(count(*) - 200 as string), ' further unresolved references') FROM u HAVING count(*) > 200
    UNION ALL SELECT 'high', 'IMPACT_TRUNCATED', NULL, NULL, NULL, 'the impacted set is a lower bound') x""")
def uncertainty(t: Tables) -> DataFrame:
    sides = t.spark.sql(SIDES, part=t.part)
    relevant = t.part.filter("p_size = 7").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return assessment.uncertainty(sides, sides.filter("side = 'head'"), t.spark.sql(OPEN, lineitem=t.lineitem), relevant, True)


@query(f"SELECT *, (SELECT count(*) FROM ({DETAIL}) c) AS of FROM (SELECT * FROM ({DETAIL}) d ORDER BY kind, file, line, detail LIMIT {LIST_CAP}) x")
def report_list(t: Tables) -> DataFrame:
    """A report's list: cut to its cap, with the number of all."""
    return assessment.listed(t.spark.sql(DETAIL, lineitem=t.lineitem), ["kind", "file", "line", "detail"], LIST_CAP)


@query("SELECT doc_id, replace(replace(replace(text, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS data FROM {documents}")
def workflow_data(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", paths.workflow_data("text").alias("data"))


@query("SELECT id, replace(file, ' ', '%20') AS uri, concat(file, ':', cast(start_line as string), '-', cast(end_line as string)) AS location, split_part(id, '#', 1) AS owner, regexp_extract(id, '#([^(#]*)', 1) AS member FROM {sym}")
def symbol_place(t: Tables) -> DataFrame:
    owner, member = paths.owner_and_name("id")
    return t.sym.select("id", paths.path_uri("file").alias("uri"), paths.location("file", "start_line", "end_line").alias("location"), owner.alias("owner"), member.alias("member"))


@query("SELECT a, b, edges FROM (SELECT a, b, count(*) AS edges FROM {dep_head} GROUP BY ALL) x ORDER BY edges DESC, a, b LIMIT " + str(COUPLING_CAP))
def strongest_coupling(t: Tables) -> DataFrame:
    """The pairs of modules with the most edges: a report's list."""
    return arch.unit_edges(t.dep_head).select("a", "b", "edges").orderBy(F.desc("edges"), "a", "b").limit(COUPLING_CAP)


