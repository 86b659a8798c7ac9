"""The code graph: symbols (id, kind, ..., parent) and edges (f, t, kind, kind_ord, strength, ev_ord, file, line, rule); f depends on t."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.schema import CRITICAL_SEEN, EDGE_ORDER, MAX_DEPTH, MAX_IMPACTED, MOST_COMMITS, PATH_DEPTH, PATH_VISITED, SILENT_KINDS, SLICE_NODES
from ripplegraph.session import bounded_broadcast, written


def last_definitions(symbols: DataFrame, order: str) -> DataFrame:
    """One symbol for each id: the last in the order given (a total one)."""
    rest = [c for c in symbols.columns if c != "id"]
    return symbols.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("s")).select("id", *(F.col(f"s.{c}") for c in rest))


def emitted_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (f, t, kind): the strongest evidence, then the first line, then the first rule; none to itself."""
    rest = [c for c in edges.columns if c not in ("f", "t", "kind")]
    key = F.struct((-F.col("strength")).alias("s"), "line", "rule", "file")
    return edges.filter("f <> t").groupBy("f", "t", "kind").agg(F.min(F.struct(key.alias("key"), F.struct(*rest).alias("e"))).alias("x")).select("f", "t", "kind", *(F.col(f"x.e.{c}") for c in rest))


def graph_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (f, t, kind): the smallest by evidence, file, line and rule."""
    rest = [c for c in edges.columns if c not in ("f", "t", "kind")]
    key = ["ev_ord", "file", "line", "rule"]
    return edges.groupBy("f", "t", "kind").agg(F.min(F.struct(*key, *(c for c in rest if c not in key))).alias("x")).select("f", "t", "kind", *(F.col(f"x.{c}") for c in rest))


def joined_pairs(edges: DataFrame) -> DataFrame:
    """f, t, kind, kind_ord of graph_edges, where nothing of an edge's evidence is asked for."""
    return edges.groupBy("f", "t", "kind").agg(F.min("kind_ord").alias("kind_ord"))


def attached_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """The edges both ends of which are symbols."""
    ids = symbols.select("id")
    return edges.join(ids, edges["f"] == ids["id"], "left_semi").join(ids, edges["t"] == ids["id"], "left_semi")


def dangling_count(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """kind, total, kept, dangling.

    Edges are dealt out by one end and counted by kind and the other end, whether the first is a symbol; only these counts are dealt out again."""
    ids = symbols.select("id").distinct().withColumn("known", F.lit(True))
    own = edges.select("f", "t", "kind").join(ids.withColumnRenamed("id", "f"), "f", "left").groupBy("t", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k"))
    both = own.join(ids.withColumnRenamed("id", "t"), "t", "left")
    kept = F.sum(F.when(F.col("known"), F.col("k")).otherwise(0))
    return both.groupBy("kind").agg(F.sum("n").alias("total"), kept.alias("kept"), (F.sum("n") - kept).alias("dangling"))


def incoming(edges: DataFrame, symbol: str) -> DataFrame:
    """Who depends on the symbol directly; the filter reaches the scan."""
    return edges.filter(F.col("t") == symbol)


def outgoing(edges: DataFrame, symbol: str) -> DataFrame:
    return edges.filter(F.col("f") == symbol)


class Impact(NamedTuple):
    """reached: id, depth, strength, parent, root, via_dispatch, hops; truncated: whether the cap left some out."""

    reached: DataFrame
    truncated: bool


#: Rows of a frontier, or of what is visited, that may be broadcast.
BROADCAST_ROWS = 200_000


def steps(edges: DataFrame) -> DataFrame:
    """n, nxt, the edge's columns, via: one step of impact. Against every edge that carries impact; along overrides as well (dispatch)."""
    # Both kinds of step in one pass over the edges.
    back = F.when(~F.col("kind").isin(*SILENT_KINDS), F.struct(F.col("t").alias("n"), F.col("f").alias("nxt"), F.lit(False).alias("via")))
    along = F.when(F.col("kind") == "OVERRIDES", F.struct(F.col("f").alias("n"), F.col("t").alias("nxt"), F.lit(True).alias("via")))
    e = edges.select(*EDGE_ORDER, "kind", "strength", F.explode(F.array_compact(F.array(back, along))).alias("step"))
    return e.select("step.n", "step.nxt", *EDGE_ORDER, "kind", "strength", "step.via")


def _rank(*payload: Column) -> Column:
    """What orders the ways into a symbol: the stronger weakest hop, the parent, the edge; what follows is carried along and never decides."""
    return F.struct((-F.least("weakest", "strength")).alias("s"), F.col("id").alias("parent"), *EDGE_ORDER, "kind", "via", *payload)


def _steps_around(edges: DataFrame, ids: DataFrame, end: str) -> DataFrame:
    """The steps that start (end: n) or end (nxt) at one of the ids (id). Only edges there are brought down to one for each (f, t, kind)."""
    def near(df: DataFrame, n: str, nxt: str) -> DataFrame:
        at = n if end == "n" else nxt
        own = graph_edges(df.join(ids.select(F.col("id").alias(at)), at, "left_semi"))
        return own.select(F.col(n).alias("n"), F.col(nxt).alias("nxt"), *EDGE_ORDER, "kind", "strength", F.lit(n == "f").alias("via"))

    return near(edges.filter(~F.col("kind").isin(*SILENT_KINDS)), "t", "f").unionByName(near(edges.filter("kind = 'OVERRIDES'"), "f", "t"))


def impact(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, max_impacted: int = MAX_IMPACTED) -> Impact:
    """What depends on the roots (id), level by level, each with its best explaining parent.

    Of several edges of one (f, t, kind) the one of graph_edges counts. A level reads the edges and keeps those at its frontier, which max_impacted bounds: the graph is neither shuffled nor written. It takes the best way into each new symbol and
    writes what it found with its path: nothing but numbers of rows comes to the driver. Any number of roots may be given: where they are
    more than are broadcast, the ids that may come in are found first, and then the ways into them alone."""
    spark = edges.sparkSession
    start = roots.select("id").distinct().select("id", F.lit(5).alias("weakest"), F.col("id").alias("root"), F.array().cast("array<string>").alias("hops"))
    frontier = written(start, "frontier")
    n = frontier.limit(BROADCAST_ROWS + 1).count()
    seen, found, left, truncated = frontier.select("id"), None, max_impacted, False
    for depth in range(1, max_depth + 1):
        new = seen.select(F.col("id").alias("nxt"))
        if n <= BROADCAST_ROWS:
            frontier = F.broadcast(frontier)
            step = _steps_around(edges, F.broadcast(frontier.select("id")), "n")
        else:
            ids = _steps_around(edges, frontier.select("id"), "n").select("nxt").distinct().join(new, "nxt", "left_anti")
            ids = written(ids.orderBy("nxt").limit(left + 1).select(F.col("nxt").alias("id")), "ids")
            step = _steps_around(edges, bounded_broadcast(ids, BROADCAST_ROWS), "nxt")
        hop = F.concat_ws(" ", "f", "kind", "t")
        ways = step.join(frontier, F.col("n") == F.col("id")).select("nxt", _rank("root", F.array_append("hops", hop).alias("hops")).alias("r"))
        best = ways.groupBy("nxt").agg(F.min("r").alias("r")).join(new, "nxt", "left_anti")
        level = best.select(F.col("nxt").alias("id"), F.lit(depth).alias("depth"), (-F.col("r.s")).alias("strength"), "r.parent", "r.root", F.col("r.via").alias("via_dispatch"), "r.hops")
        level = written(level.orderBy("id").limit(left + 1), "level")
        n = level.count()
        if n > left:
            truncated = True
            level = level.orderBy("id").limit(left)
        found = level if found is None else found.unionByName(level)
        left -= n
        if not n or truncated:
            break
        frontier = level.select("id", F.col("strength").alias("weakest"), "root", "hops")
        seen = seen.union(level.select("id"))
    return Impact(found if found is not None else spark.createDataFrame([], _REACHED), truncated)


_REACHED = "id string, depth int, strength int, parent string, root string, via_dispatch boolean, hops array<string>"


#: Queries that go along a step in one row; ways into symbols that a task compares.
LISTED, TASK_WAYS = 500, 2_000_000


def impact_many(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """query, id, depth, strength, parent for many roots (query, id) at once, without a cap: frontiers and visited symbols stay on the cluster.

    Of several edges between two symbols the strongest counts; the edges need not be brought down to one for each (f, t, kind), as better evidence is stronger.
    Only symbols that lead further are followed level by level, with a row for each query. The others, most of a graph, are reached at the end: the queries
    go along each step as lists of numbers, not with a row each, and the best way into each symbol is found where its lists meet."""
    # Of equal ways by strength and parent the edge never shows, so only the ends and the strength of a step are kept.
    e = edges.select("f", "t", "kind", "strength")
    ways = e.filter(~F.col("kind").isin(*SILENT_KINDS)).select(F.col("t").alias("n"), F.col("f").alias("nxt"), "strength")
    ways = ways.unionByName(e.filter("kind = 'OVERRIDES'").select(F.col("f").alias("n"), F.col("t").alias("nxt"), "strength"))
    step = ways.repartition("nxt").groupBy("n", "nxt").agg(F.max("strength").alias("strength"))
    further = written(ways.select(F.col("n").alias("nxt")).distinct().withColumn("further", F.lit(True)), "further")
    step = step.join(bounded_broadcast(further, BROADCAST_ROWS), "nxt", "left").select("n", "nxt", "strength", F.coalesce("further", F.lit(False)).alias("further"))
    step = written(step.sortWithinPartitions("further", "n"), "steps")
    inner, last = written(step.filter("further").select("n", "nxt", "strength"), "inner"), step.filter("not further").select("n", "nxt", "strength")

    start = written(roots.select("query", "id", F.lit(5).alias("weakest")).distinct(), "frontier")
    frontier, seen, found = start, start.select("query", "id"), None
    for depth in range(1, max_depth + 1):
        near = inner.join(bounded_broadcast(frontier, BROADCAST_ROWS), F.col("n") == F.col("id")).select("query", "nxt", F.struct((-F.least("weakest", "strength")).alias("s"), F.col("id").alias("parent")).alias("r"))
        level = near.groupBy("query", "nxt").agg(F.min("r").alias("r"))
        level = level.withColumnRenamed("nxt", "id").join(seen, ["query", "id"], "left_anti")
        level = written(level.select("query", "id", F.lit(depth).alias("depth"), (-F.col("r.s")).alias("strength"), F.col("r.parent").alias("parent")), "level")
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        frontier = level.select("query", "id", F.col("strength").alias("weakest"))
        seen = seen.unionByName(level.select("query", "id"))

    # What the queries know of the symbols that lead further: how deep they lie and the weakest hop to them, in one number.
    known = start.select("query", "id", F.col("weakest").cast("smallint").alias("at"))
    if found is not None:
        known = known.unionByName(found.filter(F.col("depth") < max_depth).select("query", "id", (F.col("depth") * 8 + F.col("strength")).cast("smallint").alias("at")))
    part = F.floor((F.row_number().over(Window.partitionBy("id").orderBy("query")) - 1) / LISTED).alias("part")
    lists = written(known.select("id", "query", "at", part).groupBy("id", "part").agg(F.collect_list(F.struct("query", "at")).alias("x")).select("id", F.col("x.query").alias("queries"), F.col("x.at").alias("ats")), "lists")
    most = last.groupBy(F.col("n").alias("id")).agg(F.count(F.lit(1)).alias("k")).join(lists.groupBy("id").agg(F.sum(F.size("queries")).alias("m")), "id").agg(F.sum(F.col("k") * F.col("m"))).first()[0]
    ways = last.join(lists, F.col("n") == F.col("id")).select("nxt", "n", "strength", "queries", "ats")
    # A root that leads nowhere is no result of its own query.
    own = lists.select(F.col("id").alias("nxt"), F.lit(None).cast("string").alias("n"), F.lit(5).alias("strength"), F.filter(F.arrays_zip("queries", "ats"), lambda x: x["ats"] < 8).alias("x")).filter(F.size("x") > 0)
    ways = ways.unionByName(own.select("nxt", "n", "strength", F.col("x.queries").alias("queries"), F.col("x.ats").alias("ats")))
    dealt = ways.repartition(max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), (most or 0) // TASK_WAYS + 1), "nxt")
    each = dealt.select("nxt", "n", "strength", F.explode(F.arrays_zip("queries", "ats")).alias("x"))
    each = each.select("nxt", F.col("x.queries").alias("query"), F.struct(F.when(F.col("n").isNull(), 0).otherwise(F.shiftright("x.ats", 3) + 1).alias("depth"), (-F.least(F.col("x.ats").bitwiseAND(F.lit(7)), "strength")).alias("s"), F.col("n").alias("parent")).alias("r"))
    ends = each.groupBy("query", F.col("nxt").alias("id")).agg(F.min("r").alias("r")).filter(F.col("r.depth").between(1, max_depth))
    ends = ends.select("query", "id", F.col("r.depth").cast("int").alias("depth"), (-F.col("r.s")).cast("int").alias("strength"), F.col("r.parent").alias("parent"))
    return ends if found is None else found.unionByName(ends)


class Path(NamedTuple):
    """hops: hop, f, t, kind; truncated: whether the search gave up at its bound, so that no hops need not mean no path."""

    hops: DataFrame
    truncated: bool


def dependency_path(edges: DataFrame, source: str, target: str, max_depth: int = PATH_DEPTH, max_visited: int = PATH_VISITED) -> Path:
    """The first shortest chain by which source depends on target; no rows if there is none. All edges but CONTAINS count.

    Of several ways the one that a queue finds first counts: each symbol keeps the ends of the hops that led to it, which order a level as the queue would.
    Levels stay on the cluster; only their numbers of rows and the target's row come to the driver. The search gives up when more than max_visited symbols were seen."""
    spark = edges.sparkSession
    usable = edges.filter("kind <> 'CONTAINS'")
    level = written(spark.createDataFrame([(source, [], [])], "id string, way array<struct<t: string, kind_ord: int>>, hops array<struct<f: string, t: string, kind: string>>"), "level")
    seen, visited, hops, truncated = level.select("id"), 1, [], False
    for _ in range(max_depth if source != target else 0):
        if visited > max_visited:
            truncated = True
            break
        # Of the edges only those at the level's ends go on: the graph is neither shuffled nor written.
        level = bounded_broadcast(level, BROADCAST_ROWS)
        near = graph_edges(usable.join(level.select(F.col("id").alias("f")), "f", "left_semi"))
        ways = near.select("f", "t", "kind_ord", "kind").join(level, F.col("f") == F.col("id"))
        best = ways.groupBy("t").agg(F.min(F.struct("way", "kind_ord", "kind", "f", "hops")).alias("r")).join(seen.select(F.col("id").alias("t")), "t", "left_anti")
        way = F.array_append("r.way", F.struct("t", F.col("r.kind_ord").cast("int").alias("kind_ord")))
        level = written(best.select(F.col("t").alias("id"), way.alias("way"), F.array_append("r.hops", F.struct("r.f", "t", "r.kind")).alias("hops")), "level")
        hit = level.filter(F.col("id") == target).first()
        if hit is not None:
            hops = [(i + 1, h["f"], h["t"], h["kind"]) for i, h in enumerate(hit["hops"])]
            break
        n = level.count()
        if not n:
            break
        seen, visited = seen.union(level.select("id")), visited + n
    return Path(spark.createDataFrame(hops, "hop int, f string, t string, kind string"), truncated)


#: Rows of a table that going up a history may broadcast.
FEW_ABOVE = 10_000


def ancestors_of(parents: DataFrame, start: str, most: int | None = MOST_COMMITS) -> DataFrame:
    """id: the start and all that is above it over (id, parent). Raises where that is more than `most` (None: any number): a part would change results without saying so.
    Where parents has a column `place`, an id's first parent is the one of the lowest place, else the least.

    Lines of first parents are gone up by jumps of doubled lengths, of which every id has one each; then other parents lead to further lines. A line of n takes log n
    rounds, and no table has more rows than there are parents: no pairs of ancestors are made. Tables that grow with the history are shuffled; the driver gets FEW_ABOVE rows at most to broadcast."""
    few = lambda df: F.broadcast(df) if df.limit(FEW_ABOVE + 1).count() <= FEW_ABOVE else df.hint("merge")
    up = written(parents.filter("parent is not null and id <> parent"), "up")
    first = up.groupBy("id").agg(F.min_by("parent", "place" if "place" in up.columns else "parent").alias("parent"))
    jumps = [written(first, "jumps")]
    # No line has more parents than there are ids with one.
    longest = jumps[0].count() if most is None else min(most, jumps[0].count())
    while not jumps[-1].isEmpty():
        further = jumps[-1].join(few(jumps[-1].select(F.col("id").alias("parent"), F.col("parent").alias("far"))), "parent")
        jumps.append(written(further.select("id", F.col("far").alias("parent")), "jumps"))
        if len(jumps) > longest.bit_length() + 1:
            raise ValueError("the parents lead back to where they start, or the line is longer than it may be")
    seen, fresh, n = None, written(parents.sparkSession.createDataFrame([(start,)], "id string"), "above"), 0
    while True:
        line = fresh
        for jump in jumps[:-1]:
            line = line.unionByName(jump.join(few(line), "id").select(F.col("parent").alias("id"))).distinct()
            line = written(line if seen is None else line.join(few(seen), "id", "left_anti"), "above")
        n += line.count()
        if most is not None and n > most:
            raise ValueError(f"{start} has more than {most} ancestors")
        seen = line if seen is None else seen.unionByName(line)
        fresh = written(up.join(few(line), "id").select(F.col("parent").alias("id")).distinct().join(few(seen), "id", "left_anti"), "above")
        if fresh.isEmpty():
            return seen


def first_critical(edges: DataFrame, tests: DataFrame, critical: DataFrame, max_depth: int = MAX_DEPTH, max_seen: int = CRITICAL_SEEN) -> DataFrame:
    """test, id, depth: of every test (id) that reaches a critical symbol (id) by what it depends on, the first that a queue finds.

    A queue finds the nearest one, of several the one with the least way. Ways are followed back from the critical symbols, a level at a time: each symbol keeps its nearest one by the
    least of its neighbours, so a table has a row a symbol, not one for each test and symbol. A symbol is not gone beyond once the test has seen max_seen symbols: tests
    around which there may be more, and tests that are critical themselves, are searched one by one (`_searched`)."""
    uses = written(edges.filter(~F.col("kind").isin(*SILENT_KINDS, "TESTS") & (F.col("f") != F.col("t"))).select("f", "t").distinct(), "uses")
    goal, tests = critical.select("id").distinct(), tests.select("id").distinct()
    # around: a bound of the symbols seen in so many steps; within: that bound where the critical one was found.
    known = written(goal.select("id", F.lit(0).alias("depth"), F.col("id").alias("first"), F.lit(1).cast("bigint").alias("around"), F.lit(1).cast("bigint").alias("within")), "nearest")
    for depth in range(1, max_depth + 1):
        near = uses.join(known.withColumnRenamed("id", "t"), "t", "left")
        way = F.min(F.when(F.col("depth") == depth - 1, F.struct("t", "first")))["first"]
        near = near.groupBy(F.col("f").alias("id")).agg((F.sum(F.coalesce("around", F.lit(1))) + 1).alias("so_many"), way.alias("found"))
        # No more than one over the bound: sums stay small.
        near = near.withColumn("so_many", F.least("so_many", F.lit(max_seen + 1)))
        both = known.join(near, "id", "full_outer")
        fresh = F.col("depth").isNull() & F.col("found").isNotNull()
        known = both.select("id", F.when(fresh, depth).otherwise(F.col("depth")).alias("depth"), F.coalesce("first", "found").alias("first"), F.coalesce("so_many", "around").alias("around"), F.when(fresh, F.col("so_many")).otherwise(F.col("within")).alias("within"))
        known = written(known, "nearest")
        if known.filter(F.col("depth") == depth).isEmpty():
            break
    hit = known.filter("depth > 0").select("id", "first", "depth", "within").join(tests, "id", "left_semi")
    few = hit.filter(F.col("within") <= max_seen).select(F.col("id").alias("test"), F.col("first").alias("id"), "depth")
    rest = written(hit.filter(F.col("within") > max_seen).select("id").union(tests.join(goal, "id", "left_semi")), "tests")
    return few if rest.isEmpty() else few.unionByName(_searched(uses, rest, goal, max_depth, max_seen))


def _searched(uses: DataFrame, tests: DataFrame, goal: DataFrame, max_depth: int, max_seen: int) -> DataFrame:
    """test, id, depth as first_critical says, with what each test has seen.

    All tests are searched at once, level by level. A symbol keeps the ends of the hops that led to it, which order a level as each test's queue would.
    A test that has found one is not searched on."""
    level = written(tests.select("id").distinct().select(F.col("id").alias("test"), "id", F.array().cast("array<string>").alias("way")), "level")
    seen, found = level.select("test", "id"), None
    for depth in range(1, max_depth + 1):
        ways = uses.join(level, F.col("f") == F.col("id")).select("test", F.col("t").alias("id"), "way")
        best = ways.groupBy("test", "id").agg(F.min("way").alias("from")).join(seen, ["test", "id"], "left_anti")
        # What the queue had seen before it came to the symbol that led here.
        before = seen.groupBy("test").agg(F.count(F.lit(1)).alias("so_far"))
        place = F.rank().over(Window.partitionBy("test").orderBy("from"))
        best = best.withColumn("place", place).join(before, "test").filter(F.col("so_far") + F.col("place") - 1 < max_seen)
        level = written(best.select("test", "id", F.array_append("from", F.col("id")).alias("way")), "level")
        if level.isEmpty():
            break
        hit = level.join(bounded_broadcast(goal, BROADCAST_ROWS), "id", "left_semi").groupBy("test").agg(F.min(F.struct("way", "id"))["id"].alias("id"))
        hit = written(hit.select("test", "id", F.lit(depth).alias("depth")), "critical")
        found = hit if found is None else found.unionByName(hit)
        seen = seen.unionByName(level.select("test", "id"))
        level = level.join(hit.select("test"), "test", "left_anti")
    return found if found is not None else level.select("test", "id", F.lit(0).alias("depth")).limit(0)


def parent_closure(symbols: DataFrame) -> DataFrame:
    """id, ancestor, distance (1 and more, the least) over (id, parent); an id may have several parents, and cycles end.

    Distances double: the ancestors that are just as far as was looked are joined with all that are known, so that a chain of n takes log n rounds."""
    known = symbols.filter("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    known, reach = written(known.filter("id <> ancestor"), "closure"), 1
    while True:
        far = known.filter(F.col("distance") == reach).select("id", F.col("ancestor").alias("via"), F.col("distance").alias("so_far"))
        if far.isEmpty():
            return known
        up = known.select(F.col("id").alias("via"), "ancestor", "distance")
        more = far.join(up, "via").filter("id <> ancestor").groupBy("id", "ancestor").agg(F.min(F.col("so_far") + F.col("distance")).alias("distance"))
        more = written(more.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti"), "closure")
        known, reach = known.unionByName(more), 2 * reach


def components(pairs: DataFrame) -> DataFrame:
    """id, component (its smallest id) of the nodes of an undirected graph (a, b).

    Labels go down along the edges and then jump to their own labels until none changes: a chain of n takes about log n rounds, and the tables have one row a node and one an edge."""
    both = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "ends")
    label = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("component", F.col("id")), "labels")
    while True:
        # The least label around a node is offered to the node and to its present label.
        near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("new")), "b").groupBy(F.col("a").alias("id")).agg(F.min("new").alias("new"))
        best = label.join(near, "id", "left").select("id", "component", F.least("component", "new").alias("new"))
        root = best.groupBy(F.col("component").alias("id")).agg(F.min("new").alias("to"))
        lower = best.join(root, "id", "left").select("id", "component", F.least("new", "to").alias("new"))
        lower = written(lower, "labels")
        up = lower.select(F.col("id").alias("new"), F.col("new").alias("far"))
        after = written(lower.join(up, "new", "left").select("id", F.least("new", "far").alias("component"), (F.least("new", "far") != F.col("component")).alias("moved")), "labels")
        label = after.select("id", "component")
        if after.filter("moved").isEmpty():
            return label


#: Edges of a component whose cycles one task finds.
TASK_EDGES = 200_000


def _own_cycles(edges: DataFrame) -> DataFrame:
    """id, cycle: the cycles (named by a member) of components (a, b, component) of at most TASK_EDGES edges, one after the other in each task."""
    rows = edges.select("component", "a", "b").repartition("component").sortWithinPartitions("component", "a", "b")

    def of(pairs: list[tuple]) -> list[tuple]:
        # Depth first: a node that reaches nothing older than itself closes its cycle.
        out: dict = {}
        for a, b in pairs:
            out.setdefault(a, []).append(b)
        found, number, low, stack, held = [], {}, {}, [], set()
        for start in out:
            if start in number:
                continue
            number[start] = low[start] = len(number)
            stack.append(start)
            held.add(start)
            way = [(start, iter(out[start]))]
            while way:
                at, rest = way[-1]
                nxt = next(rest, None)
                if nxt is None:
                    way.pop()
                    if way:
                        low[way[-1][0]] = min(low[way[-1][0]], low[at])
                    if low[at] == number[at]:
                        own = []
                        while not own or own[-1] != at:
                            own.append(stack.pop())
                        held.difference_update(own)
                        found += [(member, at) for member in own] if len(own) > 1 else []
                elif nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    stack.append(nxt)
                    held.add(nxt)
                    way.append((nxt, iter(out.get(nxt, ()))))
                elif nxt in held:
                    low[at] = min(low[at], number[nxt])
        return found

    def run(batches):
        now, pairs = None, []

        def told(found: list[tuple]):
            return pa.RecordBatch.from_pydict({"id": pa.array([x for x, _ in found], kind), "cycle": pa.array([x for _, x in found], kind)})

        for batch in batches:
            kind = batch.schema.field("a").type
            for c, a, b in zip(*(batch.column(k).to_pylist() for k in ("component", "a", "b")), strict=True):
                if c != now and pairs:
                    yield told(of(pairs))
                    pairs = []
                now = c
                pairs.append((a, b))
        if pairs:
            yield told(of(pairs))

    kind = dict(edges.dtypes)["a"]
    return rows.mapInArrow(run, f"id {kind}, cycle {kind}")


def _spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id: what the start (id) reaches along edges (a, b), level by level."""
    seen = frontier = written(start.select("id"), "spread")
    while True:
        new = edges.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = written(new.join(seen, "id", "left_anti"), "spread")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def _on_ways(edges: DataFrame) -> DataFrame:
    """edges without those that lead from a node nothing leads to, or to one that leads nowhere; again as long as a tenth of them goes."""
    n = edges.count()
    while True:
        edges = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        edges, before = written(edges.select("a", "b", "component"), "ways"), n
        n = edges.count()
        if n > 0.9 * before:
            return edges


def cycles(pairs: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """member, cycle (its smallest member): strongly connected components of more than one node of a graph (a, b).

    Components of few edges are gone through in tasks, many at once. In each larger one, what the node with the most ways in and out reaches and is reached by is
    one cycle; any other lies wholly inside or outside of either set, so only edges that stay on one side of both go on, and fall apart into components again.
    No table has more rows than the graph has edges."""
    left, found = written(pairs.select("a", "b").filter("a <> b").distinct(), "cycles"), None
    while not left.isEmpty():
        if left.limit(task_edges + 1).count() <= task_edges:
            # So few edges are one task's work, whether they hang together or not.
            small = written(_own_cycles(left.withColumn("component", F.lit(0))), "found")
            found = small if found is None else found.unionByName(small)
            break
        edges = written(left.join(components(left).withColumnRenamed("id", "a"), "a"), "cycles")
        sizes = written(edges.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
        small = written(_own_cycles(edges.join(sizes.filter(F.col("n") <= task_edges), "component", "left_semi")), "found")
        found = small if found is None else found.unionByName(small)
        large = edges.join(sizes.filter(F.col("n") > task_edges), "component", "left_semi")
        if large.isEmpty():
            break
        large = _on_ways(written(large.select("a", "b", "component"), "ways"))
        ways = large.groupBy("component", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("x")).join(large.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("y")), "id")
        pivot = written(ways.groupBy("component").agg(F.min(F.struct((-F.col("x") * F.col("y")).alias("w"), "id"))["id"].alias("id")), "pivots")
        there, back = _spread(large, pivot), _spread(large.select(F.col("b").alias("a"), F.col("a").alias("b")), pivot)
        side = written(there.withColumn("there", F.lit(1)).join(back.withColumn("back", F.lit(2)), "id", "full_outer").select("id", (F.coalesce("there", F.lit(0)) + F.coalesce("back", F.lit(0))).alias("side")), "sides")
        where = large.select(F.col("a").alias("id"), "component").union(large.select("b", "component")).distinct()
        one = side.filter("side = 3").join(where, "id").join(pivot.select("component", F.col("id").alias("cycle")), "component").select("id", "cycle")
        found = found.unionByName(written(one, "found"))
        of = lambda end: side.select(F.col("id").alias(end), F.col("side").alias(f"{end}_side"))
        rest = large.join(of("a"), "a", "left").join(of("b"), "b", "left").fillna(0, ["a_side", "b_side"])
        left = written(rest.filter("a_side = b_side and a_side <> 3").select("a", "b"), "cycles")
    if found is None:
        found = left.select(F.col("a").alias("id"), F.col("a").alias("cycle"))
    least = written(found, "found").groupBy("cycle").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(least, "cycle").select(F.col("id").alias("member"), F.col("least").alias("cycle"))


def cycle_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges (a, b and more) with cycle: those that run inside a component (member, cycle), its evidence."""
    own, other = members.select(F.col("member").alias("a"), "cycle"), members.select(F.col("member").alias("b"), F.col("cycle").alias("there"))
    return edges.join(own, "a").join(other, "b").filter("cycle = there").drop("there")


def centrality(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, dependents: distinct symbols that depend on it directly, tests aside."""
    direct = edges.filter(~F.col("kind").isin(*SILENT_KINDS, "TESTS"))
    counts = direct.groupBy(F.col("t").alias("id")).agg(F.count_distinct("f").alias("dependents"))
    return ids.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("dependents", F.lit(0)).cast("bigint").alias("dependents"))


def slice_edges(nodes: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """Edges between nodes, from several sources in order of preference: the first source that has (f, t, kind) wins."""
    every = layers[0].withColumn("source", F.lit(0))
    for i, e in enumerate(layers[1:], 1):
        every = every.unionByName(e.withColumn("source", F.lit(i)))
    inside = attached_edges(every, nodes)
    rest = ["strength", "line", "source"]
    return inside.groupBy("f", "t", "kind").agg(F.min(F.struct("source", "ev_ord", "line", "strength")).alias("x")).select("f", "t", "kind", *(F.col(f"x.{c}") for c in rest))


def top_by_depth(reached: DataFrame, cap: int) -> DataFrame:
    """The first cap rows by depth and id."""
    return reached.orderBy("depth", "id").limit(cap)


def ranked(df: DataFrame, group: list[str], *order) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter("_rn = 1").drop("_rn")


def path_either_way(edges: DataFrame, source: str, target: str, max_depth: int = PATH_DEPTH) -> Path:
    """The path from source to target or, where there is none, the one back; `reversed` tells which."""
    there = dependency_path(edges, source, target, max_depth)
    if source == target or not there.hops.isEmpty():
        return Path(there.hops.withColumn("reversed", F.lit(False)), there.truncated)
    back = dependency_path(edges, target, source, max_depth)
    return Path(back.hops.withColumn("reversed", F.lit(True)), there.truncated or back.truncated)


def reaching(edges: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """id, depth: what depends on any of the targets (id) by edges other than containment, with the fewest steps; targets have 0.

    Both sets stay on the cluster; each level is one join and one anti-join on written tables."""
    back = edges.filter("kind <> 'CONTAINS'").select(F.col("t").alias("n"), F.col("f").alias("nxt"))
    level = written(targets.select("id", F.lit(0).alias("depth")).distinct(), "reach")
    seen = level
    for d in range(1, max_depth + 1):
        nxt = back.join(bounded_broadcast(level, BROADCAST_ROWS), F.col("n") == F.col("id")).select(F.col("nxt").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        level = written(nxt.select("id", F.lit(d).alias("depth")), "reach")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def overrides(methods: DataFrame, supers: DataFrame) -> DataFrame:
    """f, t, strength: the nearest method up the hierarchy (owner, above, distance) with the name and the erased parameters of a method (id, owner, name, params, signature);
    exact (5) if the signatures are equal, else inferred (3).

    What an owner has above it under a name and parameters is found once for all of its methods that have them, so that no pairs of methods are made."""
    key = ["name", "params"]
    least = methods.groupBy(F.col("owner").alias("above"), *key).agg(F.min(F.struct("id", "signature")).alias("m"))
    above = supers.join(least, "above").groupBy("owner", *key).agg(F.min(F.struct("distance", F.col("m.id").alias("t"), F.col("m.signature").alias("theirs"))).alias("x"))
    strength = F.when(F.col("signature") == F.col("x.theirs"), 5).otherwise(3)
    best = methods.join(above, ["owner", *key]).groupBy(F.col("id").alias("f")).agg(F.min(F.struct("x.distance", "x.t", strength.alias("strength"))).alias("y"))
    return best.select("f", F.col("y.t").alias("t"), F.col("y.strength").alias("strength"))


def with_hub(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, dependents: the one of the ids with the most direct dependents, the first id of equal ones."""
    return centrality(edges, ids).orderBy(F.desc("dependents"), "id").limit(1)


def symbol_info(edges: DataFrame, symbols: DataFrame, reached: DataFrame, symbol: str) -> DataFrame:
    """id, kind, file, incoming, outgoing, impacted, tests of one symbol; reached: what its change reaches (id)."""
    one = symbols.filter(F.col("id") == symbol).select("id", "kind", "file")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    tests = reached.join(symbols.filter("is_test").select("id"), "id", "left_semi")
    return one.crossJoin(count(incoming(edges, symbol), "incoming")).crossJoin(count(outgoing(edges, symbol), "outgoing")).crossJoin(count(reached, "impacted")).crossJoin(count(tests, "tests"))


def slice_nodes(changed: DataFrame, impacted: DataFrame, cap: int = SLICE_NODES) -> DataFrame:
    """id: the nodes of a graph slice, cap of them at most: changed symbols (id, kind) that are no files first, then the impacted (id, depth) by depth; a top-k report."""
    own = changed.filter("kind <> 'file'").select("id", F.lit(0).alias("depth"))
    every = own.union(impacted.select("id", "depth")).groupBy("id").agg(F.min("depth").alias("depth"))
    return every.orderBy("depth", "id").limit(cap).select("id")


def suggestions(symbols: DataFrame, wanted: str, cap: int = 5) -> DataFrame:
    """id: what a wrong id may have meant: ids that hold it, else its last segment, else its owner; the first of these that finds any."""
    tail, owner = wanted.replace("#", ".").split(".")[-1].split("(")[0], wanted.split("#")[0]
    tries = [t for t in dict.fromkeys((wanted, tail, owner)) if t]
    rank = F.coalesce(*(F.when(F.contains(F.lower("id"), F.lit(t.lower())), F.lit(i)) for i, t in enumerate(tries)))
    hit = symbols.select("id", rank.alias("rank")).filter("rank is not null")
    best = hit.agg(F.min("rank").alias("best"))
    return hit.join(F.broadcast(best), F.col("rank") == F.col("best")).select("id").orderBy("id").limit(cap)


def touched_modules(changed: DataFrame, impacted: DataFrame, symbols: DataFrame) -> DataFrame:
    """modules: the number of distinct modules of changed and impacted symbols, one row."""
    ids = changed.select("id").union(impacted.select("id")).distinct()
    return symbols.join(ids, "id", "left_semi").agg(F.count_distinct("module").alias("modules"))


def involving(rows: DataFrame, symbol: str) -> DataFrame:
    """The rows (f, t, ...) one end of which is the symbol."""
    return rows.filter((F.col("f") == symbol) | (F.col("t") == symbol))
