"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles; its sketch the smallest of them. Documents with equal
sets form a class, and one of them stands for it. Two sets of a similarity of 0.8 or more have at least `need` of a sketch in common (for
sketches of 64 values the chance of fewer is below 1e-4 at 0.8 exactly, and far less above; a set no larger
than its sketch leaves no chance). Such sketches share one of their rarest values: only those enter the inverted lists, which
keeps passages that many documents share out of them. In every list the member whose values are the most frequent is
the centre, and each member is compared with it. Members that these links leave apart get longer sketches (the whole set, for
most), from which again the rarest enter lists. Each is compared with its lists' new centres, and only what is then still
apart with one another: of a list only those pairs are taken in which enough values follow the shared one
in both orders to reach the threshold, so that a large group of texts that are nearly, but not quite, alike gives few pairs.
A pair is estimated from the union of its sketches, and what may reach the threshold is confirmed on the full sets,
made again from the whole texts.

All that may lose a link is in Bounds: with EXACT the sketches are the whole sets, as many values are asked for as the threshold
itself asks, and estimates have no slack to need, so that no link is lost, at the price of longer lists.

Cases: texts without words have no set and stay alone; a text of fewer words than a shingle has one shingle, all of them;
a null doc_id is linked with nothing, has a null component and is kept; rows that repeat a doc_id are one node, and each of them is returned;
ties go to the smaller doc_id; extra columns are not read; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import most_frequent, written
from ripplegraph.llm.components import components
from ripplegraph.llm.words import U, Words, mixed, slices, words

#: Words of a shingle, percent of similarity.
SHINGLE, PERCENT = 4, 80
#: Values known by their frequency (the most frequent ones); all others count as equally rare.
RANKED_VALUES, FREQUENT = 1_000_000, 24


class Bounds(NamedTuple):
    """sketch: values of a sketch; need: the share of it that linked sets have in common, at least; long, need_long: those of the second sketch, where sets of up to
    `long` values are whole and go by the threshold; slack: what an estimate may fall short of it."""

    sketch: int = 64
    need: float | None = 0.6
    long: int = 1024
    need_long: float = 0.7375
    slack: float = 0.22


#: need is 4.9 and need_long five standard deviations below the threshold of 0.8; need None: the threshold itself.
SAMPLED = Bounds()
EXACT = Bounds(sketch=1 << 30, need=None, long=1 << 30, need_long=1.0, slack=0.0)


def shingle_sets(w: Words, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice."""
    n = len(w.hash)
    odd = mixed(np.arange(1, width + 1, dtype=np.uint64)) | U(1)
    full = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        full += w.hash[k : n - width + 1 + k] * odd[k]
    full = mixed(full)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1].view(np.int64))
        elif b > a:
            yield mixed((w.hash[a:b] * odd[: b - a]).sum(keepdims=True) + U(b - a)).view(np.int64)
        else:
            yield np.zeros(0, dtype=np.int64)


def sketches(docs: DataFrame, width: int = SHINGLE, size: int = SAMPLED.sketch) -> DataFrame:
    """doc_id, n_shingles, f and g (128 bits that stand for the set), sketch (ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, f, g, sketch = [], [], [], []
                for s in shingle_sets(words(part.column("text")), width):
                    u = s.view(np.uint64)
                    n.append(len(s))
                    f.append(int(mixed(u ^ U(0xA5A5)).sum().astype(np.int64)))
                    g.append(int(mixed(u + U(0x1234567)).sum().astype(np.int64)))
                    sketch.append(s[:size])
                at = np.concatenate([[0], np.cumsum([len(x) for x in sketch])]).astype(np.int32)
                values = np.concatenate(sketch) if sketch else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.ListArray.from_arrays(at, values)], names=["doc_id", "n_shingles", "f", "g", "sketch"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, f bigint, g bigint, sketch array<bigint>")


def ranked_values(sets: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of `sketch` that at least `least` rows have, and how many: the most frequent ones, at most RANKED_VALUES, by value."""
    counts = sets.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    top = most_frequent(written(counts, "counts"), "c", RANKED_VALUES).toArrow().combine_chunks().sort_by("value")
    return top.column("value").to_numpy(), top.column("c").to_numpy()


def rare_values(sets: DataFrame, least: int, long: bool = False, percent: int = PERCENT, bounds: Bounds = SAMPLED) -> DataFrame:
    """id, f, n, root, value, i, s, weight: each row's rarest sketch values with their places in its order, the sketch's size, and how frequent all its values are."""
    spec = sets.sparkSession.sparkContext.broadcast(ranked_values(sets, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = spec.value
        for batch in batches:
            lists = batch.column("sketch")
            at = np.asarray(lists.offsets)
            flat = np.asarray(lists.values)[at[0] : at[-1]]
            at = at - at[0]
            c = np.ones(len(flat), dtype=np.int64)
            if len(known):
                p = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                c = np.where(known[p] == flat, often[p], c)
            size = np.diff(at)
            row = np.repeat(np.arange(len(lists)), size)
            order = np.lexsort((flat, c, row))
            share = np.where(np.asarray(batch.column("n")) > 0.8 * bounds.long, bounds.need_long, percent / 100) if long else bounds.need or percent / 100
            need = np.ceil(size * share - 1e-9)
            place = np.arange(len(flat)) - at[row]
            take = place < (size - need + 1)[row]
            first = order[take]
            weight = np.bincount(row, weights=c, minlength=len(lists)) / np.maximum(1, size)
            of = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(of) for x in ("id", "f", "n", "root")), pa.array(flat[first]), pa.array(place[take]), pa.array(size[row[first]].astype(np.int64)), pa.array(weight[row[first]])], names=["id", "f", "n", "root", "value", "i", "s", "weight"])

    kind = dict(sets.dtypes)["id"]
    return sets.select("id", "f", "n", "root", "sketch").mapInArrow(run, f"id {kind}, f bigint, n bigint, root {kind}, value bigint, i bigint, s bigint, weight double")


def long_sketches(rows: DataFrame, width: int, long: int) -> DataFrame:
    """rows (id, f, n, root, text) with sketch, the `long` smallest values, for text."""
    kept = [c for c in rows.columns if c != "text"]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sketch = [x[:long] for x in shingle_sets(words(part.column("text")), width)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in sketch])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.ListArray.from_arrays(at, np.concatenate(sketch) if sketch else np.zeros(0, dtype=np.int64))], names=[*kept, "sketch"])

    return rows.select(*kept, "text").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", sketch array<bigint>")


def _like(percent: int) -> str:
    """Sizes that allow the similarity."""
    return f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"


def estimated(pairs: DataFrame, classes: DataFrame, percent: int, bounds: Bounds) -> DataFrame:
    """The pairs (a, fa, b, fb) that the union of their sketches leaves possible."""
    s = classes.select("id", "f", "sketch")
    both = pairs.join(s.toDF("a", "fa", "sa"), ["a", "fa"]).join(s.toDF("b", "fb", "sb"), ["b", "fb"])
    union = f"slice(array_sort(array_union(sa, sb)), 1, {bounds.sketch})"
    share = F.expr(f"size(array_intersect(array_intersect({union}, sa), sb)) / size({union})")
    # Sets no larger than a sketch are known whole: their estimate is exact.
    exact = (F.size("sa") < bounds.sketch) & (F.size("sb") < bounds.sketch) & (F.expr("size(array_union(sa, sb))") <= bounds.sketch)
    return both.filter(F.when(exact, share >= percent / 100 - 1e-9).otherwise(share >= percent / 100 - bounds.slack)).select("a", "fa", "b", "fb")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. docs: id, f, text of the classes' representatives."""
    both = pairs.join(docs.toDF("a", "fa", "ta"), ["a", "fa"]).join(docs.toDF("b", "fb", "tb"), ["b", "fb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta"):
                keep = [100 * (m := np.intersect1d(x, y, assume_unique=True).size) >= percent * (len(x) + len(y) - m) for x, y in zip(shingle_sets(words(part.column("ta")), width), shingle_sets(words(part.column("tb")), width), strict=True)]
                yield part.select(["a", "fa", "b", "fb"]).filter(pa.array(keep, pa.bool_()))

    kinds = dict(pairs.dtypes)
    return both.select("a", "fa", "b", "fb", "ta", "tb").mapInArrow(run, f"a {kinds['a']}, fa bigint, b {kinds['b']}, fb bigint")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bounds: Bounds = SAMPLED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; bounds: EXACT loses no link, SAMPLED one in ten thousand of those at the threshold itself."""
    # The texts are read twice, so that the sketches are stored once, for the classes alone.
    seen = written(sketches(docs, width).drop("sketch"), "sets")
    usable = seen.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(sketches(docs, width, bounds.sketch).filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f", "g").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    lists = rare_values(classes.withColumn("root", F.col("id")), FREQUENT, percent=percent, bounds=bounds).drop("root", "i", "s")
    centre = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", "id", "f", "n")).alias("c")).filter("size > 1")
    lists = written(lists.join(centre.select("value", "c"), "value").select("value", "id", "f", "n", F.col("c.id").alias("cid"), F.col("c.f").alias("cf"), F.col("c.n").alias("cn")), "lists")
    texts = docs.select(F.col("doc_id"), "text")

    def with_text(ends: DataFrame) -> DataFrame:
        """ends (id, f and more) with the text of a row that has the id and the set."""
        rows = seen.select(F.col("doc_id").alias("id"), "f").join(ends.select("id", "f").distinct(), ["id", "f"], "left_semi").distinct()
        own = rows.join(texts, F.col("id") == F.col("doc_id")).select("id", "f", "text")
        return ends.join(one_text(own, seen, width), ["id", "f"])

    def linked(pairs: DataFrame, step: str) -> DataFrame:
        likely = written(estimated(pairs, classes, percent, bounds), f"likely-{step}")
        ends = likely.select(F.col("a").alias("id"), F.col("fa").alias("f")).union(likely.select("b", "fb")).distinct()
        return written(confirmed(likely, with_text(ends), percent, width), f"links-{step}")

    stars = lists.filter(f"NOT (id = cid AND f = cf) AND 100 * least(n, cn) >= {percent} * greatest(n, cn)").select(F.col("cid").alias("a"), F.col("cf").alias("fa"), F.col("id").alias("b"), F.col("f").alias("fb")).distinct()
    first = linked(stars, "stars")
    same_id = usable.groupBy("doc_id").agg(F.count_distinct("f", "g").alias("sets")).filter("sets > 1")
    again = usable.join(same_id.select("doc_id"), "doc_id", "left_semi").join(classes.select("f", "g", "id"), ["f", "g"]).select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    edges = written(first.select(F.col("a").alias("u"), F.col("b").alias("v")).union(again), "all-edges")
    roots = components(edges)
    # Lists with members that are still apart, besides the centre, whose pairs are done.
    named = lists.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    apart = named.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo <> hi AND m > 2").select("value")
    left = written(named.join(apart, "value", "left_semi").select("id", "f", "n", "root").distinct(), "apart")
    long = written(rare_values(written(long_sketches(with_text(left), width, bounds.long), "long"), 2, True, percent, bounds), "long-lists")
    # Values that follow the shared one, itself included, bound what a pair whose first shared value it is can have in common.
    enough = f"a.value = b.value AND {_like(percent)} AND CASE WHEN a.n <= {bounds.long} AND b.n <= {bounds.long} THEN {100 + percent} * least(a.n - a.i, b.n - b.i) >= {percent} * (a.n + b.n) ELSE least(a.s - a.i, b.s - b.i) >= {bounds.need_long} * least(a.s, b.s) END"
    ends = [F.col("a.id").alias("a"), F.col("a.f").alias("fa"), F.col("b.id").alias("b"), F.col("b.f").alias("fb")]
    # Whole sets tell better which member is the most typical: once more each is compared with that one,
    middle = long.groupBy("value").agg(F.max(F.struct("weight", "id", "f", "n", "i", "s", "root")).alias("c")).select("value", "c.*")
    second = linked(middle.alias("a").join(long.alias("b"), F.expr(f"{enough} AND a.root <> b.root")).select(*ends).distinct(), "middle")
    links = roots.toDF("u", "v").union(second.select("a", "b"))
    roots = components(links)
    # and only those that are still apart with one another.
    fresh = written(long.drop("root").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node"), "fresh")
    apart = fresh.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("value")
    fresh = fresh.join(apart, "value", "left_semi")
    third = linked(fresh.alias("a").join(fresh.alias("b"), F.expr(f"{enough} AND a.root < b.root")).select(*ends).distinct(), "rest")
    final = roots if third.isEmpty() else components(links.union(third.select("a", "b")))
    member = seen.join(classes.select(F.col("f").alias("cf"), F.col("g").alias("cg"), "id"), F.expr("f = cf AND g = cg AND n_shingles > 0 AND doc_id IS NOT NULL"), "left")
    out = member.join(final, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_text(own: DataFrame, seen: DataFrame, width: int) -> DataFrame:
    """One text for each (id, f): where an id has several texts, the one that has the set f."""
    several = seen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("rid"))
    if several.isEmpty():
        return own
    pick = own.join(several, F.col("id") == F.col("rid"), "left_semi")
    made = sketches(pick.select(F.struct("id", "f", "text").alias("doc_id"), "text"), width).filter("doc_id.f = f").select("doc_id.id", "doc_id.f", "doc_id.text").dropDuplicates(["id", "f"])
    return own.join(several, F.col("id") == F.col("rid"), "left_anti").union(made)


def deduplicated(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs (the columns they had) without the near-duplicates of a document with a smaller id.

    A row goes by its own text: where an id has several rows, a node is an id with a text, and of one id the smaller digest comes first. Rows that are
    the same in both go or stay together; rows without an id stay."""
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if several.isEmpty():
        gone = near_duplicates(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
    node = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.md5("text").alias("digest")))
    gone = near_duplicates(docs.select(node.alias("doc_id"), "text"), width, percent).filter("not kept").select(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.digest").alias("gone_digest")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & F.md5(docs["text"]).eqNullSafe(gone["gone_digest"]), "left_anti")
