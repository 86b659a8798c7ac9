"""Hard negatives of anchors from vantage-point trees.

A row's score is its integer inner product with the anchor. With M the greatest norm of a tree's rows, a row x is augmented by
sqrt(M^2 - |x|^2) and an anchor a by 0: then |a' - x'|^2 = |a|^2 + M^2 - 2 a.x, so the nearest rows have the greatest scores and a window of scores is an
annulus of distances. A tree halves its rows by their distance to a vantage point, again and again, down to leaves of LEAF rows. The distances of an
anchor to a tree's vantage points bound those to each leaf (triangle inequality). Leaves are visited nearest first, from the annulus' inner edge; a search ends
when its k rows are nearer than the next leaf, or that lies past the outer edge. Bounds are widened by a margin and scores are exact, so a search loses nothing.

Anchors are taken in blocks of a bounded number of bytes, broadcast, against all rows. Each task makes trees of BLOCK rows at a time as it reads,
and carries what its searches have found from one tree to the next; what the tasks found is merged by (anchor, positive). Nothing else is
shuffled, and copies of one vector are spread as they lie.

Cases: rows with a null label or vector, or with a null or non-finite component, take no part; a component x becomes floor(256 x); one so large that a
score might pass 2^56 counts as the largest that cannot; vectors of unlike lengths are compared over the positions both have; an empty vector scores 0; rows that repeat, or
share an id, are rows of their own (an anchor's other rows are all but itself); a row without an id is no anchor, and comes after all ids of
its score; extra columns are not read; an empty table, or one without anchors, gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.llm.common import partitions, written

#: An anchor's id is a multiple of this; its positives; its negatives for each of them; hundredths of the positive's score a negative may have.
EVERY, POSITIVES, NEGATIVES, LEAST, MOST = 100, 5, 10, 30, 90
#: Rows of a tree and of a leaf; searches that go through a tree together; bytes of a block of anchors.
BLOCK, LEAF, SEARCHES, ANCHOR_BYTES = 16_384, 128, 4096, 1 << 24
_NO_ID = np.iinfo(np.int64).max
_NONE = -(1 << 62)
#: No score can pass this, so that hundred of one fit a long.
MOST_SCORE = 2.0**56


class Tree(NamedTuple):
    """rows in the order of the leaves, each leaf a run of them; per leaf its vantage points with the least and greatest distance of its rows."""

    vector: np.ndarray
    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    extra: np.ndarray
    most: float
    vantage: np.ndarray
    bounds: list  # of (from, to, [(vantage, least, greatest)])


class Search(NamedTuple):
    """vector: by anchor; of: each search's anchor; row: the row not to be found; low, high: the window; best: scores, ids and extra of the k best so far."""

    vector: np.ndarray
    of: np.ndarray
    row: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    score: np.ndarray
    id: np.ndarray


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where no sum can pass 2^53, else as longs."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def tree_of(vector: np.ndarray, row: np.ndarray, ids: np.ndarray, label: np.ndarray, leaf: int = LEAF) -> Tree:
    real = vector.astype(np.float64)
    norm = (real * real).sum(axis=1)
    most = float(norm.max(initial=0.0))
    extra = np.sqrt(np.maximum(0.0, most - norm))
    order, vantage, bounds = np.arange(len(row)), [], []

    def split(at: int, to: int, path: list) -> None:
        if to - at <= leaf:
            bounds.append((at, to, path))
            return
        own = order[at:to]
        v = int(own[0])
        d = np.sqrt(np.maximum(0.0, ((real[own] - real[v]) ** 2).sum(axis=1) + (extra[own] - extra[v]) ** 2))
        # Halves by number, not by the middle distance: copies of one vector, all at one distance, are still shared out.
        by = np.argsort(d, kind="stable")
        order[at:to], d = own[by], d[by]
        middle, k = (to - at) // 2, len(vantage)
        vantage.append(v)
        split(at, at + middle, [*path, (k, d[0], d[middle - 1])])
        split(at + middle, to, [*path, (k, d[middle], d[-1])])

    if len(row):
        split(0, len(row), [])
    return Tree(vector[order], row[order], ids[order], label[order], extra[order], most, np.argsort(order)[vantage] if vantage else np.zeros(0, dtype=np.int64), bounds)


def leaf_scores(tree: Tree, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each leaf may hold, by anchor, widened by the margin of rounding."""
    real = anchors.astype(np.float64)
    whole = (real * real).sum(axis=1)[:, None] + tree.most
    margin = 1e-6 * whole + 1
    d = np.sqrt(np.maximum(0.0, whole - 2.0 * scores(anchors, tree.vector[tree.vantage])))
    low, high = np.full((len(anchors), len(tree.bounds)), -np.inf), np.full((len(anchors), len(tree.bounds)), np.inf)
    for i, (_, _, path) in enumerate(tree.bounds):
        near, far = np.zeros(len(anchors)), np.full(len(anchors), np.inf)
        for k, least, greatest in path:
            near = np.maximum(near, np.maximum(d[:, k] - greatest, least - d[:, k]))
            far = np.minimum(far, d[:, k] + greatest)
        high[:, i] = (whole[:, 0] - near * near) / 2 + margin[:, 0]
        low[:, i] = (whole[:, 0] - far * far) / 2 - margin[:, 0]
    return low, high


def searched(tree: Tree, s: Search, most: int = SEARCHES) -> None:
    """Betters s.score and s.id by the tree's rows."""
    for at in range(0, len(s.of), most):
        own = np.arange(at, min(at + most, len(s.of)))
        anchors, back = np.unique(s.of[own], return_inverse=True)
        low, high = (x[back] for x in leaf_scores(tree, s.vector[anchors]))
        high = np.minimum(high, s.high[own][:, None].astype(np.float64))
        # Nothing of a leaf lies in the window: all within the inner edge, or all past the outer one.
        high[(low > s.high[own][:, None]) | (high < s.low[own][:, None])] = -np.inf
        order = np.argsort(-high, axis=1, kind="stable")
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            # A leaf that can only tie may still hold a smaller id.
            live = high[np.arange(len(own)), leaf] >= s.score[own, -1]
            if not live.any():
                break
            by = np.argsort(leaf[live], kind="stable")
            some, leaves = own[live][by], leaf[live][by]
            edges = np.flatnonzero(np.diff(leaves, prepend=-1, append=-1))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                _visit(tree, s, some[i:j], *tree.bounds[leaves[i]][:2])


def _visit(tree: Tree, s: Search, which: np.ndarray, at: int, to: int) -> None:
    anchors, back = np.unique(s.of[which], return_inverse=True)
    score = scores(s.vector[anchors], tree.vector[at:to])[back]
    fits = (tree.label[None, at:to] == s.label[which][:, None]) == s.same
    fits &= (tree.row[None, at:to] != s.row[which][:, None]) & (score >= s.low[which][:, None]) & (score <= s.high[which][:, None]) & (score >= s.score[which, -1][:, None])
    hit = np.flatnonzero(fits.any(axis=1))
    if not len(hit):
        return
    which, k = which[hit], s.score.shape[1]
    new = np.where(fits[hit], score[hit], _NONE)
    all_scores = np.concatenate([s.score[which], new], axis=1)
    all_ids = np.concatenate([s.id[which], np.broadcast_to(tree.id[at:to], new.shape)], axis=1)
    # The greatest scores first, then the smallest ids.
    best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
    s.score[which], s.id[which] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as a matrix: cut or filled up with zeros to the width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    at = np.cumsum(size) - size
    for i, (a, n) in enumerate(zip(at.tolist(), np.minimum(size, width).tolist(), strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def relabelled(vectors: DataFrame) -> DataFrame:
    """Rows whose vec_id is a multiple of 7 have the next of ten labels."""
    label = F.col("label").cast("bigint")
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


def usable(vectors: DataFrame) -> DataFrame:
    """row, id, label, vector (whole numbers) of the rows that take part, written."""
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.size("embedding")
    # Of two rows the shorter one bounds the number of products, and neither has a component that passes its own limit.
    limit = F.sqrt(F.lit(MOST_SCORE) / F.greatest(size, F.lit(1)))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e15)), F.lit(-1e15)) * 256).cast("double"), F.floor(limit)), -F.floor(limit)).cast("bigint"))
    rows = vectors.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), whole.alias("vector"))
    # The searches cost more than the reading: every core gets its share.
    return written(rows.repartition(partitions(vectors.sparkSession), "row"), "vectors")


def _found(rows: DataFrame, make, k: int) -> DataFrame:
    """anchor, nth (of the search), score, id: the k best of each task for each search; make() gives the searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = make()
        held, size = [], 0

        def plant() -> None:
            table = pa.Table.from_batches(held)
            ids = table["id"].combine_chunks().fill_null(_NO_ID).to_numpy()
            searched(tree_of(matrix(table["vector"], s.vector.shape[1]), table["row"].to_numpy(), ids, table["label"].to_numpy()), s)
            held.clear()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                plant()
                size = 0
        if held:
            plant()
        got = s.score > _NONE
        nth = np.repeat(np.arange(len(got)), got.sum(axis=1))
        for i in range(0, len(nth), 50_000):
            one = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(nth[one]), pa.array(s.score[got][one]), pa.array(s.id[got][one])], names=["nth", "score", "id"])

    return rows.select("row", "id", "label", "vector").mapInArrow(run, "nth bigint, score bigint, id bigint")


def _ranked(found: DataFrame, group: list[Column | str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; vectors: vec_id, label, embedding.

    An anchor's positives are its best other rows of its label; a positive's negatives the best rows of other labels with least to most hundredths of its score."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    anchors = rows.filter(f"id % {every} = 0")
    told = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = told["width"] or 0
    blocks = max(1, -(-(told["n"] * (8 * width + 16 * positives * (negatives + 2))) // anchor_bytes))
    out = None
    for block in range(blocks):
        # About anchor_bytes: the block's anchors and what is found for them.
        some = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").toArrow()
        if not some.num_rows and out is not None:
            continue
        a = {"row": some["row"].to_numpy(), "id": some["id"].to_numpy(), "label": some["label"].to_numpy(), "vector": matrix(some["vector"], width)}
        n = len(a["row"])
        sent = spark.sparkContext.broadcast(a)

        def for_positives(sent=sent, n=n):
            b = sent.value
            wide = np.full(n, np.iinfo(np.int64).max)
            return Search(b["vector"], np.arange(n), b["row"], b["label"], -wide, wide, True, np.full((n, positives), _NONE), np.full((n, positives), _NO_ID))

        best = _ranked(_found(rows, for_positives, positives), ["nth"], positives).orderBy("nth", "rank").select("nth", "score", "id").toArrow()
        p = {"of": best["nth"].to_numpy(), "score": best["score"].to_numpy(), "id": best["id"].to_numpy()}
        pairs = spark.sparkContext.broadcast(p)

        def for_negatives(sent=sent, pairs=pairs):
            b, q = sent.value, pairs.value
            low, high = -((-least * q["score"]) // 100), most * q["score"] // 100
            m = len(q["of"])
            return Search(b["vector"], q["of"], b["row"][q["of"]], b["label"][q["of"]], low, high, False, np.full((m, negatives), _NONE), np.full((m, negatives), _NO_ID))

        found = _ranked(_found(rows, for_negatives, negatives), ["nth"], negatives)
        names = spark.createDataFrame(pa.table({"nth": np.arange(len(p["of"])), "anchor_id": a["id"][p["of"]], "positive_id": p["id"], "positive_score": p["score"]}))
        one = found.join(F.broadcast(names), "nth")
        one = one.select("anchor_id", F.when(F.col("positive_id") != int(_NO_ID), F.col("positive_id")).alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != int(_NO_ID), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = one if out is None else out.unionByName(one)
    return out
