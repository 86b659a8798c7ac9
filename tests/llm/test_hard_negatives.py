"""Hard negatives against all pairs."""

import random

import numpy as np
import pytest

from ripplegraph.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, every=100, k=5, m=10, least=30, most=90):
    fine = [(i, label, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, label in rows if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (a, label, v) in enumerate(fine):
        if a is None or a % every:
            continue

        def score(w, v=v):
            size = min(len(v), len(w))
            return int(v[:size] @ w[:size])

        found = [(-score(w), i is None, i, x, j) for j, (i, x, w) in enumerate(fine) if j != n]
        found.sort(key=lambda t: (t[0], t[1], t[2] or 0))
        for s, _, p, _, _ in [t for t in found if t[3] == label][:k]:
            negatives = [t for t in found if t[3] != label and least * -s <= 100 * -t[0] <= most * -s][:m]
            out += [(a, p, rank + 1, t[2], -s, -t[0]) for rank, t in enumerate(negatives)]
    return sorted(out, key=repr)


def clustered(r, n, width=8, labels=4):
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + r.gauss(0, 0.3) for c in r.choice(centres)], r.randrange(labels)) for i in range(n)]


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "label AS row", "label AS id", "vec_id AS score", "vec_id AS nth")
    return sorted((tuple(x) for x in hard_negatives.mined(df, **more).collect()), key=repr)


def test_equal_to_all_pairs(spark):
    rows = clustered(random.Random(1), 1500)
    assert mined(spark, rows, every=50) == brute(rows, every=50)


def test_copies_ties_and_odd_rows(spark):
    r = random.Random(2)
    rows = clustered(r, 300)
    same = [0.5] * 8
    rows += [(1000 + i, same, i % 3) for i in range(400)]  # a third of all rows and more are one vector
    rows += [(2000, same, 1), (2000, same, 1), (None, same, 1), (None, same, 2), (2100, [], 1), (2200, [1.0, 2.0], 2), (2300, None, 1), (2400, same, None)]
    rows += [(2500, [float("nan")] * 8, 1), (2600, [None] * 8, 2), (2700, [float("inf")] * 8, 1), (2800, [-1.0] * 8, 1), (2900, [0.0] * 8, 1)]
    assert mined(spark, rows) == brute(rows)


def test_many_blocks_of_anchors_and_small_trees(spark, monkeypatch):
    rows = clustered(random.Random(3), 600)
    monkeypatch.setattr(hard_negatives, "BLOCK", 150)
    assert mined(spark, rows, every=10, anchor_bytes=20_000) == brute(rows, every=10)


def test_no_rows(spark):
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert hard_negatives.mined(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_components_do_not_fail(spark):
    rows = [(i, [1e300, -1e300, 1e30], i // 50 % 2) for i in range(0, 400, 50)]
    got = mined(spark, rows, least=100, most=100)
    assert got and all(0 < x[4] == x[5] <= 2**56 for x in got)


def test_a_tree_bounds_its_leaves():
    r = np.random.default_rng(4)
    v = r.integers(-300, 300, (700, 16))
    tree = hard_negatives.tree_of(v, np.arange(700), np.arange(700), np.zeros(700, dtype=np.int64), leaf=20)
    assert sorted(tree.row) == list(range(700))
    a = r.integers(-300, 300, (9, 16))
    low, high = hard_negatives.leaf_scores(tree, a)
    s = a @ tree.vector.T
    for k, (i, j, _) in enumerate(tree.bounds):
        assert j - i <= 20 and (s[:, i:j] <= high[:, k][:, None]).all() and (s[:, i:j] >= low[:, k][:, None]).all()


def test_far_leaves_are_not_visited(monkeypatch):
    """Two far clusters: a search in one of them leaves the other alone."""
    r = np.random.default_rng(5)
    v = np.concatenate([r.integers(0, 20, (512, 8)) + 2000, r.integers(0, 20, (512, 8)) - 2000])
    tree = hard_negatives.tree_of(v, np.arange(1024), np.arange(1024), np.zeros(1024, dtype=np.int64))
    seen, visit = [], hard_negatives._visit
    monkeypatch.setattr(hard_negatives, "_visit", lambda t, s, which, i, j: (seen.append((i, j)), visit(t, s, which, i, j)))
    k = 5
    s = hard_negatives.Search(v[:1], np.array([0]), np.array([0]), np.array([0]), np.array([-(1 << 60)]), np.array([1 << 60]), True, np.full((1, k), hard_negatives._NONE), np.full((1, k), 1 << 60))
    hard_negatives.searched(tree, s)
    assert all(tree.row[i] < 512 for i, _ in seen)
    want = sorted(((-int(v[0] @ x), i) for i, x in enumerate(v) if i), key=lambda t: t)[:k]
    assert [(-a, b) for a, b in zip(s.score[0], s.id[0], strict=True)] == want


@pytest.mark.parametrize("positive", [-101, -1, 0, 1, 3, 10, 99, 100, 10**15])
def test_windows(positive):
    low, high = -((-30 * positive) // 100), 90 * positive // 100
    for score in {low - 1, low, high, high + 1, 0}:
        assert (low <= score <= high) == (30 * positive <= 100 * score <= 90 * positive)
