"""Pfair mixing against a plain simulation and against the target weights."""

import heapq
from collections import Counter

import pytest

from ripplegraph.llm import mixing


def plain_order(units, slots):
    """The earliest deadline first, block by block."""
    whole = sum(units)
    waiting = [(0, i) for i in range(len(units))]
    heapq.heapify(waiting)
    pool, done, out = [], [0] * len(units), []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(pool, (-(-(done[i] + 1) * whole // units[i]), i))
        i = heapq.heappop(pool)[1]
        done[i] += 1
        out.append(i)
        heapq.heappush(waiting, (done[i] * whole // units[i], i))
    return out


def docs(spark, counts):
    rows = [(1000 * k + i, name) for k, (name, n) in enumerate(counts.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string")


def groups_of(spark, units, n):
    return spark.createDataFrame([(f"s{i:04}", n, i + 1, u) for i, u in enumerate(units)], "name string, n bigint, g int, units bigint")


def picked(groups, block=1):
    return [r["g"] - 1 for r in mixing.schedule(groups, block).orderBy("slot").collect()]


@pytest.mark.parametrize("units", [[1], [3, 3, 1], [900, 90, 10], [5, 7, 11, 13, 400]])
def test_schedule_is_earliest_deadline_first(spark, units):
    got = picked(groups_of(spark, units, 60))
    assert got == plain_order(units, len(got))
    assert len(got) == min(sum(units), max(-(-60 * sum(units) // u) for u in units))


def test_two_thousand_sources_stay_within_a_block_of_their_targets(spark):
    units = [1 + (i * 7919) % 7 for i in range(2000)]
    whole = sum(units)
    got = picked(groups_of(spark, units, 1))
    assert len(got) == whole  # the smallest weight needs the whole round
    served = Counter()
    for t, i in enumerate(got, 1):
        served[i] += 1
        # A source's lag is greatest where it is served.
        assert -whole < served[i] * whole - units[i] * t < whole
    assert all(served[i] == u for i, u in enumerate(units))


def test_weights_are_met_as_given(spark):
    weights = spark.createDataFrame([("a", 0.9), ("b", 0.09), ("c", 0.01)], "source string, weight double")
    table = docs(spark, {"a": 1800, "b": 180, "c": 20})
    got = {r["name"]: r["units"] for r in mixing.source_groups(table, weights).collect()}
    assert got == {"a": 900_000, "b": 90_000, "c": 10_000}
    rows = mixing.mixed(table, weights, block=1).select("name", "slot").orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(2000))
    served = Counter()
    for t, r in enumerate(rows, 1):
        served[r["name"]] += 1
        for name, w in (("a", 0.9), ("b", 0.09), ("c", 0.01)):
            assert abs(served[name] - w * t) < 1


def test_a_small_source_of_many_keeps_its_weight(spark):
    counts = {f"s{i:03}": 30 for i in range(299)} | {"tiny": 10}
    weights = spark.createDataFrame([("tiny", 1000.0), *((f"s{i:03}", 1.0) for i in range(299))], "source string, weight double")
    units = {r["name"]: r["units"] for r in mixing.source_groups(docs(spark, counts), weights).collect()}
    assert units["tiny"] == round(1e6 * 1000 / 1299) and sum(units.values()) == 1_000_000


def test_no_source_is_left_without_a_unit(spark):
    weights = spark.createDataFrame([("a", 1e12), ("b", 0.0)], "source string, weight double")
    units = {r["name"]: r["units"] for r in mixing.source_groups(docs(spark, {"a": 3, "b": 3}), weights).collect()}
    assert units == {"a": 1_000_000, "b": 1}
    assert mixing.parts_of(10_000) == 1_000_000 and mixing.parts_of(10_001) == 10_000_000


def test_every_document_has_one_place(spark):
    table = docs(spark, {"a": 700, "b": 90, "c": 1})
    got = mixing.mixed(table).select("doc_id", "name", "block", "slot", "release", "due", "place").collect()
    assert len(got) == 791 and len({(r["slot"], r["place"]) for r in got}) == 791
    assert all(r["release"] <= r["slot"] < r["due"] for r in got)


def test_cases(spark, odd, none):
    got = mixing.mixed(odd.select("doc_id", "source"))
    assert got.count() == odd.count()
    assert mixing.mixed(none.select("doc_id", "source")).count() == 0
    assert sorted(mixing.in_mixed_order(odd).columns) == sorted(odd.columns)
    assert mixing.in_mixed_order(odd).exceptAll(odd).count() == 0
    assert mixing.in_mixed_order(none).count() == 0


def test_mixed_order_is_the_order_of_slots(spark):
    table = docs(spark, {"a": 900, "b": 300, "c": 60})
    place = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mixed(table).collect()}
    got = [place[r["doc_id"]] for r in mixing.in_mixed_order(table).collect()]
    assert got == sorted(got)
