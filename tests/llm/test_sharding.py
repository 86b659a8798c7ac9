import random

import pytest

from ripplegraph.llm import sharding
from ripplegraph.llm.common import new_folder


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(sharding, "UNIT_BYTES", 1 << 10)


def texts(spark, n, start=0, parts=12):
    r = random.Random(n + start)
    rows = [(start + i, "".join(chr(97 + r.randrange(26)) for _ in range(r.randrange(200)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)


def stored(spark, store, version=None):
    return sorted(map(tuple, sharding.read(spark, store, version).select("row.*").collect()))


def test_round_trip_sizes_and_manifest(spark, small):
    docs = texts(spark, 3000, parts=16)
    store, version = sharding.sharded(docs, 60_000)
    assert version == 2 and stored(spark, store) == stored(spark, store, 1) == sorted(map(tuple, docs.collect()))
    live = sharding.manifest(spark, store).collect()
    assert sum(r["rows"] for r in live) == 3000 and sorted(r["shard"] for r in live) == list(range(len(live)))
    assert len(live) < 16 and max(r["bytes"] for r in live) < 70_000
    assert len({r["file"] for r in live}) == len(live)


def test_appends_and_compactions_in_any_sequence_with_crashes(spark, small, monkeypatch):
    r, store = random.Random(5), new_folder(spark, "store")
    want, version = [], 0
    real = sharding.commit

    def crash(*a):
        raise OSError("lost")

    for step in range(5):
        docs = texts(spark, 40 * (1 + step % 3), 1000 * step, parts=3)
        monkeypatch.setattr(sharding, "commit", crash)
        if step % 2:
            with pytest.raises(OSError):
                sharding.append(docs, store)
        monkeypatch.setattr(sharding, "commit", real)
        assert sharding.append(docs, store) == version + 1
        version += 1
        want += map(tuple, docs.collect())
        if r.random() < 0.6:
            monkeypatch.setattr(sharding, "commit", crash)
            try:
                sharding.compact(spark, store, 40_000, 3)
            except OSError:
                pass
            monkeypatch.setattr(sharding, "commit", real)
            version = sharding.compact(spark, store, 40_000, 3)
        assert sharding.versions(spark, store)[-1] == version and stored(spark, store) == sorted(want)
    assert sharding.vacuum(spark, store) and not sharding.vacuum(spark, store)
    assert stored(spark, store) == sorted(want) and sharding.read(spark, store, 1).count() == 40


def test_only_tiers_that_call_for_it_are_rewritten(spark, small):
    store = new_folder(spark, "store")
    sharding.append(texts(spark, 2000, parts=1), store)
    big = sharding.manifest(spark, store).first()["file"]
    assert sharding.compact(spark, store, 400_000) == 1  # one shard: nothing to do
    for k in range(4):
        sharding.append(texts(spark, 20, 10_000 * (k + 1), parts=1), store)
    assert sharding.compact(spark, store, 400_000) == 6
    live = sharding.manifest(spark, store).collect()
    assert len(live) == 2 and big in {r["file"] for r in live}


def test_a_file_far_over_the_target_is_split(spark, small):
    docs = texts(spark, 2000, parts=1)
    store, _ = sharding.sharded(docs, 30_000)
    live = sharding.manifest(spark, store).collect()
    assert len(live) > 3 and max(r["bytes"] for r in live) < 45_000 and stored(spark, store) == sorted(map(tuple, docs.collect()))
    one = spark.createDataFrame([(1, "".join(chr(97 + random.Random(1).randrange(26)) + str(i) for i in range(60_000)))], "doc_id bigint, text string")
    store, _ = sharding.sharded(one, 30_000)
    assert stored(spark, store) == sorted(map(tuple, one.collect()))


def test_shards_keep_the_order_of_the_files_that_are_read(spark, small, tmp_path):
    texts(spark, 3000).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/in")
    store, _ = sharding.sharded(spark.read.parquet(f"{tmp_path}/in"), 60_000)
    got = [(r["shard"], r["doc_id"]) for r in sharding.read(spark, store).select("shard", "row.doc_id").collect()]
    seen = {}
    for shard, doc in got:
        assert doc > seen.get(shard, -1)
        seen[shard] = doc
    assert sharding.read(spark, store).count() == 3000


def test_two_writers_of_a_version_one_fails(spark):
    store, version = sharding.sharded(texts(spark, 10))
    before = sorted(map(str, sharding.manifest(spark, store).collect()))
    with pytest.raises(RuntimeError):
        sharding.commit(spark, store, version, sharding.manifest(spark, store).drop("shard"))
    assert sharding.versions(spark, store)[-1] == version and sorted(map(str, sharding.manifest(spark, store).collect())) == before


def test_a_rename_into_another_writers_folder_is_undone(spark, monkeypatch):
    store, version = sharding.sharded(texts(spark, 10))
    real = sharding._fs

    class Blind:
        """A file system that does not see the other writer's manifest yet."""

        def __init__(self, fs):
            self.fs, self.first = fs, True

        def exists(self, at):
            first, self.first = self.first, False
            return False if first else self.fs.exists(at)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(sharding, "_fs", lambda s, p: (Blind(real(s, p)[0]), real(s, p)[1]))
    live = sharding.manifest(spark, store, version).drop("shard")
    with pytest.raises(RuntimeError):
        sharding.commit(spark, store, version, live)
    monkeypatch.setattr(sharding, "_fs", real)
    assert sharding.read(spark, store).count() == 10 and sharding.versions(spark, store)[-1] == version


def test_another_schema_is_refused(spark):
    store, _ = sharding.sharded(texts(spark, 10))
    with pytest.raises(ValueError):
        sharding.append(spark.range(3), store)


def test_odd_rows(spark, odd, none):
    store, _ = sharding.sharded(odd)
    assert sorted(map(str, sharding.read(spark, store).select("row.*").collect())) == sorted(map(str, odd.collect()))
    store, _ = sharding.sharded(none)
    assert sharding.read(spark, store).count() == 0 and sharding.manifest(spark, store).count() == 0
    assert sharding.append(odd, store) == 2 and sharding.read(spark, store).count() == odd.count()
