"""Packing: every id in exactly one piece, no padding, like costs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ripplegraph.llm import packing, queries
from tests.llm.conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(rows, texts, plain, capacity):
    """texts: (doc_id, text) of all rows; rows with one id and one text cannot be told apart and are checked by their number."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r["length"] == len(r["ids"]) // 4
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append(plain(text))
    assert set(by_doc) == set(want)
    for doc_id, pieces in by_doc.items():
        whole = want[doc_id]
        assert sum(p["length"] for p in pieces) == sum(map(len, whole))
        if all(x == whole[0] for x in whole):
            ends, count = defaultdict(int), defaultdict(int)
            for p in pieces:
                assert p["doc_tokens"] == len(whole[0])
                assert np.frombuffer(p["ids"], dtype="<u4").tolist() == whole[0][p["start"] : p["start"] + p["length"]]
                count[p["start"]] += 1
                ends[p["start"] + p["length"]] += 1
            assert count[0] == ends[len(whole[0])] == len(whole)
            assert all(count[k] == ends[k] for k in (set(count) | set(ends)) - {0, len(whole[0])})
    return by_sequence


def test_odd_rows(spark, odd, none, plain):
    rows = packing.packed(odd).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], plain, packing.CAPACITY)
    assert packing.packed(none).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_random_documents_in_small_groups(spark, plain, partitions):
    r = random.Random(8)
    texts = [(i, prose(r, int(r.paretovariate(0.7) * 10) % 3000)) for i in range(150)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(partitions)
    check(packing.packed(df, capacity=256, group=5000).collect(), texts, plain, 256)


def test_ids_are_those_of_the_whole_text(plain):
    texts = ["It's we'll. THE the tHE, don't… 3.5% «x».", "J̌ ǰ W̊ é É ﬁ", "a<|endoftext|>b <|startoftext|> c", "<|ENDOFTEXT|>", "x y　z\x1cq", "日本語 한국어 ไทย", "a.b.c. ,; .,! word.", "\x00 \x0b", "'s 'S x's", "İstanbul ẞ"]
    import pyarrow as pa

    ids = packing.Ids(open(packing.vocabulary_path(), encoding="utf-8").read())
    for _ in range(2):  # once found, once looked up
        flat, bound = ids.of_texts(pa.array([*texts, None, ""]))
        for i, text in enumerate([*texts, "", ""]):
            assert flat[bound[i] : bound[i + 1]].tolist() == plain(text)[:-1], text


def test_a_long_text_is_read_in_windows(plain, monkeypatch):
    import pyarrow as pa

    text = prose(random.Random(1), 3000) + " " + "x" * 5000 + " end."
    parts = list(packing.windows(pa.array([text]), 1000))
    assert len(parts) > 5 and b"".join(p[0].as_py() for p in parts).decode() == text
    ids = packing.Ids(open(packing.vocabulary_path(), encoding="utf-8").read())
    assert [x for p in parts for x in ids.of_texts(p)[0].tolist()] == plain(text)[:-1]


def test_words_are_forgotten_and_found_again(plain, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "MOST_KNOWN", 50)
    ids, r = packing.Ids(open(packing.vocabulary_path(), encoding="utf-8").read()), random.Random(6)
    for _ in range(5):
        text = prose(r, 200)
        assert ids.of_texts(pa.array([text]))[0].tolist() == plain(text)[:-1]


def test_costs_are_balanced():
    r, capacity = random.Random(9), 4096
    packer = packing.Packer(capacity, packing.LINEAR, packing.QUADRATIC, 0)
    sizes = [int(min(1500, r.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)]
    for i, n in enumerate(sizes):
        packer.add(i, np.zeros(n, dtype=np.uint32))
    cost, cuts = defaultdict(float), 0
    for _, start, n, _, _, s, _ in packer.sequences(last=True):
        cost[s] += packer.cost(n)
        cuts += start > 0
    whole = [cost[s] for s in sorted(cost)[: sum(sizes) // capacity]]
    # The same documents, the longest first, each into the first sequence that has room for all of it.
    room, plain = [], []
    for n in sorted(sizes, reverse=True):
        k = next((k for k, free in enumerate(room) if free >= n), len(room))
        if k == len(room):
            room, plain = [*room, capacity], [*plain, 0.0]
        room[k], plain[k] = room[k] - n, plain[k] + packer.cost(n)
    assert np.std(whole) < 0.3 * np.std(plain[:-1]) and max(whole) < 1.02 * np.mean(whole)
    assert cuts < 2 * len(whole)
    assert sum(n for _, _, n in packer.left) == 0


def test_query(spark, tmp_path, odd):
    odd.selectExpr("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    pieces = {(r["doc_id"], r["start"], r["length"]): zlib.crc32(r["ids"]) for r in packing.packed(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    found = queries.op13_packing(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["start"], r["length"]): r["ids_crc32"] for r in found} == pieces
    assert SCHEMA.startswith("doc_id bigint")
    with pytest.raises(ValueError):
        packing.packed(odd, capacity=100)
