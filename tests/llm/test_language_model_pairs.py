import zlib

import pytest

from ripplegraph.llm import language_model


def test_every_word_is_a_context_in_the_exact_way(spark):
    # 600 words, each always followed by its own: more than have contexts of their own, so that shared ones tell less of what comes next.
    texts = [(i, " ".join(f"a{k} b{k}" for k in range(i % 12 * 25, i % 12 * 25 + 25))) for i in range(150)] + [(1000, None), (1001, ""), (1001, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    far, near = ([tuple(r) for r in f(docs).collect()] for f in (language_model.scored, language_model.scored_by_pairs))
    far.sort(key=lambda r: r[0]), near.sort(key=lambda r: r[0])
    assert len(near) == 153
    for x, y in zip(far, near, strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], abs=1e-6)
    out = [k for k, (i, t) in enumerate(texts) if t and zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(out) > 5 and sum(near[k][6] for k in out) > 0.85 * sum(far[k][6] for k in out)


def test_the_exact_way_without_training_texts(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = language_model.scored_by_pairs(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(3, 0, 0, 0.0)]


def test_the_query_makes_every_word_a_context(spark, tmp_path):
    from ripplegraph.llm import queries

    # As above: the word before tells the next one of 600, which contexts that many words share do not.
    texts = [(i, " ".join(f"a{k} b{k}" for k in range(i % 12 * 25, i % 12 * 25 + 25))) for i in range(150)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.queries()["op4_language_model"](spark, str(tmp_path)).collect()}
    far = {r["doc_id"]: r["score"] for r in language_model.scored(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    out = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(got) == 150 and sum(got[i] for i in out) > 0.85 * sum(far[i] for i in out)


def test_rare_pairs_and_words_score_as_common_ones(spark, monkeypatch):
    texts = [(i % 50 if i % 9 else None, " ".join(f"w{(i * k * k + k) % (7 + i % 40)}" for k in range(i % 23))) for i in range(120)] * 2 + [(None, None), (7, "w1 only-once")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = []
    for pairs, words, joined in ((1_000_000, 300_000, 1_000_000), (0, 0, 0), (40, 12, 5)):
        for name, value in (("COMMON_PAIRS", pairs), ("COMMON_WORDS", words), ("JOINED", joined)):
            monkeypatch.setattr(language_model, name, value)
        got.append(sorted((tuple(r) for r in language_model.scored_by_pairs(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5])))
    assert len(got[0]) == len(texts)
    for some in got[1:]:
        for x, y in zip(got[0], some, strict=True):
            assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], abs=1e-6)


def test_the_exact_way_on_odd_rows(odd, none):
    near, far = (sorted((tuple(r) for r in f(odd).collect()), key=str) for f in (language_model.scored_by_pairs, language_model.scored))
    key = lambda r: str(r[:5])
    for x, y in zip(sorted(near, key=key), sorted(far, key=key), strict=True):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], abs=1e-6)
    assert language_model.scored_by_pairs(none).collect() == []
