import random

import corpus_pipeline
from tests.llm.test_near_duplicates import brute, made


def test_stages_keep_their_columns_and_the_result_equals_brute_force(spark, tmp_path):
    r = random.Random(11)
    items = [(i, " ".join(f"b{r.randrange(900)}" for _ in range(25))) for i in range(4)]
    rows = [(i, t) for i, t in made()] + [(5000 + i, f"some words before {t} and after") for i, t in items] + [(9000, "1234 5678"), (9001, "...")]
    spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = [(i, t) for i, t in rows if any(c.isalpha() or ord(c) > 127 for c in t or "")]
    roots = brute(words, 5)
    want = sorted(i for i, t in words if roots[i] == i and not any(b in (t or "") for _, b in items))
    assert sorted(x["doc_id"] for x in docs.collect()) == want
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in last) == want
    # The shards hold the documents in the order that mixing gave them.
    order = [x["doc_id"] for x in docs.selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").orderBy("f", "i").collect()]
    place = {x["doc_id"]: (x["slot"], x["place"]) for x in corpus_pipeline.mixing.mixed(docs).collect()}
    assert [place[i] for i in order] == sorted(place.values())
    at = {i: k for k, i in enumerate(order)}
    for shard in {x["shard"] for x in last}:
        own = [at[x["doc_id"]] for x in last if x["shard"] == shard]
        assert own == sorted(own)
    assert sorted(x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_that_share_an_id_go_by_their_own_verdict(spark):
    rows = [(7, "a text of words that stays", "en", "a", 1), (7, "", "en", "a", 0), (None, "another text of words", "en", "a", 1), (None, None, "en", "a", 0), (None, "x1 x2 x3 x4 x5 x6 y1 y2 y3 y4 y5 y6 x7 x8 x9", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r["text"] for r in corpus_pipeline.language.accepted(docs).collect())
    assert kept == sorted(t for _, t, *_ in rows if t)
    item = "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12"
    halves = [(None, "x1 x2 x3 x4 x5 x6 and more words"), (None, "words x7 x8 x9 x10 x11 x12"), (8, f"before {item} after"), (8, "a clean row"), (None, f"so {item}")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in halves], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = corpus_pipeline.decontamination.clean(docs, bench)
    assert got.columns == docs.columns and sorted(r["text"] for r in got.collect()) == sorted(halves[i][1] for i in (0, 1, 3))
    assert sorted(r["contaminated"] for r in corpus_pipeline.decontamination.decontaminated(docs, bench).collect()) == [False, False, False, True, True]
