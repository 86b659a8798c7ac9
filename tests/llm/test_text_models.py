import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ripplegraph.llm import html_text, language, language_model, token_counts
from tests.llm.conftest import prose


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^ \t\n\x0b\f\r]+", low), None]


def test_language_model_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "COMMON", 60)
    r = random.Random(6)
    texts = {i: prose(r, r.randrange(0, 80), 150 + 10 * (i % 90)) for i in range(300)}
    got = {x["doc_id"]: x for x in language_model.scored(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(t for i in texts if not held[i] for t in tokens(texts[i]))
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(tokens(t)), sum(x in c for x in tokens(t)), n)
        assert math.isclose(g["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), rel_tol=1e-9)


def test_language_model_probabilities_sum_to_one_and_learn_contexts(spark):
    r = random.Random(7)
    texts = []
    for i in range(400):
        w = ["start"]
        for _ in range(40):
            w.append(f"{w[-1][0]}{r.randrange(3)}" if r.random() < 0.8 else r.choice("abcdef") + "0")
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    own, hot = language_model.frequent(docs)
    vocab = language_model.vocabulary(language_model.counted(docs, own, hot))
    totals, n, known = language_model.train(vocab)
    table = language_model.model(vocab, totals, known).collect()
    weights = language_model.parent_weights(totals)
    unknown = np.array([(language_model.ROOT_STRENGTH + language_model.ROOT_DISCOUNT * t.root_tables) / (known + 1) / (language_model.ROOT_STRENGTH + t.root_customers) for t in totals[1 + language_model.BURN_IN :]])
    for k in np.flatnonzero(totals[0].customers)[:10]:
        total = float(weights[k] @ unknown)
        for row in table:
            d = dict(zip(row["contexts"], row["d"], strict=True)).get(int(k), 0.0)
            total += d + float(weights[k] @ np.array(row["p"]))
        assert math.isclose(total, 1.0, rel_tol=1e-6)
    got = language_model.scored(docs).collect()
    held = [x for x in got if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def test_language_model_odd_rows(odd, none):
    got = language_model.scored(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert len({(r["score"], r["base_score"]) for r in got if r["doc_id"] == 6}) == 1
    assert language_model.scored(none).collect() == []


def partitions_of(n):
    """The sizes of the blocks of every way to deal n customers to tables."""
    if not n:
        yield ()
        return
    for rest in partitions_of(n - 1):
        yield (*rest, 1)
        for k in range(len(rest)):
            yield (*rest[:k], rest[k] + 1, *rest[k + 1 :])


def test_seating_of_one_restaurant_follows_its_law():
    n, alpha, p, d = 6, 1.3, 0.2, 0.4
    weight = Counter()
    for sizes in partitions_of(n):
        w = math.prod(math.prod(j - d for j in range(1, s)) for s in sizes) * math.prod((alpha + d * i) * p for i in range(len(sizes)))
        weight[len(sizes)] += w
    many = 40_000
    w = language_model.mixed(np.arange(many, dtype=np.uint64))
    got = language_model.tables(np.full(many, n), np.full(many, alpha), np.full(many, p), d, w, np.zeros(many, dtype=np.int64), 1)
    for t, x in weight.items():
        assert abs((got == t).mean() - x / sum(weight.values())) < 0.01


def test_seating_of_many_customers_follows_the_restaurant():
    """With all of the parent's chance on one dish the law is that of the restaurant itself, seated one by one."""
    n, alpha, d = 500, 3.0, 0.6
    w = language_model.mixed(np.arange(3000, dtype=np.uint64))
    got = language_model.tables(np.full(3000, n), np.full(3000, alpha), np.ones(3000), d, w, np.zeros(3000, dtype=np.int64), 1)
    r = np.random.default_rng(0)
    t = np.ones(3000)
    for j in range(1, n):
        t += r.random(3000) < (alpha + d * t) / (alpha + j)
    assert abs(got.mean() - t.mean()) < 0.03 * t.mean() and abs(got.std() - t.std()) < 0.1 * t.std()


def test_binomial_quantiles():
    u = (np.arange(20_000) + 0.5) / 20_000
    for m, p in ((8, 0.3), (100, 0.02), (1000, 0.4), (5, 1.0), (7, 0.0)):
        got = language_model.binomial(np.full(len(u), m), np.full(len(u), p), u)
        assert abs(got.mean() - m * p) < 0.02 * m * p + 0.01 and abs(got.var() - m * p * (1 - p)) < 0.05 * m * p * (1 - p) + 0.01


def plain_model(train, sweeps=60, burn=20, seed=3):
    """The same hierarchy, seated customer by customer: a probability function of (word, context)."""
    r = random.Random(seed)
    d, a, d0, a0 = language_model.DISCOUNT, language_model.STRENGTH, language_model.ROOT_DISCOUNT, language_model.ROOT_STRENGTH
    events = [(c, w) for text in train for c, w in zip([None, *tokens(text)[:-1]], tokens(text), strict=True)]
    known = len({w for _, w in events})
    rooms = {None: {}}  # context or None for the parent: word: sizes of its tables

    def chance(room, w):
        sizes = rooms["ROOT"].get(w, []) if room == "ROOT" else rooms[room].get(w, [])
        n, t = totals[room]
        dd, aa, base = (d0, a0, 1 / (known + 1)) if room == "ROOT" else (d, a, chance("ROOT", w))
        return ((sum(sizes) - dd * len(sizes)) + (aa + dd * t) * base) / (aa + n)

    def seat(room, w):
        sizes = rooms[room].setdefault(w, [])
        dd, aa = (d0, a0) if room == "ROOT" else (d, a)
        new = (aa + dd * totals[room][1]) * (1 / (known + 1) if room == "ROOT" else chance("ROOT", w))
        weights = [s - dd for s in sizes] + [new]
        k = r.choices(range(len(weights)), weights)[0]
        totals[room][0] += 1
        if k < len(sizes):
            sizes[k] += 1
        else:
            sizes.append(1)
            totals[room][1] += 1
            if room != "ROOT":
                seat("ROOT", w)

    def leave(room, w):
        sizes = rooms[room][w]
        k = r.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        totals[room][0] -= 1
        if not sizes[k]:
            del sizes[k]
            totals[room][1] -= 1
            if room != "ROOT":
                leave("ROOT", w)

    rooms = {"ROOT": {}, **{("c", c): {} for c, _ in events}}
    totals = {k: [0, 0] for k in rooms}
    for c, w in events:
        seat(("c", c), w)
    probe, sums = {(c, w) for c, w in events}, Counter()
    for s in range(sweeps):
        for c, w in events:
            leave(("c", c), w)
            seat(("c", c), w)
        if s >= burn:
            for c, w in probe:
                sums[c, w] += chance(("c", c), w) / (sweeps - burn)
    return sums


def test_scores_are_those_of_a_plain_sampler(spark):
    r = random.Random(21)
    texts = {}
    for i in range(60):
        w = [r.choice("abcdefgh")]
        for _ in range(25):
            w.append(chr(97 + (ord(w[-1]) - 97 + r.choice([1, 1, 1, 2, 3])) % 8) if r.random() < 0.8 else r.choice("abcdefghxyz"))
        texts[i] = " ".join(w)
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    want = plain_model(train)
    got = {x["doc_id"]: x for x in language_model.scored(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    off = []
    for i, t in texts.items():
        pairs = list(zip([None, *tokens(t)[:-1]], tokens(t), strict=True))
        if all(p in want for p in pairs):
            plain = sum(math.log10(want[p]) for p in pairs)
            off.append(got[i]["score"] / plain - 1)
    assert len(off) > 50 and abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.08


def test_frequent_words_do_not_depend_on_the_partitions(spark):
    r = random.Random(5)
    rows = [(i, prose(r, 60, 40 if i < 100 else 5000)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one = language_model.frequent(docs.coalesce(1))
    many = language_model.frequent(docs.repartition(17))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(one, many, strict=True))


def best_cut(word: bytes, scored: dict[bytes, float]) -> int:
    """The plain forward recursion over one word, without a trie."""
    whole = token_counts.MARK + word
    score, count = [0.0], [0]
    for end in range(1, len(whole) + 1):
        best, n = score[end - 1] + token_counts.BYTE_SCORE, count[end - 1] + 1
        for start in range(end - 1, -1, -1):
            if whole[start:end] in scored and score[start] + scored[whole[start:end]] >= best:
                best, n = score[start] + scored[whole[start:end]], count[start] + 1
        score.append(best)
        count.append(n)
    return count[-1]


def test_token_counts_equal_brute_force(spark, odd, none):
    scored = {p.encode(): -float(i + 1) for i, p in enumerate(["▁", "a", "b", "ab", "▁ab", "aba", "c", "ü", "▁w", "1", "12", "w1", "▁the"])}
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcü☃w1") for _ in range(r.randrange(1, 70))) for _ in range(40)) for _ in range(30)] + ["a" * 3000, "", "the same the same", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in token_counts.token_counts(df, scored=scored).collect():
        w = [x.encode() for x in re.findall(r"[^ \t\n\x0b\f\r]+", texts[row["doc_id"]])]
        assert (row["n_words"], row["n_tokens"]) == (len(w), sum(best_cut(x, scored) for x in w))
    got = token_counts.token_counts(odd, scored=scored).collect()
    assert len(got) == odd.count() and all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert token_counts.token_counts(none, scored=scored).collect() == []
    with pytest.raises(FileNotFoundError):
        token_counts.token_counts(df, "/no/such/vocabulary")


def test_languages_held_out(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identified(language.document_rows(docs)).collect()
    assert np.mean([r["language"] == r["declared"] for r in got]) > 0.95 and all(r["kept"] for r in got)
    blind = language.identified(language.document_rows(docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN lang END AS lang", "source"))).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([r["language"] == truth[r["doc_id"]] for r in blind if r["doc_id"] % 2]) > 0.95
    kept = language.accepted(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in odd.collect()} - {r["doc_id"] for r in kept.collect()} == {1, 2, 3}
    assert language.accepted(none).collect() == []


def test_host_priors_decide_texts_that_say_little(spark):
    rows = [(i, "alpha beta gamma delta words words" if i % 2 else "eins zwei drei vier sieben", "xx" if i % 2 else "yy", "h1" if i % 2 else "h2") for i in range(60)] + [(100, "q", None, "h1"), (101, "q", None, "h2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r["language"] for r in language.identified(language.document_rows(df)).collect()}
    assert (got[100], got[101]) == ("xx", "yy")


def test_all_names_and_words_of_a_block_are_read():
    page = "<div class='a b c d e f g h sidebar'><p>" + "word " * 60 + "%s</p></div>"
    (block,) = html_text.blocks(page % "last")
    path, text = block.path, block.text
    assert "sidebar" in path and text.endswith("last")
    one, other = (html_text.vectors(html_text.blocks(page % w)) for w in ("last", "cookie"))
    words = slice(html_text.PATH_SIZE, html_text.PATH_SIZE + html_text.WORD_SIZE)
    assert (one[:, words] != other[:, words]).any() and html_text.weak_label(("article", *path)) == 0


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html

    for r, source in ((r, s) for r in html_text.main_text(pages).collect() for s in [{x["page_id"]: x["html"] for x in pages.collect()}]):
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S).group(1).replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_main_text_of_odd_pages(spark):
    model = html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    rows = [
        (1, None, None),
        (2, "u", ""),
        (3, "u", "<html><body><nav><a href=x>home</a></nav></body></html>"),
        (4, "u", "<body><article><p>One &amp; <b>two</b>\n three<script>bad('<p>')</script><p>four</article><aside class='sidebar'>five</aside><div class=comments><p>six</p></div>"),
        (5, "u", "<article><p>unclosed <!-- gone"),
        (5, "u", "<article><p>unclosed <!-- gone"),
        (6, "u", "<article>" + "<p>word word</p>" * 3000 + "</article>"),
    ]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), model).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == ""
    assert by[4] == "One & two three\nfour" and by[5] == "unclosed" and by[6] == "\n".join(["word word"] * 3000)
    assert html_text.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_languages_in_several_processes_and_copies_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    many = docs.selectExpr("doc_id", "text", "concat(lang, '-', doc_id % 2) AS lang", "source")
    verdict = lambda df: sorted((r["doc_id"], r["language"], round(r["confidence"], 4)) for r in language.identified(language.document_rows(df)).collect())
    one = verdict(many)
    assert len({x[1] for x in one}) > 5
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 3)
    assert verdict(many) == one
    # A language whose rows are mostly copies of one text is still told by its other texts.
    copies = spark.range(1000, 3000).selectExpr("id AS doc_id", "'uno y el mismo texto' AS text", "'es' AS lang", "'s' AS source")
    monkeypatch.setattr(language, "FIT_ROWS", 60)
    got = language.identified(language.document_rows(docs.select("doc_id", "text", "lang", "source").union(copies))).collect()
    assert np.mean([r["language"] == r["declared"] for r in got if r["doc_id"] < 1000]) > 0.9
    languages, table = language.fit(language.document_rows(docs.select("doc_id", "text", "lang", "source").union(copies)))
    assert languages == ["de", "en", "es", "fr"] and np.allclose(np.exp(table.astype(float)).sum(axis=1), 1, atol=1e-3)


def test_pages_use_markup_suffix_and_domain(spark):
    texts = {"xx": "alpha beta gamma delta words words {}", "yy": "eins zwei drei vier sieben acht {}"}
    rows = []
    for i in range(120):
        k = "xx" if i % 2 else "yy"
        rows.append((i, f"http://h{i % 6}.site{i % 2}.{k}/p{i}", f"<html lang='{k}'><script>zwei zwei zwei</script><p>{texts[k].format(i)}</p></html>"))
    rows += [(200, "http://h9.site1.com/", "<p>q</p>"), (201, "http://h8.site0.com/", "<p>q</p>"), (202, "http://new.org/", "<html lang=xx><p>q</p>"), (203, "http://other.yy/", "<p>q</p>"), (204, None, None), (205, "no address", "<p></p>")]
    got = {r["page_id"]: r for r in language.identified(language.page_rows(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()}
    assert all(got[i]["language"] == ("xx" if i % 2 else "yy") for i in range(120))
    assert (got[202]["language"], got[203]["language"]) == ("xx", "yy")
    assert got[204]["language"] == got[205]["language"] == "und" and not got[204]["kept"]
    assert (got[3]["suffix"], got[3]["host"], got[3]["domain"], got[3]["declared"]) == ("xx", "h3.site1.xx", "site1.xx", "xx")


def test_priors_are_smoothed_from_host_to_domain_to_table(spark):
    """The grouped counts of a host with one row, against the formula."""
    rows = [("a1", "a", 0)] * 30 + [("a2", "a", 1)] + [("b1", "b", 1)] * 9
    got = {r["host"]: np.exp(r["host_ll"]) for r in language._priors(spark.createDataFrame(rows, "host string, domain string, guess int"), 2).collect()}
    t = (np.array([30, 10]) + language.TABLE_ROWS / 2) / (40 + language.TABLE_ROWS)
    d = (np.array([30, 1]) + language.DOMAIN_ROWS * t) / (31 + language.DOMAIN_ROWS)
    assert np.allclose(got["a2"], (np.array([0, 1]) + language.HOST_ROWS * d) / (1 + language.HOST_ROWS))


def test_deep_and_unclosed_pages_take_linear_time():
    import time

    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        page = html_text.blocks("<div>x" * n + "</span>" * n)
        assert len(page) == n and len(html_text.vectors(page)) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)
    assert html_text.blocks("<p>" + "<b>" * 3 + "one</b>")[0].path == ("p",)


def test_text_of_all_elements_counts():
    page = "<article><p>E = <math><mi>m</mi><mo>c</mo></math> it</p><noscript>plain</noscript><object>fallback</object><canvas>drawn</canvas><svg><text>axis</text></svg><script>no()</script></article>"
    assert [b.text for b in html_text.blocks(page)] == ["E = mc it", "plain", "fallback", "drawn", "axis"]


def test_an_article_without_semantic_elements(spark):
    model = html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    body = "".join(f"<p>{prose(random.Random(k), 40)}, and so on. {prose(random.Random(k + 50), 30)}.</p>" for k in range(6))
    for kind in ("<table><tr><td>%s</td></tr></table>", "<div>%s</div>", "<div class='content'>%s</div>"):
        html = "<html><body><nav><a href=x>home</a><a href=y>news</a></nav>" + kind % body + "<footer>imprint</footer></body></html>"
        (got,) = html_text.main_text(spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string"), model).collect()
        assert got["text"].count("\n") == 5 and "home" not in got["text"] and "imprint" not in got["text"], kind
