import collections
import random
import re

from ripplegraph.llm import near_duplicates
from tests.llm.conftest import prose


def shingles(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^ \t\n\x0b\f\r]+", low)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width=4, percent=80):
    """Links by all pairs that share a shingle, components by merging."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            lists[x].append(k)
    for k, (i, s) in enumerate(sets):
        for j, m in collections.Counter(j for x in s for j in lists[x] if j < k).items():
            if 100 * m >= percent * (len(s) + len(sets[j][1]) - m):
                a, b = sorted((find(i), find(sets[j][0])))
                parent[b] = a
    return {i: find(i) for i in parent}


def made(seed=5):
    """Groups of copies with few and many edits, chains, a passage that many share, long texts, case and space changes."""
    r = random.Random(seed)
    passage, rows = prose(r, 60), []

    def put(text):
        rows.append((len(rows) * 3 + 1, text))

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        return " ".join(w)

    for size, edits in ((2, 1), (5, 2), (60, 3), (60, 5)):
        start = prose(r, r.randrange(90, 200))
        for _ in range(size):
            put(edited(start, r.randrange(edits + 1)))
    long = prose(r, 5000)
    for n in (0, 40, 200, 600):
        put(edited(long, n))
    chain = prose(r, 150)
    for _ in range(12):
        put(chain)
        chain = edited(chain, 3)
    for _ in range(40):
        put(prose(r, 70) + " " + passage)
    for t in ("one two", "ONE  two", "one two three", "", None, "x", "X"):
        put(t)
    exact = prose(r, 30)
    for _ in range(15):
        put(exact)
    put(exact.upper().replace(" ", "\n"))
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = made()
    want = brute(rows)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_other_widths_equal_brute_force(spark):
    rows = made(8)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 5, 85)


def test_odd_rows(odd, none):
    got = near_duplicates.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for i in (1, 2, 3) for r in by[i])
    assert {r["component_id"] for r in by[5]} == {5} and {r["component_id"] for r in by[6]} == {6}
    assert near_duplicates.near_duplicates(none).collect() == []
    assert near_duplicates.deduplicated(odd).columns == odd.columns


def test_exact_bounds_lose_no_link_and_the_sampled_ones_hardly_any(spark):
    """Pairs at and just above the threshold, where a sketch may fail."""
    r = random.Random(77)
    rows = []
    for k in range(60):
        text = prose(r, 100 + 13 * k, 10**6).split()
        other = list(text)
        # Each replaced word costs four shingles of a side; about as many as 80 percent allow.
        for j in r.sample(range(len(text)), max(1, len(text) // 36 + k % 3 - 1)):
            other[j] = f"z{r.randrange(10**6)}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    linked = sum(want[i] != i for i, _ in rows)
    assert 20 < linked < 60
    exact = {x["doc_id"]: x["component_id"] for x in near_duplicates.near_duplicates(df, bounds=near_duplicates.EXACT).collect()}
    assert exact == want
    sampled = {x["doc_id"]: x["component_id"] for x in near_duplicates.near_duplicates(df).collect()}
    assert sum(sampled[i] != want[i] for i in want) <= 1


def test_rows_of_one_id_go_by_their_own_texts(spark):
    r = random.Random(21)

    def near(text):
        words = text.split()
        words[3] = "other"
        return " ".join(words)

    a, b, c = (" ".join(f"{k}{r.randrange(500)}" for _ in range(80)) for k in "abc")
    rows = [(1, a), (5, near(a)), (5, b), (9, near(b)), (10, b + " more"), (7, c), (7, c), (11, near(c)), (None, a), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "doc_id AS gone_id", "text AS gone_digest")
    got = near_duplicates.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=repr) == sorted([(1, a), (5, b), (7, c), (7, c), (None, a), (5, None), (5, "")], key=repr)
