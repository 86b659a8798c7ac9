import random

from ripplegraph.llm import decontamination
from tests.llm.conftest import prose


def test_exact_substituted_and_clean(spark):
    r = random.Random(2)
    items = [(i, prose(r, n, 3000)) for i, n in enumerate((6, 9, 18, 30, 55, 55))] + [(90, "too short"), (91, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = []

    def put(middle):
        rows.append((len(rows), f"{prose(r, 80, 3000)} {middle}. {prose(r, 120, 3000)}"))

    for _, t in items[:6]:
        put(t.upper().replace(" ", ",\n"))
    for _, t in items[3:6]:
        w = t.split()
        for k in range(4, len(w), 7):
            w[k] = "other"
        put(" ".join(w))
    w = items[4][1].split()
    put(" ".join([*w[:20], "added", *w[20:]]))
    for _ in range(40):
        put("too short")
    rows.append((len(rows), "Too, SHORT!"))
    got = {x["doc_id"]: x for x in decontamination.decontaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert [got[i]["items"] for i in range(6)] == ["0", "1", "2", "3", "4", "5"] and all(got[i]["best"] == 1.0 for i in range(6))
    assert [got[i]["items"] for i in range(6, 10)] == ["3", "4", "5", "4"]
    assert not any(got[i]["contaminated"] for i in range(10, len(rows) - 1))
    # An item of a word or two is leaked where it is the whole document.
    assert got[len(rows) - 1]["items"] == "90"


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    r = random.Random(4)
    bench = spark.createDataFrame([(i, prose(r, 25)) for i in range(20)], "item_id bigint, text string")
    docs = spark.createDataFrame([(x["item_id"], f"{prose(r, 30)} {x['text']}") for x in bench.collect()], "doc_id bigint, text string")
    one = sorted(decontamination.decontaminated(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_KEYS", 100)
    assert sorted(decontamination.decontaminated(docs, bench).collect()) == one


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the same text twice, row by row"), (2, None)], "item_id bigint, text string")
    got = decontamination.decontaminated(odd, bench).collect()
    assert len(got) == odd.count() and {r["doc_id"] for r in got if r["contaminated"]} == {6}
    clean = decontamination.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2
    assert decontamination.decontaminated(none, bench).collect() == []
    assert not any(r["contaminated"] for r in decontamination.decontaminated(odd, bench.limit(0)).collect())


def leaked(words, item):
    """The rule on the best single offset, plainly."""
    best = max((sum(0 <= o + j < len(words) and words[o + j] == w for j, w in enumerate(item)) for o in range(-len(item), len(words))), default=0)
    return best >= min(decontamination.ENOUGH, max(decontamination.LEAST_WORDS, -(-len(item) * 3 // 5)))


def test_substituted_items_of_all_lengths_against_the_rule(spark):
    """Every item with as many words replaced at random as the rule allows, and with one more."""
    r = random.Random(12)
    items = [(i, " ".join(f"v{r.randrange(5000)}" for _ in range(n))) for i, n in enumerate(list(range(5, 21)) * 4)]
    rows = []
    for i, text in items:
        w = text.split()
        most = len(w) - min(decontamination.ENOUGH, max(decontamination.LEAST_WORDS, -(-len(w) * 3 // 5)))
        for out in (most, most + 1):
            kept = list(w)
            for k in r.sample(range(len(w)), out):
                kept[k] = "zz"
            rows.append((len(rows), " ".join(["before", *kept, "after"])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {x["doc_id"]: x["contaminated"] for x in decontamination.decontaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    want = {i: any(leaked(t.split(), items[i // 2][1].split()) for t in [t]) for i, t in rows}
    assert not any(got[i] for i, yes in want.items() if not yes)
    missed = [i for i, yes in want.items() if yes and not got[i]]
    assert len(missed) <= 0.06 * sum(want.values())
    assert not [i for i in missed if len(items[i // 2][1].split()) < 10]


def test_a_very_long_item(spark):
    r = random.Random(8)
    text = " ".join(f"x{r.randrange(10**6)}" for _ in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, " ".join(text.split()[5000:15_500])), (3, prose(r, 500))], "doc_id bigint, text string")
    got = {x["doc_id"]: x["best"] for x in decontamination.decontaminated(docs, spark.createDataFrame([(7, text)], "item_id bigint, text string")).collect()}
    assert got == {1: 1.0, 2: 0.525, 3: 0.0}
