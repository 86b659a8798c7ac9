"""Conversation repair against a search over all edit sequences by cost and audit."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from ripplegraph.llm import conversations, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
CORE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = CORE.findall(text)
        out.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search: the first full way off the heap is the cheapest and then the ASCII-least."""
    kinds, grammar, heap, done = faults(rows), re.compile(r"(s?(ua)+)?"), [(0, "", 0, "", ())], set()

    def hopeful(letters):
        return any(grammar.fullmatch(letters + more) for more in ("", "u", "a", "ua"))

    while heap:
        cost, audit, i, letters, turns = heapq.heappop(heap)
        if i == len(rows) and grammar.fullmatch(letters):
            return cost, audit, turns
        state = (i, letters[-1:])
        if (state, audit) in done:
            continue
        done.add((state, audit))
        ways = [(3, "I", i, r, "") for r in ("user", "assistant")] if audit[-3:] != "III" else []
        if i < len(rows):
            _, role, text = rows[i]
            ways.append((4, "D", i + 1, None, None))
            if kinds[i] not in ("b", "d"):
                more = 3 * (kinds[i] == "t")
                ways += [(more, "K", i + 1, role, text), *((3 + more, "R", i + 1, r, text) for r in ("user", "assistant"))]
        for add, letter, to, role, text in ways:
            new = letters if role is None else letters + role[:1]
            if role is None or (role and hopeful(new)):
                heapq.heappush(heap, (cost + add, audit + letter, to, new, turns if role is None else (*turns, f"{role}:{text}")))
    raise AssertionError("the grammar allows an empty conversation")


def expected(convs):
    out = {}
    for conv_id, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        kinds, turns = faults(rows), [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, repaired = cheapest(rows) if rows else (0, "", ())
        out[conv_id] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def harmed(rows):
    """What the query does to rows before it repairs them."""
    out = {}
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv_id, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (kind != 0) + [(turn, role, text)] * (kind == 3)
    return out


def got(spark, df):
    audits = conversations.audited(df).cache()
    digests = {r["conv_id"]: r["repaired_sha256"] for r in conversations.digests(df, audits).collect()}
    found = {r["conv_id"]: (*r[1:], digests[r["conv_id"]]) for r in audits.collect()}
    audits.unpersist()
    return found


def dialogue(r, n):
    texts = ["fine.", "well", "", " \t", "so?", "a b!", "x  \n", "ünï."]
    return [(r.choice([None, *range(n + 2)]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", " "]), r.choice(texts) + r.choice(["", "", str(r.randrange(9)), "."])) for _ in range(n)]


def test_cheapest_edits_of_random_conversations(spark):
    r = random.Random(11)
    convs = {k: dialogue(r, r.randrange(1, 8)) for k in range(150)} | {None: dialogue(r, 5)}
    df = spark.createDataFrame([(k, *row) for k, rows in convs.items() for row in rows], SCHEMA)
    assert got(spark, df) == expected(convs)


def test_a_long_conversation_is_cut_into_stretches(spark, monkeypatch):
    r = random.Random(5)
    convs = {1: [(i, ["user", "assistant"][i % 2] if r.random() < 0.8 else "user", f"text {i}" + r.choice(["", ".", ".", "."])) for i in range(300)], 2: [(0, "user", "a."), (1, "assistant", "b.")]}
    convs[1] += [(None, "system", "first."), (7, "user", "again."), (8, "user", "again.")]
    df = spark.createDataFrame([(k, *row) for k, rows in convs.items() for row in rows], SCHEMA)
    whole = got(spark, df)
    monkeypatch.setattr(conversations, "STRETCH", 3)
    assert got(spark, df.repartition(3)) == whole
    # One table for all rows, without any cut.
    rows = sorted(convs[1], key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
    layer = conversations.started(conversations.NOTHING)
    for (_, role, _), fault in zip(rows, faults(rows), strict=True):
        layer = conversations.stepped(layer, role[:1], fault)
    assert whole[1][5:7] == min(layer[s] for s in conversations.ACCEPTING)


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "tool", "q."), (1, 2, "tool", "q."), (1, 3, "assistant", "a."), (1, 4, "assistant", None)], SCHEMA)
    rows = [tuple(r) for r in conversations.repaired(df).orderBy("place").collect()]
    assert rows == [(1, 0, "K", 0, "system", "s."), (1, 1, "R", 1, "user", "q."), (1, 2, "K", 3, "assistant", "a.")]
    only = spark.createDataFrame([(1, 0, "assistant", "a.")], SCHEMA)
    assert [r["edit"] for r in conversations.repaired(only).orderBy("place").collect()] == ["I", "K"]


def test_query_over_damaged_rows(spark, tmp_path):
    r = random.Random(2)
    rows = [(k if k != 39 else None, turn, r.choice(["user", "assistant", None]) if r.random() < 0.2 else ["user", "assistant"][turn % 2], r.choice(["a.", "b", None, f"t{turn}."])) for k in range(40) for turn in range(r.randrange(1, 6))]
    rows += [(50, None, "user", "a."), (51, 9 * 10**18, "user", "x."), (51, -5, "system", "y.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id AS audit", "role AS cost", "turn AS row", "text AS digest")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {x["conv_id"]: tuple(x)[1:] for x in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = expected(harmed(rows))
    assert set(found) == {x[0] for x in rows}
    assert {k: v for k, v in found.items() if k in want} == {k: v if harmed(rows)[k] else nothing for k, v in want.items()}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.audited(none).count() == 0 and conversations.repaired(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "\t\n\x0b\x0c\r"])
def test_blank_texts(spark, text):
    df = spark.createDataFrame([(1, 0, "user", text)], SCHEMA)
    assert tuple(conversations.audited(df).first()) == (1, 0, 1, 0, 0, 0, 4, "D")
