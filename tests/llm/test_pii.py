import hashlib
import re

from ripplegraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text: str) -> list[tuple[int, int, int, str]]:
    found = []
    for k, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end(), kind))
    return sorted(found)


TEXTS = [
    "mail bob.smith@mail.example.com or 10.0.0.1, card 4111 1111 1111 1111.",
    "a@b.c_d@e.f x..y@z--.q.  @no.com a@b a@b..c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 12.34.56.789",
    "+1 (988) 555-2485 and +49-89-1234567 +1 +12345678901234567890 +1((((",
    "4111-1111-1111-1112 4111-1111-1111-1111 1234567890123456789012345 49927398716 0000 0000 0000",
    "ünï ☃ 𝕏 bob@x.de ☃ 8.8.8.8 𝕏 5500 0000 0000 0004",
    "x" * 5000 + "@" + "y." * 3000 + "com",
    "7" * 30_000,
    " ".join(f"u{i}@h{i}.org 10.0.{i % 256}.7" for i in range(700)),
    "",
    "nothing here",
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    for r in pii.personal_data(df).collect():
        got = [(x["start"], x["k"], x["end"], x["kind"]) for x in r["base"]]
        assert got == brute(TEXTS[r["doc_id"]]), r["doc_id"]
        assert set(got) <= {(x["start"], x["k"], x["end"], x["kind"]) for x in r["spans"]}


def test_contexts_add_identifiers_and_leave_other_words_alone(spark):
    seeds = [(i, f"please write to user{i}@host{i}.org before noon") for i in range(12)]
    rows = [*seeds, (50, "please write to agent47-at-hq before noon"), (51, "item agent99 costs 5000 coins"), (52, "they met 12345 people in room 40404")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    added = [(x["start"], x["end"], x["kind"]) for x in got[50]["spans"]]
    assert added == [(16, 29, "email")] and rows[12][1][16:29] == "agent47-at-hq"
    assert not got[51]["spans"] and not got[52]["spans"]


def test_contexts_of_found_identifiers_find_more(spark):
    rows = [(i, f"please write to user{i}@host{i}.org before noon") for i in range(60)] + [(100 + i, f"please write to agent-0-{i} before noon") for i in range(9)]
    for hop in range(1, 6):  # Nine contexts, each with the nine identifiers of the hop before and a new one.
        for c in range(9):
            word = f"{'abcdef'[hop]}{'abcdefghi'[c]}"
            rows += [(1000 * hop + 10 * c + i, f"{word}x {word}y {x} {word}z end") for i, x in enumerate([*(f"agent-{hop - 1}-{k}" for k in range(9)), f"agent-{hop}-{c}"])]
    rows.append((9999, "nobody knows agent-9-9 here"))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not got.pop(9999) and all([x["kind"] for x in spans] == ["email"] for spans in got.values())


def test_odd_rows(odd, none):
    got = pii.personal_data(odd).collect()
    assert len(got) == odd.count() and all(r["base"] == [] for r in got)
    assert pii.personal_data(none).collect() == []


def test_query_digest(spark, tmp_path):
    from ripplegraph.llm.queries import op1_pii

    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op1_pii(spark, str(tmp_path)).collect():
        spans = brute(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[3] == k for s in spans) for k in pii.KINDS]
