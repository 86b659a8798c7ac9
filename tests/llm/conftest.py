import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(r: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank and long texts, repeated rows and ids, and columns with clashing names."""
    r = random.Random(3)
    long = prose(r, 20_000)
    rows = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (None, "a text without an id", "en", "a", 3),
        (3, " \t\n ", "de", "a", 3),
        (4, long, "en", "a", len(long)),
        (5, prose(r, 60), "en", "b", 5),
        (5, prose(r, 60), "en", "b", 5),
        (6, "the same text twice, row by row", "fr", None, 5),
        (6, "the same text twice, row by row", "fr", None, 5),
        (7, "ÀÉ ünï ☃ 𝕏 mixed", "de", "b", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "f", "g", "h", "w", "k", "value", "slot", "block", "shard", "arrival", "row", "gone_id", "leaked_id", "rejected_id", "name", "units", "base", "ll"):
        df = df.selectExpr("*", f"cast(doc_id as string) AS {name}")
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
