import random

from pyspark.sql import functions as F

from ripplegraph.operators import lines


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def applied(before, after, found):
    """after, made of before and the hunks."""
    a, b, out, at = lines.split_lines(before), lines.split_lines(after), [], 0
    for old, n, new, m in found:
        first = old - 1 if n else old
        assert at <= first and (new - 1 if m else new) == len(out) + first - at and n + m > 0
        out += a[at:first] + b[new - 1 : new - 1 + m] * (m > 0)
        at = first + n
    return "".join(out + a[at:])


def text(r, n, kinds):
    return "".join(f"{r.randrange(kinds)}\n" for _ in range(n)) + r.choice(["", "end"])


def test_hunks_are_valid_and_least():
    r = random.Random(1)
    for _ in range(600):
        x, y = (text(r, r.randrange(0, 30), r.choice([2, 5, 40])) for _ in "ab")
        found = lines.hunks(x, y)
        assert applied(x, y, found) == y
        a, b = lines.split_lines(x), lines.split_lines(y)
        assert sum(h[1] for h in found) == len(a) - common(a, b) and sum(h[3] for h in found) == len(b) - common(a, b)
        assert lines.common_lines(a, b) == common(a, b)


def test_hunks_of_known_cases():
    assert lines.hunks("a\nb\nc\n", "a\nB\nc\n") == [(2, 1, 2, 1)]
    assert lines.hunks("a\nc\n", "a\nb\nc\n") == [(1, 0, 2, 1)]
    assert lines.hunks("a\nb\nc\n", "a\nc\n") == [(2, 1, 1, 0)]
    assert lines.hunks("", "a\n") == [(0, 0, 1, 1)] and lines.hunks("a\n", None) == [(1, 1, 0, 0)]
    assert lines.hunks("x\ny\n", "x\ny\n") == [] and lines.hunks("a\nb", "a\nb\n") == [(2, 1, 2, 1)]
    # A new function stands after the one before it, not across its end.
    assert lines.hunks("f {\n  a\n}\n", "f {\n  a\n}\ng {\n  b\n}\n") == [(3, 0, 4, 3)]
    assert lines.similarity("a\nb\n", "b\na\n") == 50 and lines.similarity("", None) == 100 and lines.similarity("a\n", "") == 0


def test_long_texts_are_cut_into_blocks():
    r = random.Random(2)
    x = [f"{r.randrange(700)}\n" for _ in range(3000)]
    y = [line for line in x if r.random() < 0.9]
    for _ in range(200):
        y.insert(r.randrange(len(y)), r.choice(x))
    found = lines.hunks("".join(x), "".join(y))
    assert applied("".join(x), "".join(y), found) == "".join(y)
    assert sum(h[1] for h in found) == len(x) - lines.common_lines(x, y)
    z = ["same\n"] * 2000 + ["other\n"] * 3
    assert lines.hunks("".join(z), "".join(z[:-3])) == [(2001, 3, 2000, 0)]
    assert lines.common_lines(["same\n"] * 500 + ["x\n"], ["x\n"] + ["same\n"] * 700) == 500


def test_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\n", "a\nc\n"), (None, None, ""), (3, "x", None), (3, "x", None)], "k bigint, b string, h string").withColumn("old_start", F.col("k"))
    assert sorted(map(tuple, lines.line_hunks(df, "k", "b", "h").collect())) == [(1, 2, 1, 2, 1), (3, 1, 1, 0, 0), (3, 1, 1, 0, 0)]
    assert {(r["k"], r["similarity"]) for r in lines.line_similarity(df, "k", "b", "h").collect()} == {(1, 50), (None, 100), (3, 0)}
    assert lines.line_hunks(df.limit(0), "k", "b", "h").count() == 0
