"""Lines of two versions of a text: the hunks in which they differ, and how alike they are.

A line is known with its end, so a last line without one differs from the same line with one. The alignment is a longest common subsequence: first the lines
that both begin with are paired, then those that both end with, then the rest from the top, a line with its like as soon as both stand at it; where they do not, an
added line is passed first if that loses nothing. So a block that could stand in several places stands as far down as it can.

The subsequence is found with the bits of one long number a row (a bit a line of the head), a few operations a row; every so many rows one
number is kept, from which the rows between are made again, so that n by m lines take the time of n * m / 64 and the memory of sqrt(n) * m / 8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

#: Places of a line that are put together anew for a row; a line with more has its bits kept.
FEW_PLACES = 256


def split_lines(text: str | None) -> list[str]:
    parts = (text or "").split("\n")
    return [p + "\n" for p in parts[:-1]] + parts[-1:] * bool(parts[-1])


def _bits(at: list[int], size: int) -> int:
    out = bytearray(size // 8 + 1)
    for k in at:
        out[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(out, "little")


class _Rows:
    """Rows of the table of common lengths of a and b: bit j is 0 where b's line j makes the length grow."""

    def __init__(self, a: list[str], b: list[str]) -> None:
        self.a, self.size, self.all = a, len(b), (1 << len(b)) - 1
        known = set(a)
        self.places: dict[str, list[int]] = {}
        for j, line in enumerate(b):
            if line in known:
                self.places.setdefault(line, []).append(j)
        self.kept = {line: _bits(at, self.size) for line, at in self.places.items() if len(at) > FEW_PLACES}

    def next(self, row: int, line: str) -> int:
        at = self.places.get(line)
        if at is None:
            return row
        hit = row & (self.kept.get(line) or _bits(at, self.size))
        return ((row + hit) | (row - hit)) & self.all


def _trimmed(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many lines both begin with, and of the rest end with."""
    most, head, tail = min(len(a), len(b)), 0, 0
    while head < most and a[head] == b[head]:
        head += 1
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def common_lines(a: list[str], b: list[str]) -> int:
    head, tail = _trimmed(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    rows = _Rows(a, b)
    row = rows.all
    for line in a:
        row = rows.next(row, line)
    return head + tail + len(b) - row.bit_count()


def similarity(before: str | None, after: str | None) -> int:
    """200 * common lines div all lines; two empty texts are alike (100)."""
    a, b = split_lines(before), split_lines(after)
    return 200 * common_lines(a, b) // (len(a) + len(b)) if a or b else 100


def hunks(before: str | None, after: str | None) -> list[tuple[int, int, int, int]]:
    """(old_start, old_len, new_start, new_len) of every difference, from 1; the start of a side without lines is the line after which it lies."""
    a, b = split_lines(before), split_lines(after)
    head, tail = _trimmed(a, b)
    n, m = len(a) - head - tail, len(b) - head - tail
    # From the end to the start, so that the way back through the table leads down the texts.
    own, other = a[head : head + n][::-1], b[head : head + m][::-1]
    table, every = _Rows(own, other), isqrt(n) + 1
    marks, row = [table.all], table.all
    for i, line in enumerate(own):
        row = table.next(row, line)
        if (i + 1) % every == 0:
            marks.append(row)
    out, i, j, block = [], n, m, (-1, [])
    start, gone, come = (head, head), 0, 0

    def close() -> None:
        if gone or come:
            out.append((start[0] + (gone > 0), gone, start[1] + (come > 0), come))

    while i or j:
        if i and j and own[i - 1] == other[j - 1]:
            close()
            i, j, gone, come = i - 1, j - 1, 0, 0
            start = (head + n - i, head + m - j)
            continue
        if i and j:
            if block[0] != i // every:
                # The rows from the mark at or before row i.
                made = [marks[i // every]]
                for line in own[i // every * every : min(n, (i // every + 1) * every)]:
                    made.append(table.next(made[-1], line))
                block = (i // every, made)
            passed = block[1][i % every] >> (j - 1) & 1
        else:
            passed = j > 0
        if passed:
            j, come = j - 1, come + 1
        else:
            i, gone = i - 1, gone + 1
    close()
    return out


def _by_batch(rows: DataFrame, key: str, found, schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more = [], []
            for k, x, y in zip(range(batch.num_rows), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for r in found(x, y):
                    keys.append(k)
                    more.append(r)
            columns = [pa.array(c, pa.int32()) for c in (zip(*more, strict=True) if more else [[]] * len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], names=[key, *names])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {schema}")


def line_hunks(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, old_start, old_len, new_start, new_len: the hunks between two text columns; null texts count as empty."""
    names = ["old_start", "old_len", "new_start", "new_len"]
    return _by_batch(rows.select(key, before, after), key, hunks, ", ".join(f"{n} int" for n in names), names)


def line_similarity(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, similarity of two text columns, with the order of lines."""
    return _by_batch(rows.select(key, before, after), key, lambda x, y: [(similarity(x, y),)], "similarity int", ["similarity"])


def common_of(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, common: how many lines two columns of lists of lines have in common, in their order."""
    return _by_batch(rows.select(key, before, after), key, lambda x, y: [(common_lines(x, y),)], "common int", ["common"])
