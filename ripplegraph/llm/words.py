"""Words of whole text columns as numpy arrays, for use inside tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Words are known by a 64-bit
hash, taken for all words of a slice at once: no Python object is made for a word.

Cases: null counts as empty; texts without words have none; a text of any length is one slice at least, never cut; an empty column has no words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
SLICE_BYTES = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(2 * n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, U(base))
            p[0] = U(1)
            np.multiply.accumulate(p, out=p)
            _powers[k] = p
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """data: the slice's bytes, lower case if asked for; start, end, hash: by word; doc: a word's row in the slice; first: each row's first word, then the number of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; null counts as empty."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    if not len(text) or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(text) + 1, dtype=np.int64)
    return np.frombuffer(text.buffers()[2], dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(text: pa.Array, lower: bool = True, stops: bytes = b"") -> Words:
    """stops: bytes that are words of their own where they end a word after an ASCII letter or digit."""
    data, at = raw(text)
    data = _LOWER[data] if lower else data
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, none.astype(np.uint64), none, np.zeros(len(text) + 1, dtype=np.int64))
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if stops:
        long = np.flatnonzero(end - start > 1)
        before = data[end[long] - 2]
        plain = (before - 48 < 10) | ((before | 32) - 97 < 26)
        apart = end[long[plain & np.isin(data[end[long] - 1], np.frombuffer(stops, dtype=np.uint8))]] - 1
        start, end = np.sort(np.concatenate([start, apart])), np.sort(np.concatenate([end, apart]))
    power, inverse = _up_to(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    h = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(text)), np.diff(first))
    return Words(data, start, end, h, doc, first)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text (a longer row stands alone), so that arrays stay small."""
    size = np.asarray(pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0))
    bound, i = np.cumsum(size), 0
    while i < batch.num_rows:
        before = bound[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(bound, before + most, side="right")))
        yield batch.slice(i, j - i)
        i = j
