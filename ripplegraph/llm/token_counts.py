"""Token counts under a public vocabulary, by dynamic programming over a trie of distinct words.

A text's tokens are those of its words (runs of bytes other than 0x20 and 0x09-0x0D), each with the word mark in front. A word
is cut into the pieces of the greatest total score; bytes that no piece covers count as a token each. The best score of a prefix depends on
the prefix alone: the distinct new words of a slice form a trie, level by level, in which each node is scored once, and
the counts at the words' ends are kept for the task's later slices.

Scores: piece r of the vocabulary has -ln(r + 10), a single byte BYTE_SCORE; of equal scores the longer last piece wins.

Cases: null, empty and blank texts have 0 words and tokens; rows that repeat are counted each; texts are read whole and words
of any length are cut; extra columns are not read; an empty table gives an empty one."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplegraph.llm.words import U, slices, words

#: The setting that names the vocabulary's file on the driver, and what holds without it.
SETTING, VOCABULARY = "spark.ripplegraph.vocabulary", "/opt/tokenizers/piece_bpe_32k.model"
BYTE_SCORE = -20.0
MARK = "▁".encode()
#: Words whose counts a task keeps; cells of one table of prefixes.
MOST_KNOWN, MOST_CELLS = 2_000_000, 1 << 21
_BASE = U(0x9E3779B97F4A7C15)
_VALUE = np.random.default_rng(4242).integers(1, 1 << 63, 256, dtype=np.uint64)
_FILTER_BITS = 22


class Pieces(NamedTuple):
    hash: np.ndarray
    score: np.ndarray
    maybe: np.ndarray
    lengths: np.ndarray
    power: np.ndarray


def hash_of(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_BASE) + int(_VALUE[b])) & 0xFFFFFFFFFFFFFFFF
    return h


def pieces_of(scored: dict[bytes, float]) -> Pieces:
    keys = np.array([hash_of(p) for p in scored], dtype=np.uint64)
    order = np.argsort(keys)
    maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
    maybe[keys >> U(64 - _FILTER_BITS)] = True
    lengths = np.array(sorted({len(p) for p in scored}, reverse=True))
    power = np.ones(int(lengths.max(initial=1)) + 1, dtype=np.uint64)
    power[1:] = _BASE
    np.multiply.accumulate(power, out=power)
    return Pieces(keys[order], np.array(list(scored.values()))[order], maybe, lengths, power)


def load(path: str = VOCABULARY) -> dict[bytes, float]:
    """The vocabulary's pieces with their scores; its control, unknown and byte pieces are left out. Read on the driver, some MB."""
    import sentencepiece

    if not os.path.exists(path):
        raise FileNotFoundError(f"there is no vocabulary at {path}: give its path or set {SETTING}")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: -float(np.log(r + 10)) for r, p in enumerate(plain)}


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The number of tokens of each word data[start:end]; words that share a prefix share its score."""
    size = end - start + len(MARK)
    order = np.argsort(-size, kind="stable")
    out, i = np.zeros(len(start), dtype=np.int64), 0
    while i < len(order):
        width = int(size[order[i]])
        # Rows of a table are words of a like length.
        floor = np.searchsorted(-size[order], -(width // 2), side="left") if width > 32 else len(order)
        j = min(max(i + 1, int(floor)), i + max(1, MOST_CELLS // width))
        rows = order[i:j]
        out[rows] = _cut_table(data, start[rows], size[rows], width, pieces)
        i = j
    return out


def _cut_table(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, p: Pieces) -> np.ndarray:
    n = len(start)
    h, score, tokens = np.zeros((n, width + 1), dtype=np.uint64), np.zeros((n, width + 1)), np.zeros((n, width + 1), dtype=np.int32)
    for level in range(1, width + 1):
        live = int(np.searchsorted(-size, -level, side="right"))  # the words are in order of size, the longest first
        byte = np.full(live, MARK[level - 1], dtype=np.uint8) if level <= len(MARK) else data[start[:live] + level - 1 - len(MARK)]
        h[:live, level] = h[:live, level - 1] * _BASE + _VALUE[byte]
        _, node, back = np.unique(h[:live, level], return_index=True, return_inverse=True)
        best, count = score[node, level - 1] + BYTE_SCORE, tokens[node, level - 1] + 1
        for m in p.lengths[::-1]:
            if m > level:
                break
            key = h[node, level] - h[node, level - m] * p.power[m]
            some = np.flatnonzero(p.maybe[key >> U(64 - _FILTER_BITS)])
            if len(some):
                at = np.minimum(np.searchsorted(p.hash, key[some]), len(p.hash) - 1)
                some, at = some[hit := p.hash[at] == key[some]], at[hit]
                new = score[node[some], level - m] + p.score[at]
                some, new = some[better := new >= best[some]], new[better]
                best[some], count[some] = new, tokens[node[some], level - m] + 1
        score[:live, level], tokens[:live, level] = best[back], count[back]
    return tokens[np.arange(n), size]


class Known:
    """Counts of the words seen so far by their hash."""

    def __init__(self) -> None:
        self.hash, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def of(self, hashes: np.ndarray, counts_of) -> np.ndarray:
        """The counts of distinct, sorted hashes; counts_of(indices) makes those that are new."""
        at = np.searchsorted(self.hash, hashes)
        old = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.hash)
        old[inside] = self.hash[at[inside]] == hashes[inside]
        out = np.zeros(len(hashes), dtype=np.int64)
        out[old] = self.count[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            out[new] = counts_of(new)
            if len(self.hash) + len(new) > MOST_KNOWN:
                self.__init__()
                at = np.zeros(len(hashes), dtype=np.int64)
            self.hash, self.count = np.insert(self.hash, at[new], hashes[new]), np.insert(self.count, at[new], out[new])
        return out


def token_counts(docs: DataFrame, path: str | None = None, scored: dict[bytes, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every row."""
    path = path or docs.sparkSession.conf.get(SETTING, VOCABULARY)
    spec = docs.sparkSession.sparkContext.broadcast(pieces_of(load(path) if scored is None else scored))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            for part in slices(batch):
                w = words(part.column("text"), lower=False)
                distinct, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                counts = known.of(distinct, lambda new, w=w, first=first: cut(w.data, w.start[first[new]], w.end[first[new]], spec.value))
                total = np.zeros(len(back) + 1, dtype=np.int64)
                np.cumsum(counts[back], out=total[1:])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.first)), pa.array(np.diff(total[w.first]))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_tokens bigint")
