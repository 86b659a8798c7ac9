"""Documents packed into sequences of a fixed length, of like cost, without padding.

A document is the ids of its text under a public vocabulary and an end id. Its cost is estimated as LINEAR * n + QUADRATIC * n * n (attention stays
within a document). A task packs its documents in groups of about GROUP ids. A document's whole stretches of `capacity` ids are sequences of their own; what is
left goes, the dearest first, to the sequence of the lowest cost that has room for all of it; where none has, to the cheapest with any room,
cut at its end, and so on. A group has as many sequences as its ids fill; what finds no room starts the next group. The last group of a task also has sequences of
the powers of two that its last ids add up to (twelve at most), so that no sequence is padded. Nothing is shuffled and no task depends
on another.

Texts are cut at ASCII white space, where the vocabulary's own pattern cuts too; a word's ids are found once in a task's process and then looked up.

Cases: a null or empty text is the end id alone; a very long text is read in windows and cut into sequences; rows that repeat, or share
an id, or have none, are documents of their own; extra columns are not read; an empty table gives an empty one. sequence_id is the task's number
times 2^33 plus a count: a table that is dealt out otherwise is packed otherwise, so a result that is used twice should be written."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ripplegraph.llm.words import SLICE_BYTES, raw, slices, words

#: The setting that names the vocabulary's file on the driver.
SETTING = "spark.ripplegraph.tokenizer"
#: Ids of a sequence; the id that ends a document; ids that are packed together.
CAPACITY, END, GROUP = 4096, 2, 1 << 20
#: Cost of an id, and of an id looking at another: a sixth of the reciprocal width of a model of width 4,096.
LINEAR, QUADRATIC = 1.0, 1 / (6 * 4096)
#: Words whose ids a process keeps; words that are cut in one call; the token between them.
MOST_KNOWN, CALL, MARK = 2_000_000, 50, "<|startoftext|>"
STOPS = b".,;:!?"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Ids of words under a vocabulary; those of a word seen before are looked up by its hash."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.mark = self.tokenizer.token_to_id(MARK)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.at, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def encode(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and each word's number of ids."""
        alone = self.mark is None or any(MARK in w for w in many)
        step = 1 if alone else CALL
        calls = [MARK.join(many[i : i + step]) for i in range(0, len(many), step)]
        got = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)]
        if alone:
            return np.concatenate(got), np.array([len(g) for g in got], dtype=np.int64)
        flat = np.concatenate([x for g in got for x in (g, np.array([self.mark], dtype=np.uint32))])
        ends = np.flatnonzero(flat == self.mark)
        return flat[flat != self.mark], np.diff(ends, prepend=-1) - 1

    def of_words(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of distinct words are, and how many; the hashes are sorted."""
        place = np.searchsorted(self.hash, hashes)
        old = np.zeros(len(hashes), dtype=bool)
        inside = place < len(self.hash)
        old[inside] = self.hash[place[inside]] == hashes[inside]
        new = np.flatnonzero(~old)
        if len(new):
            if len(self.hash) and len(self.hash) + len(new) > MOST_KNOWN:
                self._forget()
                return self.of_words(hashes, data, start, end)
            ids, size = self.encode([data[start[i] : end[i]].tobytes().decode(errors="replace") for i in new.tolist()])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(size) - size
            self.used += len(ids)
            self.hash, self.at, self.size = np.insert(self.hash, place[new], hashes[new]), np.insert(self.at, place[new], at), np.insert(self.size, place[new], size)
            place = np.searchsorted(self.hash, hashes)
        return self.at[place], self.size[place]

    def of_texts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts in a row, and their bounds by text."""
        data, _ = raw(text)
        # Letters are made small only where no mark can join one: J with a caron has no single form, j with a caron has.
        w = words(text, lower=not bool(((data == 0xCC) | (data == 0xCD)).any()), stops=STOPS)
        distinct, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        at, size = self.of_words(distinct, w.data, w.start[first], w.end[first])
        at, size = at[back], size[back]
        bound = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=bound[1:])
        return self.pool[np.repeat(at - bound[:-1], size) + np.arange(bound[-1])], bound[w.first]


_known: dict[str, Ids] = {}


def known_ids(vocabulary: str) -> Ids:
    """One for each vocabulary and process: it serves all tasks that the process runs."""
    key = hashlib.md5(vocabulary.encode()).hexdigest()
    if key not in _known:
        _known[key] = Ids(vocabulary)
    return _known[key]


def windows(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts as they are, or one very long text in pieces that end before white space."""
    data, _ = raw(text)
    if len(text) != 1 or len(data) <= most:
        yield text
        return
    space = np.flatnonzero((data == 0x20) | (data - 9 < 5))
    i = 0
    while i < len(data):
        k = int(np.searchsorted(space, i + most))
        j = int(space[k]) if k < len(space) else len(data)
        yield pa.array([data[i:j].tobytes()], pa.large_binary())
        i = j


class Packer:
    """The sequences of one task, made group by group. A piece is (document, start, length)."""

    def __init__(self, capacity: int, linear: float, quadratic: float, first: int) -> None:
        self.capacity, self.linear, self.quadratic, self.next = capacity, linear, quadratic, first
        self.docs: list[tuple] = []  # (doc_id, ids)
        self.left: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.left.append((len(self.docs) - 1, 0, len(ids)))
        self.size += len(ids)

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def sequences(self, last: bool) -> list[tuple]:
        """Rows of the result; what found no room is left for the next group."""
        rows, tails = [], []
        for d, start, n in self.left:
            while n >= self.capacity:
                rows.append((d, start, self.capacity, self.next, 0))
                self.next, start, n = self.next + 1, start + self.capacity, n - self.capacity
            if n:
                tails.append((d, start, n))
        tails.sort(key=lambda x: (-x[2], x[0], x[1]))
        total = sum(n for _, _, n in tails)
        rooms = [self.capacity] * (total // self.capacity)
        if last:
            rest = total % self.capacity
            rooms += [1 << b for b in range(rest.bit_length()) if rest >> b & 1]
        room, filled, cost = np.array(rooms, dtype=np.int64), np.zeros(len(rooms), dtype=np.int64), np.zeros(len(rooms))
        self.left, free = [], int(room.sum())
        for d, start, n in tails:
            while n and free:
                fits = room >= n
                if not fits.any():
                    fits = room > 0
                s = int(np.where(fits, cost, np.inf).argmin())
                some = min(n, int(room[s]))
                rows.append((d, start, some, self.next + s, int(filled[s])))
                room[s], filled[s], cost[s] = room[s] - some, filled[s] + some, cost[s] + self.cost(some)
                start, n, free = start + some, n - some, free - some
            if n:
                self.left.append((d, start, n))
        self.next += len(rooms)
        out = [(self.docs[d][0], start, n, self.docs[d][1][start : start + n].tobytes(), len(self.docs[d][1]), s, at) for d, start, n, s, at in rows]
        kept = {d: k for k, d in enumerate(sorted({d for d, _, _ in self.left}))}
        self.docs, self.left = [self.docs[d] for d in kept], [(kept[d], start, n) for d, start, n in self.left]
        self.size = sum(n for _, _, n in self.left)
        return out


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, linear: float = LINEAR, quadratic: float = QUADRATIC, group: int = GROUP) -> DataFrame:
    """Pieces: doc_id, start (the document's ids before it), length, ids (unsigned 32-bit numbers, the lowest byte first), doc_tokens, sequence_id, offset.

    capacity: a power of two. path: the vocabulary's file on the driver; some MB are broadcast."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the length of a sequence is a power of two")
    with open(path or docs.sparkSession.conf.get(SETTING, None) or vocabulary_path(), encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, kind = known_ids(vocabulary.value), Packer(capacity, linear, quadratic, TaskContext.get().partitionId() << 33), None

        def table(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 10_000):
                columns = list(zip(*rows[i : i + 10_000], strict=True))
                types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in slices(batch):
                found = [ids.of_texts(window) for window in windows(part.column("text"))]
                if len(found) > 1:
                    found = [(np.concatenate([f for f, _ in found]), np.array([0, sum(len(f) for f, _ in found)]))]
                flat, bound = found[0]
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(doc_id, np.append(flat[bound[i] : bound[i + 1]], np.uint32(end)))
                    if packer.size >= group:
                        yield from table(packer.sequences(last=False))
        yield from table(packer.sequences(last=True))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
