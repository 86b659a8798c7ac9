"""Language-model scores of whole texts under a hierarchical Pitman-Yor model.

A word's context restaurant is that of the word before it: a frequent word has its own, all others share a number of them by hash. All
context restaurants share one parent, whose base measure is even. Chinese-restaurant seating is sampled by Gibbs sweeps:
a sweep takes all customers of a word out of a restaurant and seats them again, given the tables that all other words have there and the
parent's probability. The number of their tables is drawn from its exact law, by generalised Stirling numbers, for the first EXACT customers; those
beyond join by binomial draws. The words are independent within a sweep and Spark deals them out; between sweeps the totals, a number
for each restaurant, are summed. A word's probability is the mean of the sweeps' predictive probabilities after the first.

`scored` bounds the number of contexts; `scored_by_pairs`, which the query takes, is the exact way, in which every word is a context: it joins pairs of words in place of broadcasting contexts.

All counts come from every training text. Words that are common have their numbers broadcast (COMMON rows at most) and
are scored where the text is read; the rare ones meet the model in a join by word.

Cases: a null or empty text is its end alone; a null doc_id counts as the empty string and is held out; rows that repeat a doc_id are scored each;
a table without training texts gives every token the even chance of an unknown word; texts are read whole; extra columns are not read."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import bounded_broadcast, most_frequent, partitions, written
from ripplegraph.llm.words import U, mixed, slices, words

#: Words with a context of their own, at most; contexts shared by all other words.
OWN_CONTEXTS, SHARED_CONTEXTS = 256, 64
CONTEXTS = 1 + OWN_CONTEXTS + SHARED_CONTEXTS
#: Words with this share of the tokens are hot: their counts are summed by word and context.
HOT_SHARE = 1e-4
#: Words whose numbers are broadcast, the most frequent ones.
COMMON = 30_000
SWEEPS, BURN_IN = 4, 1
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 2.0, 0.5, 10.0
#: Customers of a word in a restaurant whose tables are drawn from their exact law.
EXACT = 64
END = np.uint64(0x656E64)
#: Words of a task that are combined before they are sent on; marked words that may be broadcast.
COMBINE, MARKED_ROWS = 2_000_000, 500_000


class Tokens(NamedTuple):
    token: np.ndarray
    context: np.ndarray
    at: np.ndarray


def tokens(text: pa.Array, own: np.ndarray) -> Tokens:
    """Each row's words and end with their contexts; at: where rows begin, then the number of tokens. own: sorted hashes."""
    w = words(text)
    rows = len(w.first) - 1
    kind = (1 + OWN_CONTEXTS + (w.hash % U(SHARED_CONTEXTS)).astype(np.int64)).astype(np.int64)
    if len(own):
        p = np.minimum(np.searchsorted(own, w.hash), len(own) - 1)
        kind = np.where(own[p] == w.hash, 1 + p, kind)
    token, kinds = np.empty(len(w.hash) + rows, dtype=np.uint64), np.zeros(len(w.hash) + rows, dtype=np.int64)
    place, ends = np.arange(len(w.hash)) + w.doc, w.first[1:] + np.arange(rows)
    token[place], token[ends], kinds[place] = w.hash, END, kind
    context = np.zeros_like(kinds)
    context[1:] = kinds[:-1]
    return Tokens(token, context, np.concatenate([[0], ends + 1]))


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the words with contexts of their own, and of the hot words, by exact counts.

    A word with the hot share of all tokens has half of it in some task. Tasks store all their counts and mark such words; only those that are marked are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0

        def sent() -> pa.RecordBatch:
            big = n >= max(1, total * HOT_SHARE / 2)
            return pa.RecordBatch.from_arrays([pa.array(np.append(key.view(np.int64), 0)), pa.array(np.append(n, 0)), pa.array(np.append(big, False)), pa.array(np.append(np.zeros(len(n), dtype=np.int64), total))], names=["w", "n", "big", "total"])

        for batch in batches:
            for part in slices(batch):
                t = np.sort(tokens(part.column("text"), np.zeros(0, dtype=np.uint64)).token)
                total += len(t)
                first = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, dtype=np.int64)
                both = np.concatenate([key, t[first]])
                order = np.argsort(both)
                both, c = both[order], np.concatenate([n, np.diff(np.append(first, len(t)))])[order]
                first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else first
                key, n = both[first], np.add.reduceat(c, first) if len(first) else c
                if len(key) > COMBINE:
                    yield sent()
                    key, n, total = key[:0], n[:0], 0
        yield sent()

    got = written(rows.select("text").mapInArrow(run, "w bigint, n bigint, big boolean, total bigint"), "frequent")
    total = got.agg(F.sum("total")).first()[0] or 0
    # No more than 2 / HOT_SHARE words of a task can be marked, and 1 / HOT_SHARE words be hot.
    marked = bounded_broadcast(got.filter("big").select("w").distinct(), MARKED_ROWS)
    sums = got.join(marked, "w", "left_semi").groupBy("w").agg(F.sum("n").alias("n"))
    top = sums.filter(F.col("n") >= max(1, total * HOT_SHARE)).toPandas().sort_values(["n", "w"], ascending=[False, True])
    hashes = top["w"].to_numpy(dtype=np.int64).view(np.uint64)
    return np.sort(hashes[hashes != END][:OWN_CONTEXTS]), np.sort(hashes)


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def counted(rows: DataFrame, own: np.ndarray, hot: np.ndarray) -> DataFrame:
    """w, c, contexts, n, hot: the training counts of each word by context; a hot word has a row for each context."""
    spec = rows.sparkSession.sparkContext.broadcast((own, hot))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hot = spec.value
        held: list[tuple[np.ndarray, ...]] = []

        def combined() -> pa.RecordBatch:
            w, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
            key = mixed(w + ctx.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            w, ctx = w[order[first]], ctx[order[first]]
            held.clear()
            # One number for context and count; the sign marks a hot word.
            packed = (ctx << 40 | n) | np.where(_among(hot, w), np.int64(-1) << 62, 0)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(packed)], names=["w", "v"])

        for batch in batches:
            for part in slices(batch):
                t = tokens(part.column("text"), own)
                if len(t.token):
                    held.append((t.token, t.context))
                if sum(len(x[0]) for x in held) > COMBINE:
                    yield combined()
        if held:
            yield combined()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_w = rest_v = np.zeros(0, dtype=np.int64)

        def grouped(w: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            ctx, n, is_hot = v >> 40 & 0x3FF, v & ((1 << 40) - 1), v < 0
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w[1:] != w[:-1]) | (ctx[1:] != ctx[:-1])
            first = np.flatnonzero(new)
            n = np.add.reduceat(n, first) if len(first) else n
            w, ctx, is_hot = w[first], ctx[first], is_hot[first]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w[1:] != w[:-1]) | is_hot[1:]
            first = np.flatnonzero(new)
            at = pa.array(np.append(first, len(w)).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(np.add.reduceat(n, first) if len(first) else n), pa.ListArray.from_arrays(at, pa.array(ctx.astype(np.int16))), pa.ListArray.from_arrays(at, pa.array(n)), pa.array(is_hot[first])], names=["w", "c", "contexts", "n", "hot"])

        for batch in batches:
            w, v = np.concatenate([rest_w, np.asarray(batch.column(0))]), np.concatenate([rest_v, np.asarray(batch.column(1))])
            # The last word may go on in the next batch; a hot word's context may, too.
            cut = int(np.searchsorted(w, w[-1])) if len(w) and v[-1] >= 0 else int(np.flatnonzero((w != w[-1]) | (v >> 40 != v[-1] >> 40))[-1] + 1 if ((w != w[-1]) | (v >> 40 != v[-1] >> 40)).any() else 0) if len(w) else 0
            rest_w, rest_v = w[cut:], v[cut:]
            if cut:
                yield grouped(w[:cut], v[:cut])
        if len(rest_w):
            yield grouped(rest_w, rest_v)

    sent = rows.select("text").mapInArrow(count, "w bigint, v bigint")
    dealt = sent.repartition(partitions(rows.sparkSession), "w", F.when(F.col("v") < 0, F.shiftright("v", 40)).otherwise(0)).sortWithinPartitions("w", "v")
    return written(dealt.mapInArrow(gather, "w bigint, c bigint, contexts array<smallint>, n array<bigint>, hot boolean"), "counts")


def vocabulary(counts: DataFrame) -> DataFrame:
    """A row for each word; those of hot words, at most CONTEXTS for each, are put together."""
    hot = counts.filter("hot").groupBy("w").agg(F.sum("c").alias("c"), F.array_sort(F.collect_list(F.struct(F.col("contexts")[0].alias("k"), F.col("n")[0].alias("n")))).alias("x"))
    hot = hot.select("w", "c", F.transform("x", lambda x: x["k"]).alias("contexts"), F.transform("x", lambda x: x["n"]).alias("n"))
    return counts.filter("not hot").select("w", "c", "contexts", "n").unionByName(hot)


class Totals(NamedTuple):
    """customers and tables of each context, customers and tables of the parent."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float


def _uniform(w: np.ndarray, context: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) that depends on the word, the context and the step alone: a task that runs again seats alike."""
    return (mixed(w ^ mixed(context.astype(np.uint64) + U(step * 1024 + 7))) >> U(11)).astype(np.float64) * 2.0**-53


@functools.lru_cache
def stirling(discount: float) -> np.ndarray:
    """log S(n, t), generalised Stirling numbers of up to EXACT customers at t tables: S(n + 1, t) = S(n, t - 1) + (n - discount * t) S(n, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore"):
        for n in range(1, EXACT):
            shifted = np.concatenate([[-np.inf], out[n, :-1]])
            out[n + 1] = np.logaddexp(shifted, np.log(np.maximum(n - discount * t, 0)) + out[n])
    return out


def _normal(u: np.ndarray) -> np.ndarray:
    """The normal quantile, to about four digits."""
    low = np.minimum(u, 1 - u).clip(1e-300)
    r = np.sqrt(-2 * np.log(low))
    x = r - (2.515517 + 0.802853 * r + 0.010328 * r * r) / (1 + 1.432788 * r + 0.189269 * r * r + 0.001308 * r**3)
    return np.where(u < 0.5, -x, x)


def binomial(m: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The u-quantile of the number of successes among m: summed up for small means, else by the normal law."""
    mean = m * p
    out = np.rint(mean + _normal(u) * np.sqrt(mean * (1 - p)))
    few = np.flatnonzero((mean < 16) & (p < 1))
    if len(few):
        k, odds = np.zeros(len(few)), p[few] / (1 - p[few])
        term = (1 - p[few]) ** m[few]
        total = term.copy()
        for j in range(1, 80):
            more = u[few] > total
            if not more.any():
                break
            term = term * odds * (m[few] - j + 1) / j
            total += term
            k += more
        out[few] = k
    return np.clip(out, 0, m)


def tables(n: np.ndarray, alpha: np.ndarray, p: np.ndarray, discount: float, w: np.ndarray, context: np.ndarray, sweep: int) -> np.ndarray:
    """Tables that n customers of one dish take when all are seated again; alpha: strength and discount times the tables of all other dishes, p: the dish's chance in the parent.

    The law of t tables is S(n, t) times the product over i < t of (alpha + discount * i) * p."""
    out = np.minimum(n, 1).astype(np.float64)
    log_s, u = stirling(discount), _uniform(w, context, sweep * 4096)
    first = np.minimum(n, EXACT).astype(np.int64)
    order = np.argsort(first, kind="stable")
    # Restaurants of a like size are one matrix, its laws padded by impossible numbers of tables; a slice at a time, so that it stays small.
    widths = 1 << np.arange(1, EXACT.bit_length())
    bounds = np.searchsorted(first[order], np.append(1, widths), side="right")
    for width, a, b in zip(widths, bounds[:-1], bounds[1:], strict=True):
        for k in range(int(a), int(b), max(1, (1 << 18) // int(width))):
            at = order[k : min(int(b), k + max(1, (1 << 18) // int(width)))]
            log_p = np.cumsum(np.log((alpha[at, None] + discount * np.arange(width)) * p[at, None]), axis=1) + log_s[first[at], 1 : width + 1]
            law = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (law[:, :-1] < u[at, None] * law[:, -1:]).sum(axis=1)
    live, j, step = np.flatnonzero(n > EXACT), EXACT, 1
    while len(live):
        size = max(1, j // 12)
        take = np.minimum(size, n[live] - j)
        middle = out[live]
        for _ in range(2):  # the chance half way, with the tables that there will be
            new = (alpha[live] + discount * middle) * p[live]
            chance = new / (new + j + (take - 1) / 2 - discount * middle)
            middle = out[live] + take * chance / 2
        out[live] += binomial(take, chance, _uniform(w[live], context[live], sweep * 4096 + step))
        j, step = j + size, step + 1
        live = live[n[live] > j]
    return out


def seatings(w: np.ndarray, row: np.ndarray, context: np.ndarray, n: np.ndarray, totals: list[Totals], words_known: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sweep by sweep: tables of each (word, context), the parent's customers and tables of each word. totals: those before each sweep."""
    even = 1 / (words_known + 1)
    customers = np.bincount(row, minlength=len(w)).astype(np.float64)
    p = customers / max(1.0, totals[0].root_customers)
    none = np.full(len(w), 1023)
    # Before the first sweep every word has one table in each of its restaurants.
    seated, root = np.ones(len(row)), np.ones(len(w))
    for s, before in enumerate(totals, 1):
        seated = tables(n, STRENGTH + DISCOUNT * np.maximum(0, before.tables[context] - seated), p[row], DISCOUNT, w[row], context, s)
        customers = np.bincount(row, weights=seated, minlength=len(w))
        root = tables(customers, ROOT_STRENGTH + ROOT_DISCOUNT * np.maximum(0, before.root_tables - root), np.full(len(w), even), ROOT_DISCOUNT, w, none, s)
        yield seated, customers, root
        p = (customers - ROOT_DISCOUNT * root) / (ROOT_STRENGTH + before.root_customers) + (ROOT_STRENGTH + ROOT_DISCOUNT * before.root_tables) / (ROOT_STRENGTH + before.root_customers) * even


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("contexts")
    at = np.asarray(lists.offsets)
    n = batch.column("n")
    m = np.asarray(n.offsets)
    return np.asarray(batch.column("w")).view(np.uint64), np.repeat(np.arange(len(lists)), np.diff(at)), np.asarray(lists.values)[at[0] : at[-1]].astype(np.int64), np.asarray(n.values)[m[0] : m[-1]], at - at[0]


def _summed(vocab: DataFrame, make) -> np.ndarray:
    """The sum over all batches of make(batch)'s array of 2 * CONTEXTS + 2 numbers."""
    size = 2 * CONTEXTS + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "x"])

    got = vocab.mapInArrow(run, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["k"]] = r["x"]
    return out


def train(vocab: DataFrame) -> tuple[list[Totals], int, int]:
    """The totals before the first sweep and after each, the number of training tokens, and that of their words."""

    def first(batch: pa.RecordBatch) -> np.ndarray:
        w, row, context, n, _ = _entries(batch)
        return np.concatenate([np.bincount(context, weights=n, minlength=CONTEXTS), np.bincount(context, minlength=CONTEXTS), [len(row), len(w)]])

    start = _summed(vocab, first)
    known = int(start[-1])
    # A word that occurs once takes one table in its context and one in the parent whatever is sampled: such words are counted, not swept.
    once = _summed(vocab.filter("c = 1"), first)
    totals = [Totals(start[:CONTEXTS], start[CONTEXTS:-2], start[-2], start[-1])]
    for _ in range(SWEEPS):
        before = list(totals)

        def sweep(batch: pa.RecordBatch, before=before) -> np.ndarray:
            w, row, context, n, _ = _entries(batch)
            *_, (seated, customers, root) = seatings(w, row, context, n, before, known)
            return np.concatenate([np.zeros(CONTEXTS), np.bincount(context, weights=seated, minlength=CONTEXTS), [customers.sum(), root.sum()]])

        got = _summed(vocab.filter("c > 1"), sweep)
        totals.append(Totals(start[:CONTEXTS], got[CONTEXTS:-2] + once[CONTEXTS:-2], got[-2] + once[-2], got[-1] + once[-1]))
    return totals, int(start[:CONTEXTS].sum()), known


def model(vocab: DataFrame, totals: list[Totals], known: int) -> DataFrame:
    """w, c, p (the parent's probability after each kept sweep), contexts, d (the context's own part, averaged)."""
    spec = vocab.sparkSession.sparkContext.broadcast(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = spec.value
        for batch in batches:
            if not batch.num_rows:
                continue
            w, row, context, n, at = _entries(batch)
            p, d = np.zeros((len(w), SWEEPS - BURN_IN)), np.zeros(len(row))
            for s, (seated, customers, root) in enumerate(seatings(w, row, context, n, totals[:-1], known), 1):
                if s > BURN_IN:
                    t = totals[s]
                    p[:, s - 1 - BURN_IN] = ((customers - ROOT_DISCOUNT * root) + (ROOT_STRENGTH + ROOT_DISCOUNT * t.root_tables) / (known + 1)) / (ROOT_STRENGTH + t.root_customers)
                    d += (n - DISCOUNT * seated) / (STRENGTH + t.customers[context]) / (SWEEPS - BURN_IN)
            steps = pa.array(np.arange(len(w) + 1, dtype=np.int32) * (SWEEPS - BURN_IN))
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("c"), pa.ListArray.from_arrays(steps, pa.array(p.ravel())), batch.column("contexts"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(d))], names=["w", "c", "p", "contexts", "d"])

    return vocab.mapInArrow(run, "w bigint, c bigint, p array<double>, contexts array<smallint>, d array<double>")


def parent_weights(totals: list[Totals]) -> np.ndarray:
    """By context and kept sweep: what the parent's probability counts for, over the number of kept sweeps."""
    return np.stack([(STRENGTH + DISCOUNT * t.tables) / (STRENGTH + t.customers) for t in totals[1 + BURN_IN :]], axis=1) / (SWEEPS - BURN_IN)


class Finder:
    """The index of a hash among sorted ones, -1 without: most have a slot of their own, those that share one are searched."""

    BITS = 20

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, place = keys, np.arange(len(keys))
        slot = keys.view(np.uint64) >> U(64 - self.BITS)
        self.table = np.full(1 << self.BITS, -1, dtype=np.int32)
        self.table[slot[::-1]] = place[::-1]
        self.rest = place[self.table[slot] != place]

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = self.table[wanted.view(np.uint64) >> U(64 - self.BITS)].astype(np.int64)
        wrong = np.flatnonzero((at >= 0) & (self.keys[at] != wanted))
        at[wrong] = -1
        if len(wrong) and len(self.rest):
            k = np.minimum(np.searchsorted(self.keys[self.rest], wanted[wrong]), len(self.rest) - 1)
            same = self.keys[self.rest[k]] == wanted[wrong]
            at[wrong[same]] = self.rest[k[same]]
        return at


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    training = rows.filter(~held)
    own, hot = frequent(training)
    vocab = vocabulary(counted(training, own, hot))
    totals, n, known = train(vocab)
    table = model(vocab, totals, known)
    weights = parent_weights(totals)
    unknown = np.array([(ROOT_STRENGTH + ROOT_DISCOUNT * t.root_tables) / (known + 1) / (ROOT_STRENGTH + t.root_customers) for t in totals[1 + BURN_IN :]])
    common_words = most_frequent(vocab.select("w", "c"), "c", COMMON)
    top = table.join(F.broadcast(common_words.select("w")), "w", "left_semi").toArrow().combine_chunks().sort_by("w").combine_chunks()
    # COMMON rows of CONTEXTS numbers at most: a place for every word and context is found without a search.
    inner = np.zeros((top.num_rows, CONTEXTS), dtype=np.float32)
    if top.num_rows:
        c = top.column("contexts").chunk(0)
        inner[np.repeat(np.arange(top.num_rows), np.diff(np.asarray(c.offsets))), np.asarray(c.flatten()).astype(np.int64)] = np.asarray(top.column("d").chunk(0).flatten())
        common = np.asarray(top.column("w").chunk(0)), np.asarray(top.column("c").chunk(0)), np.asarray(top.column("p").chunk(0).flatten()).reshape(top.num_rows, -1), inner
    else:
        common = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, SWEEPS - BURN_IN)), inner
    spec = spark.sparkContext.broadcast((own, common, weights))
    floor = n + 0.1 * (known + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (word, count, p, inner), weights = spec.value
        find = Finder(word)
        for batch in batches:
            for part in slices(batch):
                t = tokens(part.column("text"), own)
                token = t.token.view(np.int64)
                at = find(token)
                hit = at >= 0
                i, context = at[hit], t.context[hit]
                base, score = np.zeros(len(token)), np.zeros(len(token))
                base[hit] = np.log10((count[i] + 0.1) / floor)
                if len(i):
                    score[hit] = np.log10(inner[i, context] + (weights[context] * p[i]).sum(axis=1))
                sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (base, score, hit.astype(np.float64))]
                b, s, k = (x[t.at[1:]] - x[t.at[:-1]] for x in sums)
                rare = np.flatnonzero(~hit)
                rare_at = pa.array(np.searchsorted(rare, t.at).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("h"), pa.array(np.diff(t.at)), pa.array(k.astype(np.int64)), pa.array(b), pa.array(s), pa.ListArray.from_arrays(rare_at, pa.array(token[rare])), pa.ListArray.from_arrays(rare_at, pa.array(t.context[rare].astype(np.int16)))],
                    names=["doc_id", "held_out", "h", "n_tokens", "common", "base", "score", "w", "k"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    seen = written(rows.withColumn("h", F.xxhash64("text")).mapInArrow(read, f"doc_id {kind}, held_out boolean, h bigint, n_tokens bigint, common bigint, base double, score double, w array<bigint>, k array<smallint>"), "scored")
    rare = seen.select("doc_id", "h", F.size("w").alias("rare"), F.explode(F.arrays_zip("w", "k")).alias("x")).select("doc_id", "h", "rare", F.col("x.w").alias("w"), F.col("x.k").alias("k"))
    by_context = F.array(*(F.array(*map(F.lit, map(float, r))) for r in weights))
    joined = rare.join(table, "w", "left")
    own_part = F.coalesce(F.expr("try_element_at(d, nullif(cast(array_position(contexts, k) as int), 0))"), F.lit(0.0))
    parent = F.aggregate(F.zip_with(F.coalesce("p", F.array(*map(F.lit, map(float, unknown)))), F.get(by_context, F.col("k")), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    joined = joined.select("doc_id", "h", "rare", F.when(F.col("c").isNotNull(), 1).otherwise(0).alias("known"), F.log10((F.coalesce("c", F.lit(0)) + 0.1) / floor).alias("b"), F.log10(own_part + parent).alias("s"))
    # Rows that repeat give their tokens as often: the sums are divided by how often.
    many = F.col("m") / F.col("rare")
    sums = joined.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("g")).agg(F.count(F.lit(1)).alias("m"), F.max("rare").alias("rare"), F.sum("known").alias("rare_known"), F.sum("b").alias("rare_base"), F.sum("s").alias("rare_score"))
    sums = sums.select("id", "g", (F.col("rare_known") / many).cast("bigint").alias("rare_known"), (F.col("rare_base") / many).alias("rare_base"), (F.col("rare_score") / many).alias("rare_score"))
    out = seen.drop("w", "k").join(sums, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))


def _following(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's word before it and its own, and where rows begin. What stands before a text's first word is the end of another."""
    t = tokens(text, np.zeros(0, dtype=np.uint64))
    return np.append(END, t.token)[: len(t.token)], t.token, t.at


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash by which a pair of words is known."""
    return mixed(w + u * U(0x9E3779B97F4A7C15))


def paired(rows: DataFrame) -> DataFrame:
    """u, w, n: every pair of words (w after u) of the texts, and how often the training texts have it (0: never)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def combined() -> pa.RecordBatch:
            u, w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            key = _pair(u, w)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            at = order[first]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(np.add.reduceat(n[order], first))], names=["u", "w", "n"])

        for batch in batches:
            for part in slices(batch):
                u, w, at = _following(part.column("text"))
                if len(w):
                    held.append((u, w, np.repeat(~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), dtype=bool), np.diff(at)).astype(np.int64)))
                if sum(len(x[0]) for x in held) > COMBINE:
                    yield combined()
        if held:
            yield combined()

    return written(rows.select("text", "held_out").mapInArrow(count, "u bigint, w bigint, n bigint").groupBy("u", "w").agg(F.sum("n").alias("n")), "pairs")


#: Pairs whose numbers are broadcast, the most frequent ones; words, and contexts, whose numbers are; words, or contexts, that a sweep may broadcast.
COMMON_PAIRS, COMMON_WORDS, JOINED = 1_000_000, 300_000, 1_000_000


def scored_by_pairs(docs: DataFrame) -> DataFrame:
    """The columns of `scored`, every word with a context restaurant of its own: none is shared, whatever the number of words.

    Counts have a row for each pair of words that the texts have. A pair that the training texts have once takes one table whatever is sampled, so only the others are swept,
    joined with the totals of their contexts and words. Common pairs are scored where the text is read; the others meet their numbers in a join by pair."""
    kind, kept = dict(docs.dtypes)["doc_id"], SWEEPS - BURN_IN
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select("doc_id", "text", held.alias("held_out"))

    def seated(df: DataFrame, n: str, alpha, p: str, discount: float, u: str, sweep: int, out: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                get = lambda c: np.asarray(batch.column(c))
                t = tables(get(n), get("alpha"), get(p), discount, get("w").view(np.uint64), get(u).view(np.uint64), sweep) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t)], names=[*batch.schema.names, out])

        df = df.withColumn("alpha", alpha)
        return df.mapInArrow(run, ", ".join(f"{c} {d}" for c, d in df.dtypes) + f", {out} double").drop("alpha")

    pairs = paired(rows)
    numbers = F.sum("n").alias("c"), F.sum((F.col("n") == 1).cast("bigint")).alias("ones"), F.count(F.lit(1)).alias("all")
    words_, contexts = (written(pairs.filter("n > 0").groupBy(k).agg(*numbers), name) for k, name in (("w", "words"), ("u", "contexts")))
    known, n, customers = (x or 0 for x in words_.agg(F.count(F.lit(1)), F.sum("c"), F.sum("all")).first())
    even, root, unknown = 1 / (known + 1), known, []
    # A word that occurs once has one customer and one table at the parent; a context without pairs that occur again keeps its tables.
    swept = written(pairs.filter("n > 1").select("u", "w", "n", F.lit(1).alias("t"), F.lit(0).alias("kept")), "swept")
    live = written(words_.filter("c > 1").select("w", "ones", F.col("all").cast("double").alias("customers"), F.lit(1.0).alias("root"), F.array().cast("array<double>").alias("p")), "live")
    once = known - live.count()
    around = written(contexts.join(swept.select("u").distinct(), "u", "left_semi").select("u", "ones", F.col("all").alias("tu"), F.array().cast("array<bigint>").alias("kept")), "around")
    chance = F.col("customers") / max(1.0, customers)
    for s in range(1, SWEEPS + 1):
        both = swept.join(bounded_broadcast(around.select("u", "tu"), JOINED), "u").join(bounded_broadcast(live.select("w", chance.alias("chance")), JOINED), "w")
        after = seated(both, "n", STRENGTH + DISCOUNT * F.greatest(F.lit(0.0), F.col("tu") - F.col("t")), "chance", DISCOUNT, "u", s, "now")
        swept = written(after.select("u", "w", "n", F.col("now").cast("int").alias("t"), (F.col("kept") + F.col("now") if s > BURN_IN else F.col("kept")).cast("int").alias("kept")), "swept")
        own = live.join(swept.groupBy("w").agg(F.sum("t").alias("more")), "w", "left").withColumn("customers", (F.col("ones") + F.coalesce("more", F.lit(0))).cast("double"))
        own = own.drop("more").withColumn("even", F.lit(even)).withColumn("none", F.lit(1023).cast("bigint"))
        own = seated(own, "customers", ROOT_STRENGTH + ROOT_DISCOUNT * F.greatest(F.lit(0.0), F.lit(float(root)) - F.col("root")), "even", ROOT_DISCOUNT, "none", s, "now")
        live = written(own.select("w", "ones", "customers", F.col("now").alias("root"), "p"), "live")
        chance = (F.col("customers") - ROOT_DISCOUNT * F.col("root")) / (ROOT_STRENGTH + customers) + (ROOT_STRENGTH + ROOT_DISCOUNT * root) / (ROOT_STRENGTH + customers) * even
        customers, root = (once + (x or 0) for x in live.agg(F.sum("customers"), F.sum("root")).first())
        around = around.drop("tu").join(swept.groupBy("u").agg(F.sum("t").alias("more")), "u").withColumn("tu", F.col("ones") + F.col("more")).drop("more")
        if s > BURN_IN:
            around = around.withColumn("kept", F.array_append("kept", F.col("tu")))
            unknown.append((ROOT_STRENGTH + ROOT_DISCOUNT * root) * even / (ROOT_STRENGTH + customers))
            live = live.withColumn("p", F.concat("p", F.array((F.col("customers") - ROOT_DISCOUNT * F.col("root")) / (ROOT_STRENGTH + customers) + unknown[-1])))
            single = [*(single if s > BURN_IN + 1 else []), (1 - ROOT_DISCOUNT) / (ROOT_STRENGTH + customers) + unknown[-1]]
        around = written(around, "around")
    lits = lambda x: F.array(*map(F.lit, map(float, x)))
    words_ = written(words_.join(live.select("w", "p"), "w", "left").select("w", "c", F.coalesce("p", lits(single)).alias("p")), "words")
    weights = F.transform(F.coalesce("kept", F.array_repeat("all", kept)), lambda t: (STRENGTH + DISCOUNT * t) / (STRENGTH + F.col("c")) / kept)
    contexts = written(contexts.join(around.select("u", "kept"), "u", "left").select("u", F.col("c").alias("cu"), weights.alias("weights")), "contexts")

    def valued(df: DataFrame) -> DataFrame:
        """k, c, s: a pair, how often its word occurs and the log10 probability of the word after the other; df: u, w, n, kept (the sum of its tables after the kept sweeps)."""

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = _pair(*(np.asarray(batch.column(c)).view(np.uint64) for c in ("u", "w")))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column("c"), batch.column("s")], names=["k", "c", "s"])

        # Most pairs are of common words alone, whose numbers are broadcast: only the others are shuffled.
        near = df.join(F.broadcast(most_frequent(words_, "c", COMMON_WORDS)), "w", "left").join(F.broadcast(most_frequent(contexts, "cu", COMMON_WORDS)), "u", "left")
        far = near.filter("c is null or cu is null").select(*df.columns).join(words_, "w", "left").join(contexts, "u", "left")
        x = near.filter("c is not null and cu is not null").unionByName(far)
        parent = F.aggregate(F.zip_with(F.coalesce("weights", lits([1 / kept] * kept)), F.coalesce("p", lits(unknown)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        inner = F.coalesce((F.col("n") - DISCOUNT * F.col("kept") / kept) / (STRENGTH + F.col("cu")), F.lit(0.0))
        return x.select("u", "w", F.coalesce("c", F.lit(0)).cast("bigint").alias("c"), F.log10(inner + parent).alias("s")).mapInArrow(keyed, "k bigint, c bigint, s double")

    top = valued(most_frequent(swept, "n", COMMON_PAIRS).drop("t")).toArrow().combine_chunks().sort_by("k")
    spec = docs.sparkSession.sparkContext.broadcast(tuple(np.asarray(top.column(c)) for c in ("k", "c", "s")))
    floor = n + 0.1 * (known + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c, s = spec.value
        find = Finder(k)
        for batch in batches:
            for part in slices(batch):
                u, w, at = _following(part.column("text"))
                k = _pair(u, w).view(np.int64)
                i = find(k)
                hit = i >= 0
                base, score = np.zeros(len(k)), np.zeros(len(k))
                base[hit], score[hit] = np.log10((c[i[hit]] + 0.1) / floor), s[i[hit]]
                sums = [x[at[1:]] - x[at[:-1]] for x in (np.concatenate([[0.0], np.cumsum(x)]) for x in (hit.astype(np.float64), base, score))]
                rare = np.flatnonzero(~hit)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, at).astype(np.int32)), pa.array(k[rare]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("h"), pa.array(np.diff(at)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), lists], names=["doc_id", "held_out", "h", "n_tokens", "common", "base", "score", "k"])

    # Rows of one doc_id and text have the same scores, and one key.
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), "text")
    seen = written(rows.withColumn("h", h).mapInArrow(read, f"doc_id {kind}, held_out boolean, h bigint, n_tokens bigint, common bigint, base double, score double, k array<bigint>"), "scored")
    found = valued(pairs.filter("n < 2").select("u", "w", "n", (F.col("n") * kept).cast("int").alias("kept")).unionByName(swept.drop("t")))
    joined = seen.select("h", F.size("k").alias("rare"), F.explode("k").alias("k")).join(found, "k")
    joined = joined.select("h", "rare", (F.col("c") > 0).cast("bigint").alias("known"), F.log10((F.col("c") + 0.1) / floor).alias("b"), "s")
    # Rows that repeat give their tokens as often: the sums are divided by how often.
    many = F.col("m") / F.col("rare")
    sums = joined.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max("rare").alias("rare"), *(F.sum(c).alias(f"rare_{c}") for c in ("known", "b", "s")))
    sums = sums.select("h", *((F.col(f"rare_{c}") / many).alias(f"rare_{c}") for c in ("known", "b", "s")))
    total = lambda own, rare: F.col(own) + F.coalesce(rare, F.lit(0.0))
    return seen.drop("k").join(sums, "h", "left").select("doc_id", "held_out", "n_tokens", F.round(total("common", "rare_known")).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), total("base", "rare_b").alias("base_score"), total("score", "rare_s").alias("score"))
