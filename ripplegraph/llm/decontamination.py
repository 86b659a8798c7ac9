"""Benchmark decontamination by spaced seeds. Built-in functions only.

Words are runs of letters and digits, lower case, known by a 64-bit hash. A mask marks which of its span's words
count; the hash of those words is a key. Keys of all windows of the documents meet the keys of the benchmark's windows. Around a hit the
item is laid over the document at the hit's offset, and the positions where both have the same word are collected: words
that were put in place of others cost only themselves. A hit whose window before it hits too, at the same offset, is passed over: it
would show nothing else. Overlaps at several offsets (words added or left out) add up.

Masks of four words find items of 15 words that keep nine, the least that counts as leaked, in 95 of 100 random substitutions, those that keep ten or
more in 99.9; items of fewer than SHORT_WORDS words are sought by masks of three words too, which miss one pattern in 210 of ten words and none of other lengths.

Cases: null and empty texts have no windows and are clean; an item of fewer than LEAST_WORDS words is leaked only where it is the whole document;
rows that repeat a doc_id, or have none, are judged one by one, by their texts; an empty benchmark leaves all clean; items without words match nothing;
repeated items each count; very long texts and items are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Four words of four, five and seven; three words of three and four, for short items.
MASKS, SHORT_MASKS = ("11101", "1010011", "1111"), ("111", "1101", "1011")
LEAST_WORDS, SHORT_WORDS = 5, 12
#: An item is leaked with this share of its words, or with so many of them.
SHARE, ENOUGH = 0.6, 13
#: Keys of the benchmark that are broadcast at once (a block: 24 bytes a key, and the words of its items, 8 bytes each); a larger benchmark takes several passes.
BLOCK_KEYS = 500_000
#: Windows of an item that stay in one block.
RUN = 1 << 16


def word_hashes(text: str) -> str:
    return f"transform(array_remove(split(lower(coalesce({text}, '')), r'[^\\p{{L}}\\p{{N}}]+'), ''), w -> xxhash64(w))"


def _keys(hashes: str, number: int, mask: str) -> str:
    picks = ", ".join(f"{hashes}[i + {k}]" for k, x in enumerate(mask) if x == "1")
    return f"CASE WHEN size({hashes}) >= {len(mask)} THEN transform(sequence(0, size({hashes}) - {len(mask)}), i -> xxhash64({number}, {picks})) ELSE cast(array() as array<bigint>) END"


def _windows(texts: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """texts with key, mask and win for every window: all masks' keys are one array, and a key's index tells its mask and window.

    An outer explode: an inner one would have the optimizer compute the keys a second time, in a filter on their number."""
    keys = "concat(" + ", ".join(_keys("hs", k, m) for k, m in enumerate(masks)) + ")"
    starts = [" + ".join(["0", *(f"greatest(0, size(hs) - {len(m) - 1})" for m in masks[:k])]) for k in range(len(masks))]
    pick = lambda values: "CASE " + " ".join(f"WHEN pos >= {starts[k]} THEN {values[k]}" for k in range(len(masks) - 1, 0, -1)) + f" ELSE {values[0]} END"
    rows = texts.select("*", F.posexplode_outer(F.expr(keys)).alias("pos", "key"))
    return rows.withColumn("mask", F.expr(pick([str(k) for k in range(len(masks))]))).withColumn("win", F.expr(pick([f"pos - ({x})" for x in starts]))).drop("pos")


def _follows(masks: tuple[str, ...]) -> str:
    """Whether the window before hits at the same offset."""
    same = lambda m: " AND ".join(f"get(hs, win - 1 + {p}) = get(words, at - 1 + {p})" for p, x in enumerate(m) if x == "1")
    return "coalesce(at > 0 AND win > 0 AND CASE mask " + " ".join(f"WHEN {k} THEN {same(m)}" for k, m in enumerate(masks)) + " END, false)"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), item_id, matched, words: the leaked items of each document."""
    items = benchmark.select("item_id", F.expr(word_hashes("text")).alias("words")).filter(F.size("words") > 0)
    size = F.size("words")
    n, short, tiny = items.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.when(size.between(LEAST_WORDS, SHORT_WORDS - 1), 1)), F.count(F.when(size < LEAST_WORDS, 1))).first()
    masks = MASKS + (SHORT_MASKS if short else ())
    blocks = max(1, -(-n * len(masks) // BLOCK_KEYS))
    texts = docs.select("doc_id", F.md5("text").alias("digest"), F.expr(word_hashes("text")).alias("hs"))
    windows = _windows(texts, masks)
    long = items.filter(size >= LEAST_WORDS)
    keys = _windows(long.withColumnRenamed("words", "hs"), masks).filter(F.col("key").isNotNull() & ((F.col("mask") < len(MASKS)) | (F.size("hs") < SHORT_WORDS)))
    keys = keys.select("key", F.col("item_id").alias("of"), F.col("win").alias("at"), F.pmod(F.xxhash64("item_id", F.expr(f"win div {RUN}")), F.lit(blocks)).alias("block"))
    found = None
    for b in range(blocks):
        part = keys.filter(F.col("block") == b).drop("block")
        here = long.join(F.broadcast(part.select(F.col("of").alias("item_id")).distinct()), "item_id", "left_semi").distinct() if blocks > 1 else long.distinct()
        hit = windows.join(F.broadcast(part), "key").join(F.broadcast(here), F.col("of").eqNullSafe(F.col("item_id"))).filter("NOT " + _follows(masks)).withColumn("offset", F.expr("win - at"))
        same = hit.select("doc_id", "digest", "item_id", F.size("words").alias("words"), F.expr("filter(sequence(0, size(words) - 1), j -> offset + j >= 0 AND offset + j < size(hs) AND hs[offset + j] = words[j])").alias("same"))
        found = same if found is None else found.unionByName(same)
    summed = found.groupBy("doc_id", "digest", "item_id").agg(F.max("words").alias("words"), F.size(F.array_distinct(F.flatten(F.collect_set("same")))).alias("matched"))
    leaked = summed.filter(F.col("matched") >= F.least(F.lit(ENOUGH), F.greatest(F.lit(LEAST_WORDS), F.ceil(F.col("words") * SHARE))))
    if tiny:
        whole = texts.filter(F.size("hs").between(1, LEAST_WORDS - 1)).join(F.broadcast(items.filter(size < LEAST_WORDS)), F.col("hs") == F.col("words"))
        leaked = leaked.unionByName(whole.select("doc_id", "digest", "item_id", size.alias("words"), size.alias("matched")).distinct())
    return leaked


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (their ids in order, comma-joined), best (the largest share of an item's words) for every row of docs."""
    leaks = overlaps(docs, benchmark).groupBy(F.col("doc_id").alias("id"), "digest").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("list"), F.max(F.round(F.col("matched") / F.col("words"), 4)).alias("most"))
    both = docs.select("doc_id", F.md5("text").alias("of")).join(leaks, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("of").eqNullSafe(F.col("digest")), "left")
    return both.select("doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("list", F.lit("")).alias("items"), F.coalesce("most", F.lit(0.0)).alias("best"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item."""
    leaks = overlaps(docs, benchmark).select(F.col("doc_id").alias("leaked_id"), "digest").distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leaked_id"]) & F.md5(docs["text"]).eqNullSafe(leaks["digest"]), "left_anti")
