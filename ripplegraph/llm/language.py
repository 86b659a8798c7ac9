"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of the text's likelihood (hashed byte trigrams), the likelihoods of the declared
language and of the address suffix, and the host's prior. The last three come from grouped counts over the whole table,
in which each row stands for the language that its text alone makes likeliest; a host's prior is smoothed towards its domain's,
and that towards the table's.

Cases: null and empty texts and texts without letters are `und` and rejected; a null declared language, suffix or host adds no evidence;
equal posteriors go to the language first in the alphabet; rows that repeat a doc_id are judged one by one; an empty table, or one
without any declared language, makes every row `und`; texts are read whole; extra columns are not read. Every declared language is
told, however many there are (256 KB each to a task, LANGUAGES_AT_ONCE of them in one process)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.common import bounded_broadcast, written
from ripplegraph.llm.words import raw, slices

BUCKETS = 1 << 16
#: Distinct texts for each language that the likelihoods are fitted on, about; languages whose tables a process holds.
FIT_ROWS, LANGUAGES_AT_ONCE = 1000, 128
#: Trigrams overlap: each counts for this share of an independent one.
TEXT_WEIGHT = 0.3
#: Rows that a host's, a domain's and a table's prior are worth; false declarations, suffixes.
HOST_ROWS, DOMAIN_ROWS, TABLE_ROWS, OTHER_ROWS = 20.0, 50.0, 10.0, 5.0
#: Below this posterior a row is rejected.
SURE = 0.5
BROADCAST_HOSTS = 200_000


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the bytes i-2, i-1 and i for each i; A-Z as a-z, digits and signs other than letters as a space."""
    b = _FOLD[data].astype(np.uint32)
    h = b * np.uint32(0x9E3779B1)
    h[1:] += b[:-1] * np.uint32(0x85EBCA6B)
    h[2:] += b[:-2] * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of each bucket in each; rows: text, declared. Fitted on a bounded sample of declared rows.

    The sample is drawn by the text's hash, and of copies one stays: about FIT_ROWS distinct texts of each language, whatever is repeated."""
    n = rows.filter("declared is not null").groupBy("declared").agg(F.approx_count_distinct("text", 0.02).alias("n")).collect()
    if not n:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    languages = sorted(r["declared"] for r in n)
    share = F.create_map(*[x for r in n for x in (F.lit(r["declared"]), F.lit(FIT_ROWS / max(1, r["n"])))])
    h = F.xxhash64("text")
    sample = rows.filter(F.col("declared").isNotNull() & (F.pmod(h, F.lit(1 << 20)) < share[F.col("declared")] * (1 << 20)))
    sample = sample.groupBy("declared", h.alias("h")).agg(F.min("text").alias("text"))
    order = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = raw(part.column("text"))
                if not len(data):
                    continue
                grams, of = trigrams(data), np.repeat([order[x] for x in part.column("declared").to_pylist()], np.diff(at))
                cell, n = np.unique(of * BUCKETS + grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    got = sample.select("text", "declared").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(len(languages) * BUCKETS, dtype=np.float32)
    table[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float32)
    table = table.reshape(-1, BUCKETS) + np.float32(0.5)
    return languages, np.log(table / table.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)


def text_evidence(rows: DataFrame, log_p: np.ndarray) -> DataFrame:
    """rows without text, with ll (a language's log likelihood, in the order of log_p) and letters (bytes of letters)."""
    kept = [c for c in rows.columns if c != "text"]
    rows = rows.withColumn("ll", F.array().cast("array<double>")).withColumn("letters", F.lit(0).cast("bigint"))
    for k in range(0, len(log_p), LANGUAGES_AT_ONCE):
        rows = _evidence(rows, log_p[k : k + LANGUAGES_AT_ONCE])
    return rows.select(*kept, "ll", "letters")


def _evidence(rows: DataFrame, log_p: np.ndarray) -> DataFrame:
    """rows with the likelihoods of more languages after those in ll."""
    others = [c for c in rows.columns if c not in ("ll", "letters")]
    types = dict(rows.dtypes)
    spec = rows.sparkSession.sparkContext.broadcast(log_p)
    schema = ", ".join(f"`{c}` {types[c]}" for c in others) + ", ll array<double>, letters bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spec.value
        for batch in batches:
            for part in slices(batch):
                data, at = raw(part.column("text"))
                grams = trigrams(data)
                before = part.column("ll")
                sums = np.zeros((len(at) - 1, len(table)))
                for k, row in enumerate(table):
                    run_sum = np.zeros(len(data) + 1)
                    np.cumsum(row[grams], out=run_sum[1:])
                    sums[:, k] = TEXT_WEIGHT * (run_sum[at[1:]] - run_sum[at[:-1]])
                inside = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum(_FOLD[data] != 32, out=inside[1:])
                sums = np.concatenate([np.asarray(before.flatten(), dtype=float).reshape(len(sums), -1), sums], axis=1) if len(sums) else sums
                ll = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * np.int32(sums.shape[1])), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), ll, pa.array(inside[at[1:]] - inside[at[:-1]])], names=[*others, "ll", "letters"])

    return rows.select(*others, "ll", "letters").mapInArrow(run, schema)


def _counts(seen: DataFrame, by: list[str], k: int) -> DataFrame:
    """by and n: rows of each language, grouped by language first."""
    n = seen.groupBy(*by, "guess").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("guess", "c"))).alias("m"))
    return n.select(*by, F.expr(f"transform(sequence(0, {k - 1}), i -> coalesce(try_element_at(m, i), 0.0D))").alias("n"))


def _likelihood(seen: DataFrame, column: str, k: int) -> DataFrame:
    """column, its log likelihood under each language: grouped counts, smoothed."""
    known = seen.filter(F.col(column).isNotNull())
    total = _counts(known, [], k).select(F.col("n").alias("all"))
    return _counts(known, [column], k).crossJoin(F.broadcast(total)).select(column, F.zip_with("n", "all", lambda n, a: F.log((n + 1) / (a + OTHER_ROWS))).alias(f"{column}_ll"))


def _priors(seen: DataFrame, k: int) -> DataFrame:
    """host, its log prior: host counts smoothed by the domain's share, that by the table's."""
    named = seen.filter("host is not null")
    host = _counts(named, ["host"], k).withColumnRenamed("n", "h").join(named.groupBy("host").agg(F.min("domain").alias("domain")), "host")
    domain = _counts(named, ["domain"], k).withColumnRenamed("n", "d")
    table = _counts(named, [], k).withColumnRenamed("n", "t")

    def smoothed(n: str, over: str, rows: float) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, over, lambda x, p: (x + rows * p) / (total + rows))

    table = table.withColumn("even", F.array_repeat(F.lit(1.0 / k), k)).select(smoothed("t", "even", TABLE_ROWS).alias("tp"))
    domain = domain.crossJoin(F.broadcast(table)).select(F.col("domain").alias("of"), smoothed("d", "tp", DOMAIN_ROWS).alias("dp"))
    return host.join(domain, F.col("domain").eqNullSafe(F.col("of"))).select("host", F.transform(smoothed("h", "dp", HOST_ROWS), lambda x: F.log(x)).alias("host_ll"))


def identified(rows: DataFrame) -> DataFrame:
    """rows without text, with language, confidence and kept. rows: text, declared, suffix, host, domain (string, null: none) and what else is to be carried."""
    languages, log_p = fit(rows)
    k = len(languages)
    others = [c for c in rows.columns if c != "text"]
    if not k:
        return rows.select(*others, F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    seen = text_evidence(rows, log_p)
    seen = written(seen.withColumn("guess", F.when(F.col("letters") > 0, F.array_position("ll", F.array_max("ll")).cast("int") - 1)), "language")
    counted = seen.filter("guess is not null")
    none = F.array_repeat(F.lit(0.0), k)
    out = seen.join(bounded_broadcast(_likelihood(counted, "declared", k), BROADCAST_HOSTS), "declared", "left")
    out = out.join(bounded_broadcast(_likelihood(counted, "suffix", k), BROADCAST_HOSTS), "suffix", "left").join(bounded_broadcast(_priors(counted, k), BROADCAST_HOSTS), "host", "left")
    total = F.col("ll")
    for part in ("declared_ll", "suffix_ll", "host_ll"):
        total = F.zip_with(total, F.coalesce(part, none), lambda a, b: a + b)
    out = out.withColumn("lp", total).withColumn("top", F.array_max("lp"))
    out = out.withColumn("p", 1 / F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    known = (F.col("letters") > 0) & (F.col("p") >= SURE)
    name = F.element_at(F.array(*map(F.lit, languages)), F.array_position("lp", F.col("top")).cast("int"))
    return out.select(*others, F.when(known, name).otherwise("und").alias("language"), F.when(F.col("letters") > 0, F.round("p", 6)).otherwise(0.0).alias("confidence"), known.alias("kept"))


def document_rows(docs: DataFrame) -> DataFrame:
    """documents: the declared language is lang, the host is source, its domain the source's name without a number at its end. Where a source
    is an address, the suffix is its last label; other sources have none."""
    host = F.lower(F.col("source").cast("string"))
    suffix = F.nullif(F.regexp_extract(host, r"^(?:\w+://)?[^/?#:]*\.([a-z]{2,})(?:[/?#:]|$)", 1), F.lit(""))
    return docs.select("doc_id", "text", F.lower("lang").alias("declared"), suffix.alias("suffix"), host.alias("host"), F.regexp_replace(host, "[0-9]+$", "").alias("domain"))


def page_rows(pages: DataFrame) -> DataFrame:
    """pages: the declared language is the html element's lang, host and suffix are the address's, the domain its last two labels; the text is the visible one."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract("url", r"^\w+://([^/?#:]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", plain.alias("text"), blank(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?(\w+)", 1))).alias("declared"), blank(F.substring_index(host, ".", -1)).alias("suffix"), blank(host).alias("host"), blank(F.substring_index(host, ".", -2)).alias("domain"))


def accepted(docs: DataFrame) -> DataFrame:
    """docs (the columns they had) without those whose language stays unknown. A row goes by its own verdict: by its id and all that was judged."""
    rejected = identified(document_rows(docs).withColumn("digest", F.md5("text"))).filter("not kept").select(F.col("doc_id").alias("rejected_id"), "declared", "host", "digest").distinct()
    same = docs["doc_id"].eqNullSafe(rejected["rejected_id"]) & F.md5(docs["text"]).eqNullSafe(rejected["digest"])
    same &= F.lower(docs["lang"]).eqNullSafe(rejected["declared"]) & F.lower(docs["source"].cast("string")).eqNullSafe(rejected["host"])
    return docs.join(rejected, same, "left_anti")
