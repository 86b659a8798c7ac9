"""The stored index: tables of the last snapshot, kept by difference, and what was read from each file's content.

A version is a folder with the rows of every table that came, changed or went since the version before, and a list of the versions that make up each table: a whole one and
those that follow it. It is made under another name and becomes visible by one rename. A reader puts the parts together: of each key the last part that has it counts. When the parts
after the whole one are many, or have a share of its rows, the next version is a whole one again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import extraction
from ripplegraph.session import bounded_broadcast, written

KEYS = {"symbols": ["id"], "edges": ["f", "t", "kind"], "files": ["path"], "unresolved": ["id", "file", "line", "detail"]}
#: Parts after the whole one, and the share of its rows that they may have in all.
MOST_PARTS, MOST_SHARE = 8, 0.25
#: Keys of a part that a reader may broadcast.
BROADCAST_KEYS = 500_000
#: Which extractor read a file: facts of another are not used.
EXTRACTOR = "lines-2"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, store: str) -> list[int]:
    fs, path = _fs(spark, store)
    at = path(f"{store}/index")
    return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(at) if x.getPath().getName()[:1] == "v") if fs.exists(at) else []


def _parts(spark: SparkSession, store: str, version: int) -> dict[str, list[int]]:
    """Of each table of a version the versions that it is made of, the whole one first."""
    rows = spark.read.parquet(f"{store}/index/v{version}/_parts").collect()
    return {r["name"]: list(r["parts"]) for r in rows}


def load(spark: SparkSession, store: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the last one if none is given."""
    version = versions(spark, store)[-1] if version is None else version
    out = None
    for part in _parts(spark, store, version)[table]:
        rows = spark.read.parquet(f"{store}/index/v{part}/{table}")
        here = rows.filter("not _gone").drop("_gone")
        if out is not None:
            keys = rows.select([F.col(k).alias(f"_{k}") for k in KEYS[table]])
            on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS[table]]
            here = out.join(bounded_broadcast(keys, BROADCAST_KEYS), on, "left_anti").unionByName(here)
        out = here
    return out


def _difference(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The rows of after that before has not or has otherwise, and those of before that are gone, with _gone and _what."""
    rest = [c for c in after.columns if c not in key]
    side = lambda df, name: df.select(*(F.col(k).alias(f"{name}_{k}") for k in key), F.struct(F.lit(1).alias("there"), *rest).alias(name))
    both = side(before, "o").join(side(after, "n"), [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in key], "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")))
    what = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("updated")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keys = [F.when(F.col("n").isNotNull(), F.col(f"n_{k}")).otherwise(F.col(f"o_{k}")).alias(k) for k in key]
    return both.select(*keys, *(pick(c) for c in rest), F.col("n").isNull().alias("_gone"), what.alias("_what")).select(*after.columns, "_gone", "_what")


def apply(spark: SparkSession, store: str, tables: dict[str, DataFrame]) -> dict[str, dict[str, int]]:
    """Store the tables (by KEYS) as the next version and return what changed in each; a reader sees the old version or the new one.

    Only the rows that changed are written, save where a table is new, has other columns than before, or its parts are to be one again."""
    old = versions(spark, store)
    known = _parts(spark, store, old[-1]) if old else {}
    number, name_ = (old or [0])[-1] + 1, f".draft-{uuid.uuid4().hex}"
    draft, final = f"{store}/index/{name_}", f"{store}/index/v{number}"
    delta, parts = {}, {t: p for t, p in known.items() if t not in tables}
    for name, df in tables.items():
        before = load(spark, store, name) if name in known else df.limit(0)
        alike = name in known and sorted(before.dtypes) == sorted(df.dtypes)
        total = df.count()
        changed = written(_difference(before.select(*df.columns), df, KEYS[name]), "difference") if alike else None
        if changed is None:
            n = {"added": total, "removed": before.count(), "updated": 0} if name in known else {"added": total, "removed": 0, "updated": 0}
        else:
            n = {"added": 0, "removed": 0, "updated": 0} | {r["_what"]: r["n"] for r in changed.groupBy("_what").agg(F.count(F.lit(1)).alias("n")).collect()}
        delta[name] = n | {"unchanged": total - n["added"] - n["updated"]}
        so_far = sum(spark.read.parquet(f"{store}/index/v{p}/{name}").count() for p in known[name][1:]) if alike else 0
        if alike and len(known[name]) <= MOST_PARTS and so_far + sum(n.values()) <= MOST_SHARE * max(total, 1):
            parts[name] = known[name] + ([number] if sum(n.values()) else [])
            if sum(n.values()):
                changed.drop("_what").write.parquet(f"{draft}/{name}")
        else:
            parts[name] = [number]
            df.withColumn("_gone", F.lit(False)).write.parquet(f"{draft}/{name}")
    spark.createDataFrame(sorted(parts.items()), "name string, parts array<int>").coalesce(1).write.parquet(f"{draft}/_parts")
    fs, path = _fs(spark, store)
    done = not fs.exists(path(final)) and fs.rename(path(draft), path(final))
    # A rename onto a folder that another has just made moves the draft into it.
    if not done or fs.exists(path(f"{final}/{name_}")):
        fs.delete(path(f"{final}/{name_}"), True)
        fs.delete(path(draft), True)
        raise RuntimeError("the store is being written by another")
    return delta


def add_runs(spark: SparkSession, store: str, run_id: int, commit: str, results: DataFrame) -> None:
    """Append the results (test, ...) of one run; of several with one key the last stays: that of the greatest `place` where there is such a column, else the last row read."""
    place = F.col("place") if "place" in results.columns else F.monotonically_increasing_id()
    one = results.withColumn("_place", place).groupBy("test").agg(F.max(F.struct("_place", "outcome", "duration_ms", "failed_attempts")).alias("x")).select("test", "x.*")
    one.select(F.lit(run_id).cast("bigint").alias("run_id"), F.lit(commit).alias("commit"), "test", "outcome", "duration_ms", "failed_attempts").write.mode("append").parquet(f"{store}/results")


def missing_facts(files: DataFrame, facts: DataFrame) -> DataFrame:
    """The files (path, blob) whose facts are not stored: only these need reading again."""
    return files.join(facts.select("path", "blob"), ["path", "blob"], "left_anti")


def put_facts(spark: SparkSession, store: str, facts: DataFrame) -> None:
    """Add facts (path, blob, extractor, payload); of several with one key the last that was added is read."""
    fs, path = _fs(spark, store)
    last = spark.read.parquet(f"{store}/facts").agg(F.max("added")).first()[0] if fs.exists(path(f"{store}/facts")) else None
    facts.withColumn("added", F.lit((last or 0) + 1).cast("bigint")).write.mode("append").parquet(f"{store}/facts")


def facts(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/facts").groupBy("path", "blob", "extractor").agg(F.max(F.struct("added", "payload")).alias("x")).select("path", "blob", "extractor", "x.payload")


def read_files(spark: SparkSession, store: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines and declarations of the readable files (path, blob, language, text): those of a path and content that were read before come from the store, the others are read and added to it.

    A batch of new facts counts from the moment when its files are listed, so what a run that ended early has left is never read."""
    fs, path = _fs(spark, store)
    readable = files.filter("text is not null and language is not null")
    listed = f"{store}/read/files"
    schema = "path string, blob string, extractor string, batch string"
    known = (spark.read.schema(schema).parquet(listed) if fs.exists(path(listed)) else spark.createDataFrame([], schema)).filter(F.col("extractor") == EXTRACTOR)
    new = written(missing_facts(readable.select("path", "blob", "language", "text"), known), "new-files")
    if not new.isEmpty():
        batch = uuid.uuid4().hex
        of = new.select(F.col("path").alias("_p"), "blob")
        keep = lambda df: df.join(of, df["path"] == of["_p"]).drop("_p").withColumn("batch", F.lit(batch))
        lines = written(extraction.source_lines(new), "lines")
        keep(lines).write.mode("append").parquet(f"{store}/read/lines")
        keep(extraction.declarations(lines)).write.mode("append").parquet(f"{store}/read/declarations")
        new.select("path", "blob", F.lit(EXTRACTOR).alias("extractor"), F.lit(batch).alias("batch")).write.mode("append").parquet(listed)
        known = spark.read.schema(schema).parquet(listed).filter(F.col("extractor") == EXTRACTOR)
    if not fs.exists(path(f"{store}/read/lines")):
        none = extraction.source_lines(readable)
        return none, extraction.declarations(none)
    # One batch for each file, whichever of two that read it at once.
    use = readable.select("path", "blob").join(known.groupBy("path", "blob").agg(F.min("batch").alias("batch")), ["path", "blob"])
    use = written(use, "facts")
    return tuple(spark.read.parquet(f"{store}/read/{t}").join(use, ["path", "blob", "batch"], "left_semi").drop("blob", "batch") for t in ("lines", "declarations"))


def add_coverage(spark: SparkSession, store: str, report_id: int, commit: str, lines: DataFrame) -> None:
    """Append the lines (test, format, path, line, hit) of one coverage report."""
    lines.select(F.lit(report_id).cast("bigint").alias("id"), F.lit(commit).alias("commit"), "test", "format", "path", "line", "hit").write.mode("append").parquet(f"{store}/coverage")
