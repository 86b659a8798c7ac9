"""Lines at which a file's brackets do not close, or a comment or literal is left open.

Each kind of bracket is counted for itself over the code, comments and literals aside: a closing one that nothing opened is an error at its line, and so is an opening one
that nothing closes. Both come from running sums and least values over a file's lines, before and after each line; that ( closes before [ does in
([)] is not seen. Quotes are not told from text in .tsx and .jsx files, so a file of these that leaves one open is not judged by its brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines told of a file.
LINES = 20
_CLOSED = {'"': r'^"[^"\\\n]*(?:\\.[^"\\\n]*)*"$', "'": r"^'[^'\\\n]*(?:\\.[^'\\\n]*)*'$", "`": r"(?s)^`[^`\\]*(?:\\.[^`\\]*)*`$"}


def _levels(text: str, kind: str) -> Column:
    """end and low: the level of one kind of bracket after a line, and the least within it, from 0 at its start."""
    open_, close = kind
    only = F.split(F.regexp_replace(text, rf"[^\{open_}\{close}]", ""), "")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("low"))

    def step(s: Column, c: Column) -> Column:
        end = s["end"] + F.when(c == open_, 1).when(c == close, -1).otherwise(0)
        return F.struct(end.alias("end"), F.least(s["low"], end).alias("low"))

    return F.aggregate(only, start, step)


def bracket_errors(lines: DataFrame) -> DataFrame:
    """path, line, n: the lines (path, line, text: code alone) with n brackets that nothing opens or closes."""
    whole = Window.partitionBy("path").orderBy("line")
    so_far, later = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(1, Window.unboundedFollowing)
    out = lines.select("path", "line", "text")
    found = F.lit(0)
    for k, kind in enumerate(("()", "[]", "{}")):
        out = out.withColumn(f"x{k}", _levels("text", kind)).withColumn(f"end{k}", F.sum(f"x{k}.end").over(so_far))
        out = out.withColumn(f"low{k}", F.col(f"end{k}") - F.col(f"x{k}.end") + F.col(f"x{k}.low"))
        # What nothing opened does not count from then on.
        out = out.withColumn(f"lost{k}", F.least(F.lit(0), F.min(f"low{k}").over(so_far)))
        stays = F.least(F.col(f"end{k}") - F.col(f"lost{k}"), F.min(F.col(f"low{k}") - F.col(f"lost{k}")).over(later))
        out = out.withColumn(f"open{k}", stays)
        found += F.lag(f"lost{k}", 1, 0).over(whole) - F.col(f"lost{k}") + F.greatest(F.lit(0), F.col(f"open{k}") - F.lag(f"open{k}", 1, 0).over(whole))
    return out.withColumn("n", found.cast("int")).filter("n > 0").select("path", "line", "n")


def _left_open(x: Column, markup: Column) -> Column:
    quotes = [(F.startswith(x, F.lit(q)), ~F.rlike(x, F.lit(p)) & (F.lit(q == "`") | ~markup)) for q, p in _CLOSED.items()]
    out = F.when(F.startswith(x, F.lit("/*")), ~F.endswith(x, F.lit("*/")) | (F.length(x) < 4)).when(F.startswith(x, F.lit('"""')), ~F.endswith(x, F.lit('"""')) | (F.length(x) < 6))
    for starts, open_ in quotes:
        out = out.when(starts, open_)
    return out.otherwise(False)


def literal_errors(files: DataFrame, not_code: str) -> DataFrame:
    """path, line, n: where comments and literals of the files (path, text), which the expression finds, are left open."""
    markup = F.col("path").rlike(r"\.[jt]sx$")
    notes = files.select("path", F.regexp_extract_all("text", F.lit(not_code), 0).alias("notes"), F.split("text", not_code, -1).alias("code"), markup.alias("markup"))
    some = notes.filter(F.exists("notes", lambda x: _left_open(x, F.col("markup"))))
    ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    rows = some.select("path", "markup", F.posexplode(F.arrays_zip("code", "notes")).alias("at", "x"))
    before = F.sum(ends(F.coalesce("x.code", F.lit(""))) + ends(F.coalesce("x.notes", F.lit("")))).over(Window.partitionBy("path").orderBy("at"))
    rows = rows.withColumn("line", (before - ends(F.coalesce("x.notes", F.lit(""))) + 1).cast("int"))
    return rows.filter(_left_open(F.col("x.notes"), F.col("markup"))).groupBy("path", "line").agg(F.count(F.lit(1)).cast("int").alias("n"))


def syntax_errors(files: DataFrame, lines: DataFrame, not_code: str, most: int = LINES) -> DataFrame:
    """path, line, of: the first lines with errors of each file, no more than `most`, and the number of all such lines of the file."""
    quote = F.exists(F.regexp_extract_all("text", F.lit(not_code), 0), lambda x: (F.startswith(x, F.lit("'")) & ~F.rlike(x, F.lit(_CLOSED["'"]))) | (F.startswith(x, F.lit('"')) & ~F.rlike(x, F.lit(_CLOSED['"']))))
    unsure = files.filter(F.col("path").rlike(r"\.[jt]sx$") & quote).select("path")
    every = bracket_errors(lines).join(unsure, "path", "left_anti").select("path", "line").union(literal_errors(files, not_code).select("path", "line")).distinct()
    own = Window.partitionBy("path")
    placed = every.withColumn("k", F.row_number().over(own.orderBy("line"))).withColumn("of", F.count(F.lit(1)).over(own))
    return placed.filter(F.col("k") <= most).select("path", "line", F.col("of").cast("int").alias("of"))
