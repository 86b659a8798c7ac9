"""What a module exports under a name: declarations, names passed on from other modules, namespaces, and `export *`.

exports: module, name, kind, value, to_module, to_name, external, place. kind: `decl` (value is the declaration), `named` (to_name of to_module), `namespace` (all of
to_module as one), `all` (every name of to_module but default; no name of its own). A to_module that is null is missing; external: it lies outside of the
code base. Of what a module says of one name the least place counts: its own exports, then what it passes on; `export *` only where it says nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import paths
from ripplegraph.session import written

EXTERNAL = "external"
_NAME = r"[A-Za-z_$][\w$]*"
#: Statements of a TypeScript module, over several lines too.
_IMPORT = r"""(?m)^\s*import\s+[^;'"]*?\bfrom\s*['"][^'"]+['"]"""
_PASSED = r"""(?m)^\s*export\s+(?:type\s+)?(?:\{[^}]*\}|\*(?:\s+as\s+[A-Za-z_$][\w$]*)?)(?:\s*from\s*['"][^'"]+['"])?"""
_DECLARED = rf"(?m)^\s*export\s+(?:default\s+)?(?:(?:async|abstract|declare)\s+)*(?:function\*?|class|interface|enum|const|let|var|type)\s+{_NAME}"
_DEFAULT = rf"(?m)^\s*export\s+default\s+{_NAME}\s*;"
#: What may stand for a relative path, in order: fixed values.
ENDINGS = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js")


def first_files(options: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """key and the path of the least n of the options (key, n, path) that is one of the files (path)."""
    hit = options.join(files.select("path").distinct(), "path", "left_semi")
    return hit.groupBy(*key).agg(F.min_by("path", "n").alias("path"))


def resolved_modules(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (file, spec and more) with to_module: of the paths that a relative specifier may mean the first that is a file (path); null where none is or the specifier is not relative."""
    known = refs.withColumn("dir", F.regexp_extract("file", r"^(.*)/[^/]*$", 1))
    some = known.filter(F.startswith("spec", F.lit("."))).select("file", "dir", "spec").distinct().withColumn("stem", paths.joined_relative("dir", "spec")).filter("stem is not null")
    bare = F.regexp_replace("stem", r"\.(m?)js(x?)$", "")
    options = F.array(F.col("stem"), *(F.concat(bare, F.lit(e)) for e in ENDINGS[1:]))
    hit = first_files(some.select("file", "spec", F.posexplode(options).alias("n", "path")), files, ["file", "spec"])
    return refs.join(hit.withColumnRenamed("path", "to_module"), ["file", "spec"], "left")


def _spec(c: str) -> Column:
    return F.regexp_extract(c, r"""from\s*['"]([^'"]+)['"]""", 1)


def _named(rows: DataFrame, clause: Column, *keep: str) -> DataFrame:
    """keep, inner, outer of the names in braces: `a as b` has inner a and outer b."""
    each = rows.select(*keep, F.explode(F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ",")).alias("x")).withColumn("x", F.regexp_replace(F.trim(F.regexp_replace("x", r"\s+", " ")), "^type ", ""))
    each = each.select(*keep, F.regexp_extract("x", rf"^({_NAME})", 1).alias("inner"), F.regexp_extract("x", rf" as ({_NAME})$", 1).alias("as"))
    return each.filter("inner <> ''").select(*keep, "inner", F.coalesce(F.nullif("as", F.lit("")), "inner").alias("outer"))


def module_facts(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The imports (file, local, spec, to_module, to_name; to_name is null for a namespace) and the exports, as resolved_exports takes them, of TypeScript files (path, language, text)."""
    ts = files.filter("language <> 'java' and text is not null").select(F.col("path").alias("file"), "text")
    every = lambda pattern: ts.select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("s"))
    stmt = every(_IMPORT).withColumn("spec", _spec("s")).withColumn("clause", F.regexp_extract("s", r"(?s)^\s*import\s+(?:type\s+)?(.*?)\s*\bfrom\b", 1))
    one = lambda pattern, name: stmt.select("file", "spec", F.regexp_extract("clause", pattern, 1).alias("local"), F.lit(name).alias("to_name")).filter("local <> ''")
    imports = one(rf"^({_NAME})\s*(?:,|$)", "default").union(one(rf"\*\s+as\s+({_NAME})", None))
    imports = imports.union(_named(stmt, F.col("clause"), "file", "spec").select("file", "spec", "outer", "inner"))
    imports = written(resolved_modules(imports, files), "imports")

    top = symbols.filter(F.col("parent") == F.concat(F.lit("file:"), F.col("file"))).groupBy("file", "name").agg(F.min("id").alias("id"))
    said = every(_DECLARED).select("file", F.regexp_extract("s", rf"({_NAME})$", 1).alias("inner"), F.col("s").rlike(r"^\s*export\s+default\b").alias("default"))
    said = said.union(every(_DEFAULT).select("file", F.regexp_extract("s", rf"({_NAME})\s*;$", 1), F.lit(True))).select("file", "inner", F.when(F.col("default"), "default").otherwise(F.col("inner")).alias("outer"), F.lit(1).alias("place"))
    passed = every(_PASSED).withColumn("spec", F.nullif(_spec("s"), F.lit(""))).withColumn("star", F.col("s").rlike(r"^\s*export\s+(?:type\s+)?\*"))
    own = _named(passed.filter("spec is null and not star"), F.col("s"), "file").withColumn("place", F.lit(0)).unionByName(said)
    # A module's own names are declared there, or imported and passed on.
    own = own.join(top.withColumnRenamed("name", "inner"), ["file", "inner"], "left").join(imports.select("file", F.col("local").alias("inner"), "to_module", "to_name", "spec"), ["file", "inner"], "left")
    bound, text = F.col("id").isNull() & F.col("spec").isNotNull(), lambda c: F.lit(c).cast("string")
    outside = lambda spec: ~F.startswith(spec, F.lit("."))
    unknown = F.concat(F.lit("typescript:"), "file", F.lit("#"), "inner")
    found = own.select(F.col("file").alias("module"), F.col("outer").alias("name"), F.when(bound & F.col("to_name").isNull(), "namespace").when(bound, "named").otherwise("decl").alias("kind"), F.when(~bound, F.coalesce("id", unknown)).alias("value"), F.when(bound, F.col("to_module")).alias("to_module"), F.when(bound, F.col("to_name")).alias("to_name"), (bound & outside("spec")).alias("external"), "place")
    away = passed.filter("spec is not null")
    named = _named(away.filter("not star"), F.col("s"), "file", "spec").select("file", "spec", F.col("outer").alias("name"), F.col("inner").alias("to_name"), F.lit("named").alias("kind"))
    alias = F.nullif(F.regexp_extract("s", rf"\*\s+as\s+({_NAME})", 1), F.lit(""))
    stars = away.filter("star").select("file", "spec", alias.alias("name"), text(None).alias("to_name")).withColumn("kind", F.when(F.col("name").isNull(), "all").otherwise("namespace"))
    rest = resolved_modules(named.union(stars), files)
    rest = rest.select(F.col("file").alias("module"), "name", "kind", text(None).alias("value"), "to_module", "to_name", outside("spec").alias("external"), F.lit(2).alias("place"))
    return imports, found.union(rest)


def imported_declarations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, name, to, strength: what the names that a TypeScript file imports are declared as, through all modules that pass them on."""
    imports, exports = module_facts(files, symbols)
    named = imports.filter("to_module is not null and to_name is not null")
    got = resolved_exports(named.select(F.col("to_module").alias("module"), F.col("to_name").alias("name")), written(exports, "module-exports"))
    got = got.filter("value is not null").select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.col("value").alias("to"), "strength")
    return named.join(got, ["to_module", "to_name"]).join(symbols.select(F.col("id").alias("to")), "to", "left_semi").groupBy("file", F.col("local").alias("name")).agg(F.min(F.struct("to", "strength")).alias("x")).select("file", "name", "x.*")


def resolved_exports(wanted: DataFrame, exports: DataFrame) -> DataFrame:
    """module, name, value, strength of every (module, name) wanted: a declaration, ns: and a module, `external`, or null where there is none.

    Two different declarations that `export *` brings together are one kept (the least), which is no longer exact (3); the same one by two ways is exact (5).

    The names asked for lead to further ones until none is new; then the least and the greatest of what each provides go back along the same ways until nothing changes, so a table has a
    row for each name asked for, however many ways lead through layers of modules or round in a ring."""
    own = exports.filter("kind <> 'all'").groupBy("module", "name").agg(F.min(F.struct("place", "kind", "value", "to_module", "to_name", F.coalesce("external", F.lit(False)).alias("external"))).alias("own"))
    own = written(own.select("module", "name", "own.*").drop("place"), "exports")
    stars = written(exports.filter("kind = 'all'").select("module", "to_module", F.coalesce("external", F.lit(False)).alias("external")).distinct(), "stars")
    inside = stars.filter("to_module is not null and not external").select("module", "to_module")
    names = written(wanted.select("module", "name").distinct(), "names")
    fresh, ways = names, None
    while True:
        said = fresh.join(own, ["module", "name"], "left")
        passed = said.filter("kind = 'named' and to_module is not null and not external").select("module", "name", "to_module", "to_name", F.lit(False).alias("star"))
        spread = said.filter("kind is null and name <> 'default'").select("module", "name").join(inside, "module").select("module", "name", "to_module", F.col("name").alias("to_name"), F.lit(True).alias("star"))
        more = written(passed.union(spread), "ways")
        ways = more if ways is None else ways.unionByName(more)
        fresh = written(more.select(F.col("to_module").alias("module"), F.col("to_name").alias("name")).distinct().join(names, ["module", "name"], "left_anti"), "names")
        if fresh.isEmpty():
            break
        names = names.unionByName(fresh)
    value = F.when(F.col("kind") == "decl", F.col("value")).when((F.col("kind") == "namespace") & F.col("to_module").isNotNull() & ~F.col("external"), F.concat(F.lit("ns:"), "to_module"))
    outside = F.coalesce(F.col("kind").isin("named", "namespace") & F.col("external"), F.lit(False))
    # Where a module says nothing of a name, it may come from a module outside that it passes on as a whole.
    beyond = stars.filter("external").select("module").distinct().withColumn("beyond", F.lit(True))
    said = names.join(own, ["module", "name"], "left").join(beyond, "module", "left")
    outside = outside | (F.col("kind").isNull() & (F.col("name") != "default") & F.coalesce("beyond", F.lit(False)))
    first = written(said.select("module", "name", value.alias("lo"), value.alias("hi"), outside.alias("outside")).filter("lo is not null or outside"), "values")
    values = changed = first
    ways = written(ways, "ways")
    while True:
        # Only what changed in the round before goes on along the ways.
        there = changed.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), "lo", "hi", "outside")
        came = ways.join(there, ["to_module", "to_name"]).groupBy("module", "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.col("outside") & ~F.col("star")).alias("outside"))
        had = values.select("module", "name", *(F.col(c).alias(f"old_{c}") for c in ("lo", "hi", "outside")))
        both = came.filter("lo is not null or outside").join(had, ["module", "name"], "left")
        grown = {"lo": F.least("lo", "old_lo"), "hi": F.greatest("hi", "old_hi"), "outside": F.col("outside") | F.coalesce("old_outside", F.lit(False))}
        moved = ~(F.col("lo").eqNullSafe(F.col("old_lo")) & F.col("hi").eqNullSafe(F.col("old_hi")) & F.col("outside").eqNullSafe(F.col("old_outside")))
        changed = written(both.withColumns(grown).filter(moved).select("module", "name", "lo", "hi", "outside"), "values")
        if changed.isEmpty():
            break
        # lo only falls and hi only rises: of a name's rows the least and the greatest count.
        values = values.unionByName(changed).groupBy("module", "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("outside").alias("outside"))
        values = written(values, "values")
    out = wanted.select("module", "name").distinct().join(values, ["module", "name"], "left")
    # Only where nothing is found inside does the name come from outside.
    found = F.coalesce("lo", F.when(F.col("outside"), EXTERNAL))
    return out.select("module", "name", found.alias("value"), F.when(F.col("lo") != F.col("hi"), 3).otherwise(5).alias("strength"))
