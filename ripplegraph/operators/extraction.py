"""Symbols and edges of Java and TypeScript files from their lines, with built-in functions only.

Comments and strings are blanked in one pass from left to right, lines numbered, and the running sum of braces over a file's lines gives the nesting: a declaration ends where its
level closes, and stands in the innermost declaration around it. Names are resolved by joins, the nearer definition first. This reads
declarations, imports, supertypes, calls and constructions; types of expressions are not inferred, so calls carry inferred evidence only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.operators import exports, hierarchy
from ripplegraph.operators.graph import overrides, parent_closure
from ripplegraph.operators.syntax import syntax_errors
from ripplegraph.schema import EDGE_KINDS, TYPE_KINDS
from ripplegraph.session import placed, written

#: Comments, regular expressions (after what an expression may follow), text blocks, strings, characters and templates, whichever begins first; what is left open ends with the line or the file.
_NOT_CODE = r"""(?s)/\*.*?(?:\*/|\z)|//[^\n]*|(?<=[=(,:;!&|?\[{\n]\s{0,9})/(?![*/\s>])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*|\"\"\".*?(?:\"\"\"|\z)|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|`[^`\\]*+(?:\\.[^`\\]*+)*+`?"""
_TYPE = r"\b(?:(@interface|class|interface|enum|record))\s+([A-Za-z_$][\w$]*)"
_JAVA_METHOD = r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]+>\s*)?(?:[\w$.]+(?:<[^(]*>)?(?:\[\])*\s+)?([A-Za-z_$][\w$]*)\s*\([^;]*?\)\s*(?:throws\s+[\w$., ]+)?\{"
_TS_METHOD = r"^\s*(?:(?:export|default|public|private|protected|static|async|readonly|override|get|set)\s+)*(?:function\s+)?([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\([^;]*?\)\s*(?::[^={]+)?\{"
_TS_ARROW = r"^\s*(?:export\s+)?(?:const|let)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^;]*?\)\s*(?::[^=]+)?=>"
#: Words before a parenthesis that name no callable: fixed values.
_KEYWORDS = "if for while switch catch return new throw else do try synchronized super this function typeof await yield assert case".split()
_TEST = r"@(?:Test|ParameterizedTest|RepeatedTest|TestFactory|TestTemplate)\b"
_TEST_PATH = r"(^|/)(__tests__|tests?)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)src/test/"


def source_lines(files: DataFrame) -> DataFrame:
    """path, language, line, text (blanked), plain (as it is), before and after (nesting) of every line of the files (path, language, text)."""
    notes = F.regexp_extract_all("text", F.lit(_NOT_CODE), 0)
    # A comment leaves its line ends, a string an empty one and its line ends.
    ends = lambda x: F.repeat(F.lit("\n"), F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    left = F.transform(notes, lambda x: F.concat(F.when(F.startswith(x, F.lit("/")), "").otherwise("''"), ends(x)))
    blank = F.array_join(F.zip_with(F.split("text", _NOT_CODE, -1), left, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    rows = files.select("path", "language", F.arrays_zip(F.split(blank, "\n").alias("b"), F.split("text", "\n").alias("p")).alias("z"))
    rows = rows.select("path", "language", F.posexplode("z").alias("at", "x")).select("path", "language", (F.col("at") + 1).alias("line"), F.coalesce("x.b", F.lit("")).alias("text"), F.coalesce("x.p", F.lit("")).alias("plain"))
    step = F.length(F.regexp_replace("text", r"[^{]", "")) - F.length(F.regexp_replace("text", r"[^}]", ""))
    w = Window.partitionBy("path").orderBy("line")
    rows = rows.withColumn("after", F.sum(step).over(w).cast("int"))
    return rows.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0)))


def declarations(lines: DataFrame) -> DataFrame:
    """path, language, start_line, end_line, depth, kind, name, header of every type and callable."""
    method = F.when(F.col("language") == "java", F.regexp_extract("text", _JAVA_METHOD, 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract("text", _TS_METHOD, 1), F.lit("")), F.regexp_extract("text", _TS_ARROW, 1)))
    type_name = F.regexp_extract("text", _TYPE, 2)
    kind = F.when(type_name != "", F.when(F.regexp_extract("text", _TYPE, 1) == "@interface", "annotation").otherwise(F.regexp_extract("text", _TYPE, 1))).otherwise(F.when((F.col("language") != "java") & (F.col("before") == 0), "function").otherwise("method"))
    name = F.when(type_name != "", type_name).otherwise(method)
    found = lines.withColumn("name", name).filter((F.col("name") != "") & ~F.col("name").isin(*_KEYWORDS)).select("path", "language", "line", "text", "before", "after", "name", kind.alias("kind"))
    # A line closes every level from its own nesting up to that of the line before.
    closed = lines.filter("after < before").select("path", F.explode(F.sequence("after", F.col("before") - 1)).alias("depth"), F.col("line").alias("end"))
    ends = found.select("path", "line", F.col("before").alias("depth")).join(closed, ["path", "depth"]).filter("end > line").groupBy("path", "line").agg(F.min("end").alias("end"))
    whole = found.join(ends, ["path", "line"], "left")
    end = F.when(F.col("after") > F.col("before"), F.coalesce("end", "line")).otherwise(F.col("line"))
    return whole.select("path", "language", F.col("line").alias("start_line"), end.cast("int").alias("end_line"), F.col("before").alias("depth"), "kind", "name", F.col("text").alias("header"))


def _module(lines: DataFrame) -> DataFrame:
    """path, module: a Java file's package, a TypeScript file's path."""
    package = F.max(F.when(F.col("language") == "java", F.nullif(F.regexp_extract("text", r"^\s*package\s+([\w.]+)\s*;", 1), F.lit(""))))
    return lines.groupBy("path").agg(package.alias("package")).select("path", F.coalesce("package", "path").alias("module"))


def symbols(lines: DataFrame, decls: DataFrame) -> DataFrame:
    """id, kind, name, module, file, start_line, end_line, parent, visibility, is_test, is_unit, fp, language of declarations and files.

    A name that a container has more than once is numbered in the order of lines; the fingerprint is that of the lines without white space."""
    d = decls.withColumn("key", F.concat_ws(":", "path", "start_line", "name"))
    outer = d.select(F.col("path").alias("op"), F.col("key").alias("outer"), F.col("start_line").alias("os"), F.col("end_line").alias("oe"), F.col("depth").alias("od"))
    around = d.join(outer, (F.col("path") == F.col("op")) & (F.col("start_line") > F.col("os")) & (F.col("end_line") <= F.col("oe")) & (F.col("od") < F.col("depth")), "left")
    chain = around.groupBy("key").agg(F.max(F.struct("od", "outer")).alias("up"), F.array_sort(F.collect_list(F.struct("od", "outer"))).alias("all"))
    d = d.join(chain, "key").join(_module(lines), "path")
    names = F.transform(F.filter("all", lambda x: x["outer"].isNotNull()), lambda x: F.element_at(F.split(x["outer"], ":"), -1))
    callable_ = F.col("kind").isin("method", "function")
    outermost = F.when(F.size(names) > 0, F.array_join(names, ".")).when(~callable_, F.col("name"))
    whole = F.when(F.col("language") == "java", F.concat_ws(".", "module", outermost)).otherwise(F.concat_ws("#", "module", outermost))
    base = F.concat(F.col("language"), F.lit(":"), F.concat_ws("#", whole, F.when((F.size(names) > 0) | callable_, F.col("name"))))
    d = d.withColumn("base", base).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("path", "start_line")))
    d = d.withColumn("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" #"), F.col("n").cast("string"))))
    body = d.select("key", F.col("path").alias("bp"), "start_line", "end_line").join(lines.select(F.col("path").alias("lp"), "line", F.regexp_replace("text", r"\s+", "").alias("t"), "plain"), (F.col("bp") == F.col("lp")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    body = body.groupBy("key").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")).alias("fp"))
    marked = lines.withColumn("above", F.lag("text").over(Window.partitionBy("path").orderBy("line"))).select(F.col("path").alias("mp"), F.col("line").alias("ml"), (F.coalesce(F.col("above"), F.lit("")).rlike(_TEST) | F.col("text").rlike(_TEST)).alias("marked"))
    d = d.join(body, "key").join(marked, (F.col("path") == F.col("mp")) & (F.col("start_line") == F.col("ml")))
    up = d.select(F.col("key").alias("pk"), F.col("id").alias("pid"))
    out = d.join(up, F.col("up.outer") == F.col("pk"), "left")
    vis = F.when(F.col("header").rlike(r"\bpublic\b|\bexport\b"), "public").when(F.col("header").rlike(r"\bprotected\b"), "protected").when(F.col("header").rlike(r"\bprivate\b"), "private").otherwise(F.when(F.col("language") == "java", "package").otherwise("public"))
    in_tests = F.col("path").rlike(_TEST_PATH)
    unit = F.col("marked") & F.col("kind").isin("method", "function")
    own = out.select("id", "kind", "name", "module", F.col("path").alias("file"), "start_line", "end_line", F.coalesce("pid", F.concat(F.lit("file:"), "path")).alias("parent"), vis.alias("visibility"), (in_tests | unit).alias("is_test"), unit.alias("is_unit"), "fp", "language")
    whole = lines.groupBy("path", "language").agg(F.max("line").cast("int").alias("end_line"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.regexp_replace(x["text"], r"\s+", "")), "\n")).alias("fp")).join(_module(lines), "path")
    files = whole.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "module", F.col("path").alias("file"), F.lit(1).alias("start_line"), "end_line", F.lit(None).cast("string").alias("parent"), F.lit("public").alias("visibility"), F.col("path").rlike(_TEST_PATH).alias("is_test"), F.lit(False).alias("is_unit"), "fp", "language")
    return own.unionByName(files)


def _edge(df: DataFrame, f: str, t: str, kind: str, strength: Column, line: str, rule: Column) -> DataFrame:
    return df.select(F.col(f).alias("f"), F.col(t).alias("t"), F.lit(kind).alias("kind"), F.lit(EDGE_KINDS.index(kind)).alias("kind_ord"), strength.cast("int").alias("strength"), (5 - strength).cast("int").alias("ev_ord"), F.col("file"), F.col(line).cast("int").alias("line"), rule.alias("rule"))


def _resolved(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """refs (id, file, line, module, language, name) with to (null: none, or several) and near: the only target (id, name, file, module, language) in the file, else in the module, else anywhere in the language."""
    out = refs
    for n, key in enumerate((["name", "language", "file"], ["name", "language", "module"], ["name", "language"])):
        one = targets.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias(f"to{n}")).filter("c = 1").drop("c")
        out = out.join(one, key, "left")
    return out.withColumn("to", F.coalesce("to0", "to1", "to2")).withColumn("near", F.col("to0").isNotNull() | F.col("to1").isNotNull())


def _references(lines: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, constructions and supertypes (id, file, line, module, language, start_line, name) of the declarations."""
    at = own.select("id", "file", "module", "language", "start_line", "end_line", F.col("name").alias("own_name"))
    spots = lines.select(F.col("path").alias("lp"), "line", "text", F.col("language").alias("ll"))
    # The innermost declaration around each line.
    inside = spots.join(at, (F.col("lp") == F.col("file")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).groupBy("lp", "line", "text").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "id", "module", "language", "start_line", "own_name")).alias("x"))
    inside = inside.select(F.col("lp").alias("file"), "line", "text", "x.id", "x.module", "x.language", "x.start_line", "x.own_name")
    refs = lambda pattern, group: inside.select("id", "file", "line", "module", "language", "start_line", "own_name", F.explode(F.regexp_extract_all("text", F.lit(pattern), group)).alias("name"))
    calls = refs(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*\(", 1).filter(~F.col("name").isin(*_KEYWORDS))
    # A declaration's own head is no call.
    calls = calls.filter("line <> start_line or name <> own_name")
    made = refs(r"\bnew\s+(?:[\w$]+\.)*([A-Za-z_$][\w$]*)", 1)
    supers = refs(r"\b(?:extends|implements)\s+([\w$., <>]+)", 1).filter("line = start_line").withColumn("name", F.explode(F.split(F.regexp_replace("name", "<[^>]*>", ""), ",")))
    supers = supers.withColumn("name", F.regexp_extract(F.trim("name"), r"^([A-Za-z_$][\w$]*)", 1))
    return calls, made, supers


def _targets(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = own.select("id", "name", "file", "module", "language", "kind")
    call = F.col("kind").isin("method", "function")
    return named.filter(call).drop("kind"), named.filter(~call).drop("kind")


def unresolved(lines: DataFrame, syms: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """id, file, line, detail: calls and constructions whose name the code base declares, but not so that one declaration can be told. bound: references (file, line, name) that are known otherwise."""
    own = syms.filter("kind <> 'file'")
    calls, made, _ = _references(lines, own)
    callables, types = _targets(own)
    out = None
    for refs, targets, what in ((calls, callables, "call of "), (made, types, "construction of ")):
        refs = refs if bound is None else refs.join(bound.select("file", "line", "name"), ["file", "line", "name"], "left_anti")
        open_ = _resolved(refs, targets).filter("to is null").join(targets.select("name", "language").distinct(), ["name", "language"], "left_semi")
        rows = open_.select("id", "file", "line", F.concat(F.lit(what), "name").alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _methods(syms: DataFrame, decls: DataFrame) -> DataFrame:
    """id, owner, name, language, params (erased types), signature, n_params, varargs of every method."""
    heads = decls.select(F.col("path").alias("file"), "start_line", "name", "header").withColumn("args", F.regexp_replace(F.regexp_extract("header", r"\(([^)]*)\)", 1), r"<[^<>]*>", ""))
    kinds = F.transform(F.split("args", ","), lambda x: F.regexp_extract(F.trim(x), r"([A-Za-z_$][\w$]*(?:\[\])*)(?:\.\.\.)?\s+[\w$]+$", 1))
    java = F.col("language") == "java"
    methods = syms.filter("kind = 'method'").join(heads, ["file", "start_line", "name"])
    size = F.when(F.trim("args") == "", 0).otherwise(F.size(F.split("args", ",")))
    return methods.select("id", F.col("parent").alias("owner"), "name", "language", F.when(java, F.array_join(kinds, ",")).otherwise("").alias("params"), F.when(java, F.regexp_replace("args", r"\s+", " ")).otherwise("").alias("signature"), size.alias("n_params"), F.contains("args", F.lit("...")).alias("varargs"))


def overriding(syms: DataFrame, decls: DataFrame, up: DataFrame) -> DataFrame:
    """f, t, strength: methods that override one of a supertype; up: the supertype edges (f, t). Java methods are told by their erased parameter types, others by name."""
    above = parent_closure(up.select(F.col("f").alias("id"), F.col("t").alias("parent")))
    return overrides(_methods(syms, decls).select("id", "owner", "name", "params", "signature"), above.select(F.col("id").alias("owner"), F.col("ancestor").alias("above"), "distance"))


#: A call without a receiver, or on this or super, with its arguments where they hold no parentheses.
_OWN_CALL = r"(?:(?<![\w$])(?:this|super)\s*\.\s*|(?<![\w$.]))([A-Za-z_$][\w$]*)\s*\((?:[^()]*\))?"


def own_calls(lines: DataFrame, decls: DataFrame, syms: DataFrame) -> DataFrame:
    """id, file, line, name, to, strength: Java calls of a type's own and inherited methods, by name and number of arguments up the hierarchy."""
    own = syms.filter("kind <> 'file'")
    java = own.filter("language = 'java'")
    _, types = _targets(own)
    _, _, supers = _references(lines, java)
    named = written(_resolved(supers, types).filter("to is null or to <> id"), "supers")
    kinds = java.filter(F.col("kind").isin(*TYPE_KINDS)).select("id", "kind", "file", "start_line")
    heads = decls.select(F.col("path").alias("file"), "start_line", F.col("header").rlike(r"\bextends\b").alias("extends")).groupBy("file", "start_line").agg(F.max("extends").alias("extends"))
    away = named.filter("to is null").select("id").distinct().withColumn("external", F.lit(True))
    kinds = kinds.join(heads, ["file", "start_line"]).join(away, "id", "left").select("id", "kind", "extends", F.coalesce("external", F.lit(False)).alias("external"))
    closure = written(hierarchy.levels(kinds, named.filter("to is not null").select("id", F.col("to").alias("parent"))), "levels")
    inside = java.join(kinds.select(F.col("id").alias("parent")), "parent", "left_semi").filter("kind = 'method'").select(F.col("id").alias("caller"), F.col("parent").alias("type"), "file", "start_line", "end_line")
    spots = lines.filter("language = 'java'").select(F.col("path").alias("file"), "line", F.explode(F.regexp_extract_all("text", F.lit(_OWN_CALL), 0)).alias("s"))
    spots = spots.withColumn("name", F.regexp_extract("s", r"([A-Za-z_$][\w$]*)\s*\(", 1)).filter(~F.col("name").isin(*_KEYWORDS))
    args = F.regexp_extract("s", r"\(([^()]*)\)$", 1)
    spots = spots.withColumn("arity", F.when(F.endswith("s", F.lit(")")), F.when(F.trim(args) == "", 0).otherwise(F.size(F.split(args, ",")))))
    at = spots.join(inside, "file").filter("line > start_line or (line = start_line and end_line = start_line)").filter("line <= end_line")
    at = at.groupBy("file", "line", "s", "name", "arity").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "caller", "type")).alias("x"))
    at = written(at.select(F.concat_ws(" ", "file", "line", "s").alias("call"), "x.type", "name", "arity", F.col("x.caller").alias("id"), "file", "line"), "own-calls")
    methods = _methods(java, decls).withColumn("params", F.col("n_params"))
    found = hierarchy.method_candidates(at, closure, hierarchy.outside(kinds, closure), methods).filter("status = 'FOUND'")
    return at.join(found, "call").select("id", "file", "line", "name", F.col("method").alias("to"), "strength").distinct()


def _bound(files: DataFrame, lines: DataFrame, decls: DataFrame, syms: DataFrame) -> DataFrame:
    """id, file, line, name, to, strength, kind, rule: references that are known by their type's hierarchy or by their module's imports."""
    own = syms.filter("kind <> 'file'")
    mine = own_calls(lines, decls, syms).withColumns({"kind": F.lit("CALLS"), "rule": F.lit("java.call.own")})
    names = written(exports.imported_declarations(files, syms), "imported")
    calls, made, _ = _references(lines.filter("language <> 'java'"), own)
    ts = calls.withColumn("kind", F.lit("CALLS")).union(made.withColumn("kind", F.lit("INSTANTIATES")))
    # A name that the file declares itself, or calls on a receiver, is not the imported one.
    plain = lines.select(F.col("path").alias("file"), "line", F.col("text").alias("code"))
    ts = ts.join(plain, ["file", "line"]).filter(F.rlike(F.col("code"), F.concat(F.lit(r"(?<![\w$.])"), F.replace("name", F.lit("$"), F.lit(r"\$")), F.lit(r"\s*[(<]")))).join(names, ["file", "name"])
    return mine.unionByName(ts.select("id", "file", "line", "name", "to", "strength", "kind", F.concat(F.lit("typescript."), F.when(F.col("kind") == "CALLS", "call").otherwise("new"), F.lit(".import")).alias("rule"))).distinct()


def edges(lines: DataFrame, decls: DataFrame, syms: DataFrame, bound: DataFrame) -> DataFrame:
    """f, t, kind, ... : containment, imports, supertypes, overrides, calls and constructions; bound: what is known of calls by their types and imports, which goes before what their names tell."""
    five, three, one = F.lit(5), F.lit(3), F.lit(1)
    own = syms.filter("kind <> 'file'")
    contains = _edge(own, "parent", "id", "CONTAINS", five, "start_line", F.concat("language", F.lit(".declaration")))
    calls, made, supers = _references(lines, own)
    callables, types = _targets(own)
    free = lambda refs: refs.join(bound.select("file", "line", "name"), ["file", "line", "name"], "left_anti")
    calls, made = free(calls), free(made)
    call = _resolved(calls, callables).filter("to is not null and to <> id")
    new = _resolved(made, types).filter("to is not null and to <> id")
    up = _resolved(supers, types).filter("to is not null and to <> id")
    over = overriding(syms, decls, up.select(F.col("id").alias("f"), F.col("to").alias("t"))).join(own.select(F.col("id").alias("f"), "file", "start_line", "language"), "f")
    strength = F.when(F.col("near"), three).otherwise(one)
    found = [
        contains,
        _edge(call, "id", "to", "CALLS", strength, "line", F.concat("language", F.lit(".call.name"))),
        _edge(new, "id", "to", "INSTANTIATES", strength, "line", F.concat("language", F.lit(".new"))),
        _edge(up, "id", "to", "EXTENDS", F.when(F.col("near"), five).otherwise(three), "line", F.concat("language", F.lit(".supertype"))),
        _imports(lines, syms),
        *(_edge(bound.filter(F.col("kind") == k), "id", "to", k, F.col("strength"), "line", F.col("rule")) for k in ("CALLS", "INSTANTIATES")),
        _edge(over, "f", "t", "OVERRIDES", F.col("strength"), "start_line", F.concat("language", F.lit(".override"))),
    ]
    out = found[0]
    for e in found[1:]:
        out = out.unionByName(e)
    rest = [c for c in out.columns if c not in ("f", "t", "kind", "line")]
    best = out.filter("f <> t").groupBy("f", "t", "kind", "line").agg(F.min(F.struct("ev_ord", "rule", F.struct(*rest).alias("e")))["e"].alias("e"))
    return best.select(*(c if c not in rest else F.col(f"e.{c}") for c in out.columns))


def _imports(lines: DataFrame, syms: DataFrame) -> DataFrame:
    """IMPORTS of files: of Java types by their full names, of TypeScript modules by the first candidate path that is a file."""
    java = lines.filter("language = 'java'").select(F.col("path").alias("file"), "line", F.concat(F.lit("java:"), F.regexp_extract("text", r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", 1)).alias("to")).filter("to <> 'java:'")
    java = java.join(syms.select(F.col("id").alias("to")), "to", "left_semi")
    spec = F.regexp_extract("code", r"""(?:from|import|require\()\s*['"](\.[^'"]+)['"]""", 1)
    ts = lines.filter("language <> 'java'").select(F.col("path").alias("file"), "line", F.col("plain").alias("code")).withColumn("spec", spec).filter("spec <> ''")
    modules = syms.filter("kind = 'file'").select(F.col("file").alias("path"))
    ts = exports.resolved_modules(ts, modules).filter("to_module is not null").select("file", "line", F.concat(F.lit("file:"), "to_module").alias("to"))
    both = java.select("file", "line", "to", F.lit("java.import").alias("rule")).union(ts.select("file", "line", "to", F.lit("ts.import")))
    return _edge(both.withColumn("from", F.concat(F.lit("file:"), "file")), "from", "to", "IMPORTS", F.lit(5), "line", F.col("rule"))


def canonical_types(types: DataFrame) -> DataFrame:
    """types (fqn, path and more) with id: of the types of one name the first by path keeps it, the others' ids carry their paths."""
    first = types.groupBy("fqn").agg(F.min("path").alias("first"))
    return types.join(first, "fqn").withColumn("id", F.when(F.col("path") == F.col("first"), F.col("fqn")).otherwise(F.concat("fqn", F.lit("@"), "path"))).drop("first")


def numbered_titles(rows: DataFrame, title: str, order: list[Column]) -> DataFrame:
    """rows with the title of all but the first of each title numbered, in an order (a total one): `title #2`. A title that very many rows have is numbered by ranges."""
    n = placed(rows, order, "_nth", [title])
    return n.withColumn(title, F.when(F.col("_nth") == 1, F.col(title)).otherwise(F.concat(title, F.lit(" #"), F.col("_nth").cast("string")))).drop("_nth")


class Extracted(NamedTuple):
    """errors: path, line, of: where files do not parse, the first lines of each and the number of all."""

    symbols: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    errors: DataFrame


def extracted(files: DataFrame, facts: tuple[DataFrame, DataFrame] | None = None) -> Extracted:
    """The symbols and edges of the readable files (path, language, text), the references that stay unresolved, and the lines with syntax errors. facts: the files' lines and declarations, where they are known."""
    files = files.filter("text is not null and language is not null")
    lines = written(source_lines(files) if facts is None else facts[0], "lines")
    decls = written(declarations(lines) if facts is None else facts[1], "declarations")
    syms = written(symbols(lines, decls), "symbols")
    bound = written(_bound(files, lines, decls, syms), "bound")
    return Extracted(syms, edges(lines, decls, syms, bound), unresolved(lines, syms, bound), syntax_errors(files, lines, _NOT_CODE))
