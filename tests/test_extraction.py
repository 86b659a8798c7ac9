"""Syntax errors, exports and method lookup against plain Python, and what the extraction makes of them."""

import random

import pytest

from ripplegraph.operators import exports, extraction, hierarchy, syntax


def lost_brackets(text):
    """line -> brackets that nothing opens or closes, with a stack for each kind."""
    out, stacks = {}, {"(": [], "[": [], "{": []}
    for n, line in enumerate(text.split("\n"), 1):
        for c in line:
            if c in stacks:
                stacks[c].append(n)
            elif c in ")]}":
                own = stacks[{")": "(", "]": "[", "}": "{"}[c]]
                if own:
                    own.pop()
                else:
                    out[n] = out.get(n, 0) + 1
    for own in stacks.values():
        for n in own:
            out[n] = out.get(n, 0) + 1
    return out


def test_brackets_that_do_not_close(spark):
    r = random.Random(1)
    texts = {f"f{i}": "\n".join("".join(r.choice("(){}[]x ") for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 12))) for i in range(200)}
    rows = [(p, n, line) for p, t in texts.items() for n, line in enumerate(t.split("\n"), 1)]
    got = {}
    for x in syntax.bracket_errors(spark.createDataFrame(rows, "path string, line int, text string")).collect():
        got.setdefault(x["path"], {})[x["line"]] = x["n"]
    assert got == {p: w for p, t in texts.items() if (w := lost_brackets(t))}


def errors(spark, files):
    df = spark.createDataFrame([(p, "java" if p.endswith("java") else "typescript", t) for p, t in files.items()], "path string, language string, text string")
    return {(x["path"], x["line"], x["of"]) for x in syntax.syntax_errors(df, extraction.source_lines(df), extraction._NOT_CODE).collect()}


def test_syntax_errors(spark):
    good = {
        "a.java": 'class A {\n  String s = "}"; // {\n  char c = \'"\';\n  /* { */\n  String t = """\n { """;\n}\n',
        "b.ts": "const r = s.replace(/[{('\"]/g, '');\nconst q = x.map((y) => `a ${y} {`);\nif (a / b > c / d) { f(/\\//); }\n",
        "c.tsx": "const A = () => <p>don't {x}</p>;\nconst B = () => <A b={1} />;\n",
    }
    assert errors(spark, good) == set()
    bad = {
        "a.java": "class A {\n  void f( {\n  }\n}\n",
        "b.java": 'class B {\n  String s = "open;\n}\n',
        "c.ts": "f(1);\n}\nconst a = [1,\n",
        "d.ts": "f();\n/* never\n closed {\n",
        "e.ts": "const a = `x\ny\n",
        "f.java": "\n".join("}" for _ in range(30)),
    }
    got = errors(spark, bad)
    assert {x for x in got if x[0] != "f.java"} == {("a.java", 2, 1), ("b.java", 2, 1), ("c.ts", 2, 2), ("c.ts", 3, 2), ("d.ts", 2, 1), ("e.ts", 1, 1)}
    assert {x for x in got if x[0] == "f.java"} == {("f.java", n, 30) for n in range(1, 21)}


def provided(exports_, module, name):
    """What a module provides under a name: the set of all that is reached, by a walk that enters no (module, name) twice."""
    own, stars = {}, {}
    for m, n, kind, value, to, to_name, away, place in exports_:
        if kind == "all":
            stars.setdefault(m, []).append((to, away))
        else:
            own.setdefault((m, n), []).append((place, kind, value or "", to or "", to_name or "", away, value, to, to_name))
    seen, todo, found, outside = set(), [(module, name, True)], set(), False
    while todo:
        at = todo.pop()
        if at[:2] in seen:
            continue
        seen.add(at[:2])
        m, n, straight = at
        if (m, n) in own:
            _, kind, _, _, _, away, value, to, to_name = min(own[m, n], key=lambda x: x[:6])
            if kind == "decl":
                found.add(value)
            elif away:
                outside |= straight
            elif kind == "namespace" and to:
                found.add(f"ns:{to}")
            elif kind == "named" and to:
                todo.append((to, to_name, straight))
        elif n != "default":
            outside |= straight and any(away for _, away in stars.get(m, ()))
            todo += [(to, n, False) for to, away in stars.get(m, ()) if to and not away]
    return (min(found), 5 if len(found) == 1 else 3) if found else ("external" if outside else None, 5)


def test_exports_through_layers_and_rings(spark):
    r = random.Random(4)
    schema = "module string, name string, kind string, value string, to_module string, to_name string, external boolean, place int"
    modules, names = [f"m{i:02}" for i in range(30)], ["a", "b", "c", "default"]
    rows = []
    for i in range(110):
        m, n, to = r.choice(modules), r.choice(names), r.choice([*modules, None])
        kind, away = r.choice(["decl", "named", "named", "namespace", "all", "all", "all"]), r.random() < 0.08
        rows.append((m, None if kind == "all" else n, kind, f"d{i}" if kind == "decl" else None, None if kind == "decl" else to, r.choice(names) if kind == "named" else None, away and kind != "decl", r.randrange(3) * 1000 + i))
    wanted = [(m, n) for m in modules for n in names]
    got = exports.resolved_exports(spark.createDataFrame(wanted, "module string, name string"), spark.createDataFrame(rows, schema)).collect()
    assert {(x["module"], x["name"]): (x["value"], x["strength"]) for x in got} == {w: provided(rows, *w) for w in wanted}


def test_imports_are_followed_to_their_declarations(spark):
    files = {
        "a/one.ts": "export function f(x: number) {\n  return 1;\n}\nexport default class Main {\n}\nexport function same() {\n}\n",
        "a/two.ts": "function inner() {\n}\nexport { inner as g, inner as h };\nexport function same() {\n}\n",
        "a/index.ts": "export { f as first } from './one';\nexport * from './two';\nexport * from './one';\nexport { default as Main } from './one';\nexport * as deep from './two';\n",
        "use.ts": "import { first, g as gee,\n  same } from './a';\nimport { Main } from './a/index';\nimport x, { y } from 'outside';\nimport * as ns from './a/one';\nexport function run(obj: any) {\n  first(1);\n  gee();\n  same();\n  new Main();\n  obj.gee();\n  y();\n}\n",
        "other.ts": "export function gee() {\n}\nexport function first() {\n}\n",
    }
    df = spark.createDataFrame([(p, "typescript", t) for p, t in files.items()], "path string, language string, text string")
    syms, edges, open_, _ = extraction.extracted(df)
    got = {(x["name"], x["to"], x["strength"]) for x in exports.imported_declarations(df, syms).filter("file = 'use.ts'").collect()}
    assert got == {("first", "typescript:a/one.ts#f", 5), ("gee", "typescript:a/two.ts#inner", 5), ("same", "typescript:a/one.ts#same", 3), ("Main", "typescript:a/one.ts#Main", 5)}
    have = {(x["t"], x["kind"], x["strength"], x["rule"]) for x in edges.filter("f = 'typescript:use.ts#run'").collect()}
    assert {("typescript:a/one.ts#f", "CALLS", 5, "typescript.call.import"), ("typescript:a/two.ts#inner", "CALLS", 5, "typescript.call.import"), ("typescript:a/one.ts#Main", "INSTANTIATES", 5, "typescript.new.import")} <= have
    assert ("typescript:other.ts#first", "CALLS") not in {x[:2] for x in have}


def test_methods_up_the_hierarchy(spark):
    r = random.Random(6)
    types = [(f"T{i:02}", r.choice(["class", "class", "interface", "enum"]), r.random() < 0.5, r.random() < 0.1) for i in range(25)]
    supers = list({(f"T{i:02}", f"T{r.randrange(25):02}") for i in range(25) for _ in range(r.randrange(3))})
    methods = [(f"m{i:03}", f"T{r.randrange(25):02}", r.choice("fg"), r.choice(["", "int", "int,int", "int..."]),) for i in range(80)]
    methods = [(i, o, n, s, 0 if not s else s.count(",") + 1, s.endswith("...")) for i, o, n, s in methods]
    calls = [(f"c{i}", f"T{r.randrange(25):02}", r.choice(["f", "g", "toString", "none"]), r.choice([None, 0, 1, 2])) for i in range(120)]
    t, s = spark.createDataFrame(types, "id string, kind string, extends boolean, external boolean"), spark.createDataFrame(supers, "id string, parent string")
    closure = hierarchy.levels(t, s)
    got = {}
    for x in hierarchy.method_candidates(spark.createDataFrame(calls, "call string, type string, name string, arity int"), closure, hierarchy.outside(t, closure), spark.createDataFrame(methods, "id string, owner string, name string, signature string, params int, varargs boolean")).collect():
        got.setdefault(x["call"], set()).add((x["method"], x["strength"], x["status"]))
    kind = {x[0]: x for x in types}
    for call, start, name, arity in calls:
        level, queue, seen = {}, [(start, 0)], set()
        for at, d in queue:
            if at not in seen:
                seen.add(at)
                level[at] = d
                queue += [(p, d + 1) for c, p in supers if c == at]
        best = {}
        for i, o, n, sig, size, varargs in methods:
            if o in level and n == name and (arity is None or (arity + 1 >= size if varargs else arity == size)):
                best[sig] = min(best.get(sig, (99, "")), (level[o], i)) if sig in best else (level[o], i)
        if best:
            want = {(i, 5 if len(best) == 1 else 3, "FOUND") for _, i in best.values()}
        else:
            away = any(kind[x][3] or (kind[x][1] == "class" and not kind[x][2]) or kind[x][1] == "enum" for x in level)
            want = {(None, None, "EXTERNAL" if away or name in hierarchy.OBJECT_METHODS else "NOT_FOUND")}
        assert got[call] == want


def test_own_calls_go_by_hierarchy_and_arity(spark):
    java = {
        "p/A.java": "package p;\npublic class A {\n  void one(int x) {\n  }\n  void one() {\n  }\n  void many(int a, String... more) {\n  }\n}\n",
        "p/B.java": "package p;\nclass B extends A {\n  void run() {\n    one(1);\n    this.one();\n    many(2);\n    other.one();\n    one(f(1), 2);\n  }\n}\n",
        "q/C.java": "package q;\nclass C {\n  void one(int x) {\n  }\n}\n",
    }
    df = spark.createDataFrame([(p, "java", t) for p, t in java.items()], "path string, language string, text string")
    syms, edges, _, errors_ = extraction.extracted(df)
    ids = {(x["file"], x["start_line"]): x["id"] for x in syms.collect() if x["kind"] == "method"}
    found = {(x["t"], x["line"], x["strength"]) for x in edges.filter("rule = 'java.call.own'").collect()}
    one, none, many = ids["p/A.java", 3], ids["p/A.java", 5], ids["p/A.java", 7]
    assert {(one, 4, 5), (none, 5, 5), (many, 6, 5)} <= found and {(one, 8, 3), (none, 8, 3)} <= found
    assert errors_.count() == 0


@pytest.mark.parametrize("text", ["", "{", "x"])
def test_small_texts(spark, text):
    assert errors(spark, {"a.ts": text}) == ({("a.ts", 1, 1)} if text == "{" else set())
