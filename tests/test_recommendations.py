"""The rules by which changed and impacted symbols recommend tests, against plain Python."""

import random

from ripplegraph.operators import graph, selection


def expected(symbols, changed, impacted):
    parent, test, unit = ({s[0]: s[k] for s in symbols} for k in (1, 2, 3))

    def container(i):
        at = parent.get(i)
        while at is not None:
            if test[at] and not unit[at]:
                return at
            at = parent[at]
        return None

    found = []
    for i, change in changed:
        if change != "DELETED":
            to = i if test[i] else container(i)
            found += [(0, 0, -5, i, to, i)] * (to is not None)
    listed = {container(i) for i, *_ in impacted if unit[i]}
    for i, depth, strength, root, measured in impacted:
        to = i if unit[i] or (test[i] and (i not in listed or measured)) else None if test[i] else container(i)
        found += [(1, depth, -strength, i, to, root)] * (to is not None)
    best = {}
    for x in sorted(found):
        best.setdefault(x[4], x)
    return {(to, ("CHANGED_TEST", "STATIC_PATH")[r], d, -s, root) for to, (r, d, s, _, _, root) in best.items()}


def test_all_rules(spark):
    r = random.Random(12)
    for _ in range(3):
        symbols = [(f"s{i:02}", f"s{r.randrange(i):02}" if i and r.random() < 0.8 else None) for i in range(60)]
        symbols = [(i, p, t := r.random() < 0.5, t and r.random() < 0.5) for i, p in symbols]
        changed = [(f"s{i:02}", r.choice(["MODIFIED", "ADDED", "DELETED"])) for i in r.sample(range(60), 8)]
        impacted = [(f"s{i:02}", r.randrange(1, 4), r.randrange(1, 6), f"s{r.randrange(60):02}", r.random() < 0.3) for i in r.sample(range(60), 30)]
        table = spark.createDataFrame(symbols, "id string, parent string, is_test boolean, is_unit boolean")
        container = selection.containers(graph.parent_closure(table), table)
        got = selection.recommended(spark.createDataFrame(changed, "id string, change string"), spark.createDataFrame(impacted, "id string, depth int, strength int, root string, measured boolean"), table, container)
        assert {tuple(x) for x in got.collect()} == expected(symbols, changed, impacted)
