import random

import pytest

from ripplegraph.llm.components import components


def brute(edges):
    root = {}
    for u, v in edges:
        root.setdefault(u, u)
        root.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(root[u], root[v])
            changed |= root[u] != m or root[v] != m
            root[u] = root[v] = m
    return {k: r for k, r in root.items() if k != r}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_chains_and_stars(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(25)] + [(299, 200 + i) for i in range(20)] + [(7, 7), (8, 9), (9, 8)]
    r.shuffle(edges)
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {x["node"]: x["root"] for x in got} == brute(edges) and len(got) == len({x["node"] for x in got})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
