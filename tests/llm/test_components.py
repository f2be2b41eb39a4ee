import math
import random

import pytest

from sigloom.llm.components import connected_components, contract


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def check(spark, edges):
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = brute([e for e in edges if None not in e and e[0] != e[1]])
    assert set(found) == set(wanted)
    names = {}
    for node, root in found.items():
        assert names.setdefault(root, wanted[node]) == wanted[node]
    assert len(names) == len(set(wanted.values()))


@pytest.mark.parametrize("n", [64, 1000])
def test_ordered_chain_takes_logarithmic_rounds(spark, n):
    edges = [(k, k + 1) for k in range(n)]
    rounds = contract(spark.createDataFrame(edges, "a long, b long"))
    assert len(rounds) <= 2 * math.log2(n)
    if n == 64:
        check(spark, edges)


@pytest.mark.parametrize(("hub", "most"), [(-1, 1), (3000, 2 * math.log2(2000))])
def test_star_takes_few_rounds(spark, hub, most):
    assert len(contract(spark.createDataFrame([(hub, k) for k in range(2000)], "a long, b long"))) <= most


def test_random_graphs_nulls_loops_and_repeats(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    check(spark, edges + edges[:20] + [(5, 5), (None, 3), (400, None)])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    text = connected_components(spark.createDataFrame([("x", "y"), ("z", "y")], "a string, b string")).collect()
    assert len({t.root for t in text}) == 1 and len(text) == 3
