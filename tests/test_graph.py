"""Components against union-find, on paths, stars and random graphs."""

import random

import pytest

from corvane.operators.graph import components, dominant_stratum


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for e in edges for x in e}


def graphs():
    rnd = random.Random(3)
    yield [(i, i + 1) for i in range(70)]
    yield [(50, i) for i in range(50)]
    yield [(5, 5), (1, 2), (2, 1), (7, 3)]
    yield [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]


@pytest.mark.parametrize("edges", list(graphs()))
def test_like_union_find(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == brute(edges)


def test_nulls_and_empty(spark):
    assert components(spark.createDataFrame([(None, 1), (2, None)], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_dominant_stratum_ties_go_to_the_smaller(spark):
    m = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (2, "z"), (2, "a")], "g int, s string")
    assert sorted(map(tuple, dominant_stratum(m, "g", "s").collect())) == [(1, "a"), (2, "z")]
