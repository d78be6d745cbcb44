import math
import random

import pytest

from attesta.operators.dedupe import components

N = 500


def path(ids):
    return list(zip(ids, ids[1:]))


SHUFFLED = random.Random(3).sample(range(10**9), N)
SHAPES = {"monotone": path(range(1, N + 1)), "one then down": path([1, *range(N, 1, -1)]), "star": [(N, i) for i in range(1, N)],
          "random ids": path(SHUFFLED)}


@pytest.mark.parametrize("shape", SHAPES)
def test_long_paths_settle_in_few_rounds(spark, shape):
    rounds = []
    got = components(spark.createDataFrame(SHAPES[shape], "a long, b long").coalesce(2), "a", "b", rounds).collect()
    ids = {i for e in SHAPES[shape] for i in e}
    assert {(r["id"], r["component"]) for r in got} == {(i, min(ids)) for i in ids} and len(got) == len(ids)
    assert len(rounds) <= 2 * math.log2(N) + 4


def test_several_components_loops_and_nulls(spark):
    edges = [(1, 2), (2, 1), (2, 3), (7, 7), (9, 8), (8, 9), (5, None), (3, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
