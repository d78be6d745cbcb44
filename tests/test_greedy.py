"""First-come and longest-first selection: the same as the sequential definition, and at what cost."""

import random
import time

import pytest
from pyspark.sql import functions as F

from attesta.operators import dedupe as D


def sequential(ids, edges):
    kept = []
    for i in sorted(ids):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    return kept


def keep(spark, ids, edges, **options):
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    links = spark.createDataFrame(sorted(edges), "before long, after long").repartition(3)
    return sorted(r[0] for r in D.greedy_keep(nodes, links, "id", **options).collect())


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_first_come(spark, most):
    rng = random.Random(2)
    ids = list(range(0, 120, 3))
    edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(40)}
    assert keep(spark, ids, edges, most=most) == sequential(ids, edges)


def test_a_chain_of_near_copies_takes_no_round(spark):
    log = []
    edges = {(i, i + 1) for i in range(1000)}
    assert keep(spark, range(1001), edges, log=log) == list(range(0, 1001, 2))
    assert log == []


def test_no_edges(spark):
    assert keep(spark, [4, 2], set()) == [2, 4]


def longest(spans):
    out = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[2])):
        if not any(s[0] < p[1] and s[1] > p[0] for p in out):
            out.append(s)
    return out


def pick(spark, texts):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "k int, s array<struct<start:int,end:int,id:int,score:double>>")
    return {r[0]: None if r[1] is None else [tuple(x) for x in r[1]] for r in df.select("k", D.longest_first(F.col("s"))).collect()}


def test_longest_first(spark):
    rng = random.Random(3)
    texts = [[(a := rng.randrange(200), a + rng.randrange(0, 30), i, i / 2) for i in range(n)] for n in (0, 1, 5, 60, 200)]
    assert pick(spark, texts) == {i: longest(t) for i, t in enumerate(texts)}


def test_longest_first_grows_nearly_in_proportion(spark):
    def seconds(n):
        rng = random.Random(4)
        df = spark.createDataFrame([([(a := rng.randrange(60 * n), a + 20 + rng.randrange(90), i, 0.0) for i in range(n)],)],
                                   "s array<struct<start:int,end:int,id:int,score:double>>").cache()
        df.count()
        best = 1e9
        for _ in range(3):
            t = time.time()
            df.select(F.size(D.longest_first(F.col("s")))).collect()
            best = min(best, time.time() - t)
        return best

    seconds(100)
    assert seconds(20000) <= 15 * seconds(2000)
