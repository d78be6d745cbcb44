"""Pruned lists lose nothing, and score few pairs where vectors form clusters."""

import numpy as np
import pytest

from attesta.operators import vector_lists as V


def frame(spark, x, block, first=0):
    return spark.createDataFrame([(first + i, str(b), [float(v) for v in r]) for i, (r, b) in enumerate(zip(x, block))], "id long, lang string, v array<double>")


def clusters(seed, n, per=12, d=24, spread=0.02):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, n // per), d))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    return centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, d)) * spread


def cosines(a, b):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    return np.round(a @ b.T, 9)


@pytest.mark.parametrize("threshold", [0.25, 0.90, 0.92])
@pytest.mark.parametrize("spread", [0.02, 0.09, 5.0])
def test_all_pairs_are_found_once(spark, threshold, spread):
    rng = np.random.default_rng(1)
    x, block = clusters(1, 240, spread=spread), rng.integers(0, 3, 240)
    x[5] = x[9]
    got = sorted((r["q_id"], r["c_id"]) for r in V.similar_pairs(frame(spark, x, block), "lang", "id", "v", threshold).collect())
    c = cosines(x, x)
    want = [(i, j) for i in range(240) for j in range(i + 1, 240) if block[i] == block[j] and c[i, j] >= threshold]
    assert got == want


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_nearest(spark, spread):
    rng = np.random.default_rng(2)
    x, q = clusters(2, 200, spread=spread), clusters(2, 40, spread=spread)
    bx, bq = rng.integers(0, 2, 200), rng.integers(0, 2, 40)
    got = {}
    for r in V.top_k_cosine(frame(spark, q, bq, 1000), frame(spark, x, bx), "lang", "id", "id", "v", 4).collect():
        got.setdefault(r["q_id"] - 1000, []).append((r["rank"], r["c_id"]))
    c = cosines(q, x)
    for i in range(40):
        ids = [j for j in range(200) if bx[j] == bq[i]]
        want = sorted(ids, key=lambda j: (-c[i, j], j))[:4]
        assert [j for _, j in sorted(got[i])] == want


def test_fewer_candidates_than_k_and_a_block_without(spark):
    x = np.eye(4)
    got = V.top_k_cosine(frame(spark, x, [0, 0, 1, 2]), frame(spark, x[:3], [0, 0, 1], 10), "lang", "id", "id", "v", 3)
    assert sorted((r["q_id"], r["c_id"]) for r in got.collect()) == [(0, 10), (0, 11), (1, 10), (1, 11), (2, 12)]
    assert V.similar_pairs(frame(spark, x[:0], []), "lang", "id", "v", 0.9).collect() == []


def test_pairs_scored_grow_below_the_square(spark):
    scored = []
    for n in (300, 3000):
        log = []
        V.similar_pairs(frame(spark, clusters(3, n), np.zeros(n, int)), "lang", "id", "v", 0.92, log)
        scored.append(log[0])
    assert scored[1] < 40 * scored[0] and scored[1] < 0.1 * 3000**2 / 2
