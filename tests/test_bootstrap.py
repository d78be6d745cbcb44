"""The cluster bootstrap against direct resampling."""

import hashlib
import random

import numpy as np
import pytest

from attesta.operators import metrics as M


def direct(rows, reps, seed):
    groups = sorted({g for g, y, s in rows if y is not None and s is not None}, key=lambda g: (hashlib.md5(g.encode()).hexdigest(), g))

    def area(sample):
        pos = [s for y, s in sample if y == 1]
        neg = [s for y, s in sample if y != 1]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg) if pos and neg else None

    of = {g: [(y, s) for h, y, s in rows if h == g and y is not None and s is not None] for g in groups}
    areas = []
    for rep in range(reps):
        drawn = [groups[int(hashlib.md5(f"{seed}:{rep}:{slot}".encode()).hexdigest()[:15], 16) % len(groups)] for slot in range(len(groups))]
        areas.append(area([x for g in drawn for x in of[g]]))
    areas = [a for a in areas if a is not None]
    return np.quantile(areas, 0.025), np.quantile(areas, 0.975), len(areas), area([x for g in groups for x in of[g]])


def made(seed, n, groups):
    rng = random.Random(seed)
    return [(f"g{rng.randrange(groups) ** 2 // groups}", rng.choice([0, 1, 1, None]), rng.choice([None, rng.randrange(6) / 4, rng.random()])) for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_against_direct_resampling(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(M, "BLOCK_BYTES", block_bytes)
    rows = made(1, 150, 12)
    df = spark.createDataFrame(rows, "g string, y int, s double").repartition(4)
    got = M.cluster_bootstrap(df, "g", "y", "s", 40, "7").collect()[0]
    want = direct(rows, 40, "7")
    assert [got["low"], got["high"], got["n_reps"], got["auroc"]] == pytest.approx(want, abs=1e-12)


def test_one_score_of_many_groups_in_slices(spark):
    rows = [(f"g{i}", i % 3 == 0, 0.5) for i in range(60)] + [("g1", 1, 0.25), ("g2", 0, 0.75), ("g3", 1, 0.9)]
    rows = [(g, int(y), s) for g, y, s in rows]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    by_group = M.histogram(df, ["g"], "y", "s").withColumn("_g", M.F.substring("g", 2, 9).cast("int"))
    weights = np.random.default_rng(1).integers(0, 4, (60, 9))
    sliced = M.joined_areas(M.weighted_areas(by_group, weights, step=9 * 7), 0).collect()
    whole = M.joined_areas(M.weighted_areas(by_group, weights), 0).collect()
    assert sorted(sliced) == sorted(whole)
    for rep, area in whole:
        pos = [(s, weights[int(g[1:]), rep]) for g, y, s in rows if y == 1]
        neg = [(s, weights[int(g[1:]), rep]) for g, y, s in rows if y != 1]
        total = sum(a * b * ((p > n) + (p == n) / 2) for p, a in pos for n, b in neg)
        assert area == pytest.approx(total / sum(a for _, a in pos) / sum(b for _, b in neg), abs=1e-12)


def test_no_rows(spark):
    got = M.cluster_bootstrap(spark.createDataFrame([], "g string, y int, s double"), "g", "y", "s", 5, "1").collect()[0]
    assert got["n_reps"] == 0 and got["auroc"] is None
