"""Logistic models of many folds at once against a plain optimiser, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import logistic as G
from attesta.operators import models as L


def made(seed, n, d, missing=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 3
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) > 4).astype(int)
    x[rng.random((n, d)) < missing] = np.nan
    return x, y, rng.integers(0, 3, n)


def frame(spark, x, y, fold):
    rows = [(i, int(y[i]), int(fold[i]), i % 5 == 0, [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, y int, fold int, is_test boolean, x array<double>").repartition(4)


def plain(x, y, c):
    """Centre, scale and coefficients by gradient steps with the exact Lipschitz constant."""
    center = np.nanmean(x, axis=0)
    z = np.where(np.isnan(x), center, x)
    scale = z.std(0)
    z = np.concatenate([(z - center) / scale, np.ones((len(z), 1))], axis=1)
    w = c * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    flat = np.append(np.ones(x.shape[1]), 0)
    b, look, t = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 1.0
    rate = 1 / (np.linalg.norm((z * np.sqrt(w)[:, None]).T @ (z * np.sqrt(w)[:, None]), 2) / 4 + 1)
    for _ in range(60000):
        new = look - rate * (z.T @ (w * (1 / (1 + np.exp(-z @ look)) - y)) + flat * look)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, b, t = new + (t - 1) / s * (new - b), new, s
    return center, scale, b


@pytest.mark.parametrize("c", [0.01, 1.0])
def test_fits_of_all_folds(spark, c):
    x, y, fold = made(1, 240, 4, 0.1)
    fits = G.fit_all(frame(spark, x, y, fold), 3, {"all": ([0, 1, 2, 3], c), "one": ([2], c)}, folds=[0, 1, 2, -1])
    assert [(m.name, m.fold) for m in fits] == [(n, f) for n in ("all", "one") for f in (0, 1, 2, -1)]
    for m in fits:
        center, scale, b = plain(x[fold != m.fold][:, m.dims], y[fold != m.fold], c)
        assert m.center == pytest.approx(center) and m.scale == pytest.approx(scale)
        assert m.beta == pytest.approx(b, abs=1e-5)


def test_separable_classes_and_constant_columns_converge(spark):
    x = np.array([[float(i), 7.0] for i in range(40)])
    fits = G.fit_all(frame(spark, x, (x[:, 0] > 20).astype(int), np.zeros(40, int)), 1, {"m": ([0, 1], 100.0)}, folds=[-1])
    assert fits[0].done and fits[0].beta[1] == pytest.approx(0) and fits[0].beta[0] > 1


def test_one_class_or_no_rows_give_no_model(spark):
    x, _, fold = made(2, 30, 2)
    assert G.fit_all(frame(spark, x, np.ones(30), fold), 3, {"m": ([0, 1], 1.0)}) == []
    assert G.fit_all(frame(spark, x[:0], np.ones(0), fold[:0]), 3, {"m": ([0, 1], 1.0)}) == []


def area(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg))


def test_table_applies_as_fitted(spark):
    x, y, fold = made(3, 200, 3, 0.2)
    df = frame(spark, x, y, fold)
    fits = G.fit_all(df, 3, {"m": ([0, 2], 1.0)})
    got = {r["id"]: r["p"] for r in L.out_of_fold(df, G.as_table(spark, fits, 3)).collect()}
    for m in fits:
        for i in np.flatnonzero(fold == m.fold):
            assert got[int(i)] == pytest.approx(1 / (1 + np.exp(-(m.design(x[i:i + 1]) @ m.beta)[0])))
    assert len(got) == 200


def test_probe_tables(spark):
    x, y, fold = made(4, 300, 3)
    oof, table, models = L.probe_oof(frame(spark, x, y, fold), 3)
    rows = {r["id"]: r for r in oof.collect()}
    p = np.array([rows[i]["p"] for i in range(300)])
    for r in table.collect():
        inside = fold == r["fold"]
        assert r["test_auroc"] == pytest.approx(area(y[inside], p[inside]))
        assert r["train_auroc"] > 0.8 and 0 <= r["single_feature"] <= 1
    ranked = L.rank_coefficients(models).orderBy(F.desc("mean_abs")).collect()
    assert [r["feature"] for r in ranked][:2] == [0, 1]


def test_classifier_tables(spark):
    x, y, fold = made(5, 300, 4, 0.1)
    scored, importance = L.word_classifier(frame(spark, x, y, fold), 3, {"a": [0, 1], "b": [2, 3]}, trees=2, depth=2)
    folds = L.fold_table(scored).collect()
    assert {(r["model"], r["fold"]) for r in folds} == {(m, f) for m in ("full_logistic", "full_boosted", "baseline_a", "baseline_b") for f in range(3)}
    summary = {r["model"]: r for r in L.classifier_summary(scored).collect()}
    for name, r in summary.items():
        own = [f["auroc"] for f in folds if f["model"] == name]
        assert r["auroc_mean"] == pytest.approx(np.mean(own)) and r["auroc_sd"] == pytest.approx(np.std(own, ddof=1)) and r["n_folds"] == 3
    assert summary["full_logistic"]["pooled_auroc"] > summary["baseline_b"]["pooled_auroc"]
    assert {r["feature"] for r in importance.collect()} == {0, 1, 2, 3}
    assert L.best_dimensions(frame(spark, x, y, fold), {"a": [0, 1], "b": [2, 3]})["a"] == 0


def test_layers(spark):
    x, y, fold = made(6, 400, 4)
    df = frame(spark, x, y, fold)
    table, models = L.layer_probes(df, {0: [2, 3], 1: [0, 1], 2: [3]}, 3, [0.01, 1.0])
    rows = {r["layer"]: r for r in table.collect()}
    assert [k for k, r in rows.items() if r["is_best"]] == [1] and rows[1]["test_auroc"] > 0.85
    got = {r["id"]: r for r in L.apply_probes(df, models, 1).collect()}
    held = np.arange(400) % 5 == 0
    p = np.array([got[i]["p"] for i in range(400)])
    assert area(y[held], p[held]) == pytest.approx(rows[1]["test_auroc"])
