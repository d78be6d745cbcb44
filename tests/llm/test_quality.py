import random

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm.quality import BUCKETS, Nbsvm, distinct_ngrams, dual_descent, fit, log_count_ratio, score_quality


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.choice([9, 20, 200]))]
        bad = i % 6 == 0
        if bad:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [y for x in w for y in (x, "|")] if kind == 1 else [x for x in w[:9] for _ in range(6)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    model = fit(docs(rows), spark.createDataFrame([x for x in labels if x[0] % 2 or x[0] % 12 == 0], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in score_quality(docs(rows), model).collect()}
    assert sum(got[i]["predicted"] != y for i, y in labels) <= 6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_scores_equal_a_plain_sum_and_edges(docs):
    rng = np.random.default_rng(5)
    model = Nbsvm(np.where(rng.random(BUCKETS) < 0.5, rng.normal(size=BUCKETS), 0), 0.2, 0.5, -0.1)
    rows = [(1, "One two, TWO two! 33"), (2, None), (3, ""), (4, "  "), (5, "Ö" * 50_000), (6, "x " * 20_000), (7, "a"), (7, "a"), (8, "a b")]
    got = score_quality(docs(rows), model).collect()
    assert len(got) == len(rows)
    for r in got:
        _, b = distinct_ngrams(pa.array([dict(rows)[r["doc_id"]]], pa.string()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(0.5 * (model.weight[b].sum() + 0.2) - 0.1))))


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(6)
    features = [np.unique(rng.integers(0, 6, 3)) for _ in range(60)]
    sign = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    scale = rng.normal(size=6)
    w, b = dual_descent(features, scale, sign, 0.3, passes=500)
    most = 0.3 * 60 / (2 * np.array([(sign < 0).sum(), (sign > 0).sum()]))[(sign > 0).astype(int)]

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(c * max(0, 1 - y * ((w[f] * scale[f]).sum() + b)) for f, y, c in zip(features, sign, most))

    best = loss(w, b)
    assert all(loss(w + d, b + e) >= best - 1e-3 for d, e in zip(rng.normal(0, 0.05, (300, 6)), rng.normal(0, 0.05, 300)))


def test_ratios():
    r = log_count_ratio(np.array([[3, 0], [0, 3]]))
    assert r[0] == pytest.approx(-r[1]) and r[1] > 0


def test_no_labels_and_empty_table(spark, docs):
    model = fit(docs([(1, "a")]), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in score_quality(docs([(1, "a"), (None, None)]), model).collect()] == [0.5, 0.5]
    one = fit(docs([(1, "a")]), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), fold=None)
    assert score_quality(docs([(1, "a")]), one).collect()[0]["score"] == pytest.approx(2 / 3)
    assert score_quality(docs([]), model).count() == 0
