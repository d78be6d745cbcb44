import random

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm.toxicity import BUCKETS, Ordinal, distinct_word_features, drop_toxic, fit, fit_ordinal, severity



def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.choice([3, 20, 200]))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["Zounds!", "ZORK", "quuxlet" + rng.choice("abcdefgh"), "quux" + rng.choice("xyz")]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_words_and_beginnings(spark, docs):
    rows, labels = corpus()
    model = fit(docs(rows), spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in severity(docs(rows), model).collect()}
    wrong = sum(got[i]["kept"] == bool(y) for i, y in labels if i % 2 == 0)
    assert len(got) == len(rows) and wrong <= 6
    kept = {r["doc_id"] for r in drop_toxic(docs(rows), model).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}
    assert all(0 <= r["expected_severity"] <= 3 and np.isclose(r["expected_severity"] >= 0.5, not r["kept"]) for r in got.values())
    hit = [i for i, y in labels if y]
    assert max(got[i]["grade"] for i in hit) == 3


def test_scores_equal_a_plain_sum(docs):
    rows, _ = corpus(40)
    rng = np.random.default_rng(3)
    model = Ordinal(np.where(rng.random(BUCKETS) < 0.3, rng.normal(size=BUCKETS), 0), np.array([-1.0, 0.5, 2.0]))
    rows += [(40, None), (41, ""), (42, "ä" * 40_000), (43, "one"), (43, "one"), (None, "one")]
    for r in severity(docs(rows), model).filter("doc_id is not null").collect():
        _, bucket = distinct_word_features(pa.array([dict(rows)[r["doc_id"]]], pa.string()))
        z = model.weight[bucket].sum()
        assert r["expected_severity"] == pytest.approx(sum(1 / (1 + np.exp(t - z)) for t in model.threshold))


def test_ordinal_fit_orders_grades_and_handles_missing_ones():
    rng = np.random.default_rng(4)
    grade = rng.integers(0, 4, 800)
    features = [np.array([0] * (g >= 1) + [1] * (g >= 2) + [2] * (g >= 3) + [int(rng.integers(3, 30))]) for g in grade.tolist()]
    m = fit_ordinal(features, grade, 4, 32)
    assert (np.diff(m.threshold) > 0).all()
    means = [m.expected(np.array([m.weight[f].sum() for f, g in zip(features, grade.tolist()) if g == k])).mean() for k in range(4)]
    assert np.allclose(means, [0, 1, 2, 3], atol=0.25)
    gap = fit_ordinal(features, np.where(grade > 1, 3, 0), 4, 32)
    assert (np.diff(gap.threshold) > 0).all() and np.isfinite(gap.weight).all()


def test_no_labels_one_class_and_empty_table(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(docs([(1, "a")]), none)
    assert [r["kept"] for r in severity(docs([(1, "a"), (None, None)]), model).collect()] == [True, True]
    clean = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert [r["kept"] for r in severity(docs([(1, "a")]), fit(docs([(1, "a")]), clean)).collect()] == [True]
    assert severity(docs([]), model).count() == 0
