import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm.pitman_yor import Hierarchy, predictions, score_texts, seat

RNG = np.random.default_rng(2)


def uniform(live, step):
    return RNG.random(len(live))


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.choice([1, 5, 40, 120])):
            words.append(rng.choice(["the", "Of", "and"]) if words and words[-1] == "in" or rng.random() < 0.3 else rng.choice(["in", vocabulary[int(4000 * rng.random() ** 3)]]))
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n "), (n + 3, "Überall über\tALL  été"), (n + 4, "word " * 20_000), (n + 5, "same"), (n + 5, "same")]


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def test_counts_and_base_equal_brute_force_and_the_model_is_better(docs):
    rows = corpus()
    train = [t for i, t in rows if i % 10]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = score_texts(docs(rows), F.col("doc_id") % 10 != 0).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        w = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    held = [r for r in got if r["doc_id"] % 10 == 0]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = score_texts(docs(rows[::-1]).repartition(5), F.col("doc_id") % 10 != 0).collect()
    assert sorted(round(r["score"], 6) for r in again) == sorted(round(r["score"], 6) for r in got)


def test_probabilities_follow_counts(docs):
    train = [(0, "a b c a"), (1, "b a"), (2, "")]
    probe = [(10 + i, w) for i, w in enumerate(["a", "b", "c", "never"])] + [(20, "")]
    got = {r["doc_id"]: 10 ** r["score"] for r in score_texts(docs(train + probe), F.col("doc_id") < 3).collect()}
    assert all(0 < p < 1 for p in got.values()) and got[10] > got[12] > 0 and got[12] > got[13]


def test_seating_against_sequential_customers():
    n, base, d, s = 400, 0.3, 0.6, 1.0
    rng = random.Random(1)

    def one(c):
        t = 1
        for j in range(1, c):
            fresh = (s + d * (5 + t)) * base
            t += rng.random() < fresh / (fresh + j - d * t)
        return t

    for c in (1, 2, 7, 60, 500):
        want = np.mean([one(c) for _ in range(n)])
        got = seat(np.full(n, c), np.full(n, base), np.full(n, 5), d, s, uniform)
        assert abs(got.mean() - want) <= 0.15 * want and (got >= 1).all() and (got <= c).all()
    assert seat(np.array([0, 3]), np.array([0.5, 0.5]), np.zeros(2), d, s, uniform)[0] == 0


def test_predictions_sum_to_one_at_every_level():
    count = RNG.integers(0, 4, (12, 7)) * RNG.integers(0, 2, (12, 7))
    tree = Hierarchy([1, 3, 12], 7)
    for _ in range(5):
        now = tree.sample(count, np.random.default_rng(1))
        assert np.allclose(now.sum(1), 1) and (now > 0).all()
        assert all((t <= 10**6).all() and (t >= 0).all() for t in tree.tables)
        assert ((tree.tables[2] > 0) == (count > 0)).all() and (tree.tables[2] <= count).all()
    assert np.allclose(predictions(np.zeros((1, 4)), np.zeros((1, 4)), np.full((1, 4), 0.25), 0.6, 1.0), 0.25)


def test_no_training_rows_and_empty_table(docs):
    got = score_texts(docs([(1, "a b"), (None, "c")]), F.lit(False)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(3, 0, 0), (2, 0, 0)} and all(math.isfinite(r["score"]) for r in got)
    assert score_texts(docs([]), F.lit(True)).count() == 0
