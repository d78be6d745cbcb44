"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

The model has one weight per feature, shared by all thresholds:
P(grade <= k | x) = sigmoid(threshold_k - w.x), thresholds ascending.  Its output
is the expected grade, the sum of P(grade > k).

Features are the distinct words of a text and the beginnings of its words (3 to
6 letters), hashed; those that a G-squared test ties to toxic rows are kept.
The labels only say toxic or not, so the grades of toxic rows are formed from
the sample: grade 1, 2 or 3 by the thirds of the number of kept features that
they hold.  Grade 0 is a row that isn't toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import SEPARATOR, lower_bytes
from .sparse import association, class_counts, collect_features, distinct_pairs, labelled_sample, sums
from .words import IS_SPACE, mix, rolling, small_batches, span_hashes, word_spans

BUCKETS = 1 << 18
BEGINNINGS = (3, 4, 5, 6)


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of words and word beginnings (in bytes of the lower-cased text); pairs may repeat."""
    data, offsets = lower_bytes(column)
    flat = np.where(SEPARATOR[data] & ~IS_SPACE[data], np.uint8(32), data)
    starts, ends, row = word_spans(flat, offsets)
    rolled = rolling(flat)
    rows, values = [row], [span_hashes(rolled, starts, ends)]
    for n in BEGINNINGS:
        long = ends - starts > n
        rows.append(row[long])
        values.append(mix(span_hashes(rolled, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(values) >> np.uint64(46)).astype(np.int64)


def distinct_word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return distinct_pairs(*word_features(column), BUCKETS)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    """Weights and ascending thresholds of a fitted model."""

    weight: np.ndarray
    threshold: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """(rows, thresholds): P(grade > k)."""
        return sigmoid(score[:, None] - self.threshold)

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.above(score).sum(1)


def fit_ordinal(features: list[np.ndarray], grade: np.ndarray, grades: int, buckets: int, ridge: float = 0.3, steps: int = 400) -> Ordinal:
    """Maximum likelihood with a ridge on the weights, by Adam over the whole sample.

    Thresholds are a first value and positive steps, so they stay ascending.
    Grades may be missing from the sample; an empty sample gives grade 0.
    """
    n = len(grade)
    if not n:
        return Ordinal(np.zeros(buckets), np.linspace(8, 9, grades - 1))
    used = np.unique(np.concatenate(features)) if features else np.zeros(0, np.int64)
    column = np.searchsorted(used, np.concatenate(features)).astype(np.int64)
    row = np.repeat(np.arange(n), [len(f) for f in features])
    share = np.array([(grade <= k).sum() + 0.5 for k in range(grades - 1)]) / (n + 1)
    start = np.log(share / (1 - share))
    param = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    first, second = np.zeros_like(param), np.zeros_like(param)
    at = np.arange(n)
    for t in range(1, steps + 1):
        w, cut, gap = param[:len(used)], param[len(used)], np.exp(param[len(used) + 1:])
        threshold = np.concatenate([[cut], cut + np.cumsum(gap)])
        score = np.bincount(row, weights=w[column], minlength=n)
        below = np.concatenate([np.zeros((n, 1)), sigmoid(threshold - score[:, None]), np.ones((n, 1))], axis=1)
        slope = below * (1 - below)
        chance = np.maximum(below[at, grade + 1] - below[at, grade], 1e-12)
        high, low = slope[at, grade + 1] / chance, slope[at, grade] / chance
        g_score = high - low  # of the negative log-likelihood
        g_threshold = np.zeros(grades + 1)
        np.add.at(g_threshold, grade + 1, -high)
        np.add.at(g_threshold, grade, low)
        g_threshold = g_threshold[1:-1]
        tail = np.cumsum(g_threshold[::-1])[::-1]
        grad = np.concatenate([np.bincount(column, weights=g_score[row], minlength=len(used)) + ridge * w, tail[:1], tail[1:] * gap])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        param = param - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weight = np.zeros(buckets)
    weight[used] = param[:len(used)]
    cut, gap = param[len(used)], np.exp(param[len(used) + 1:])
    return Ordinal(weight, np.concatenate([[cut], cut + np.cumsum(gap)]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
        least: float = 30.0) -> Ordinal:
    """Fit on at most ``sample_rows`` labelled rows (a documented bound; everything scored is scored on its whole text)."""
    sample = labelled_sample(docs, labels, label, sample_rows, id_col, text_col)
    counts = class_counts(sample, distinct_word_features, BUCKETS)
    y = sample.groupBy("label").count().collect()
    rows = np.array([sum(r["count"] for r in y if r["label"] <= 0), sum(r["count"] for r in y if r["label"] > 0)], float)
    picked = association(counts, rows) >= least if rows.all() else np.zeros(BUCKETS, bool)
    toxic, features = collect_features(sample, distinct_word_features, picked)
    held = np.array([len(f) for f in features], np.int64)
    grade = np.zeros(len(toxic), np.int64)
    if (toxic > 0).any():
        low, high = np.quantile(held[toxic > 0], [1 / 3, 2 / 3])
        grade = np.where(toxic > 0, 1 + (held > low).astype(np.int64) + (held > high), 0)
    return fit_ordinal(features, grade, 4, BUCKETS)


def severity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """(id, expected_severity, p_toxic, grade, kept), one row per row of ``docs``.

    ``grade`` is the likeliest grade.  A row is rejected (``kept`` false) from
    an expected severity of ``limit`` on.  NULL and empty texts have no features;
    repeated rows and NULL ids are rows like others; other columns aren't read.
    """
    def run(batches):
        for batch in small_batches(batches, "_text"):
            above = model.above(sums(*word_features(batch.column(1)), model.weight, batch.num_rows))
            chance = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1))
            expected = above.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(above[:, 0]), pa.array(chance.argmax(1), pa.int32()), pa.array(expected < limit)],
                                             names=[id_col, "expected_severity", "p_toxic", "grade", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, expected_severity double, p_toxic double, grade int, kept boolean")


def drop_toxic(docs: DataFrame, model: Ordinal, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that ``severity`` rejects; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in small_batches(batches, text_col):
            score = sums(*word_features(batch.column(at)), model.weight, batch.num_rows)
            yield batch.filter(pa.array(model.expected(score) < limit))

    return docs.mapInArrow(run, docs.schema)
