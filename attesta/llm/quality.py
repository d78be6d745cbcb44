"""Quality classifier: naive Bayes support vectors (NBSVM) over n-gram indicators.

Indicators are scaled by the class log-count ratios
r = log((p / |p|) / (q / |q|)); a linear hinge-loss model is fitted on them by
dual coordinate descent and interpolated with the mean weight.  A logistic curve
fitted on margins of rows left out of the fit turns margins into scores.

N-grams: lower-cased words, and runs of 1 to 3 word shapes.  A shape tells case,
digits, the trailing sign and how much of a word is punctuation, and whether it
repeats the word before, so it carries over to words never seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import class_counts, collect_features, distinct_pairs, labelled_sample, sums
from .words import LOWER, mix, small_batches, text_bytes, word_hashes, word_spans

BUCKETS = 1 << 18
UPPER, LETTER, DIGIT, SIGN = (np.zeros(256, np.int64) for _ in range(4))
UPPER[65:91] = LETTER[65:91] = LETTER[97:123] = DIGIT[48:58] = 1
LETTER[128:] = 1
SIGN[33:127] = 1
SIGN[33:127] -= (LETTER + DIGIT)[33:127]


def ngram_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams; pairs may repeat.  A row without words has one feature of its own."""
    data, offsets = text_bytes(column)
    starts, ends, row = word_spans(data, offsets)
    n_rows = len(offsets) - 1
    empty = np.flatnonzero(np.bincount(row, minlength=n_rows) == 0)
    if not len(starts):
        return empty, np.zeros(len(empty), np.int64)
    count = [np.concatenate([[0], np.cumsum(c[data])]) for c in (UPPER, LETTER, DIGIT, SIGN)]
    upper, letter, digit, sign = (c[ends] - c[starts] for c in count)
    words = word_hashes(LOWER[data], starts, ends)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    last = np.where(SIGN[data[ends - 1]] > 0, data[ends - 1], 0).astype(np.int64)
    case = (upper > 0) + (upper > 1) * 1 + ((upper > 1) & (2 * upper > letter)) * 1
    shape = (((case * 2 + (digit > 0)) * 4 + np.minimum(sign, 3)) * 2 + (letter == 0)) * 2 + again
    unit = mix((shape * 256 + last).astype(np.uint64) + np.uint64(977))
    rows, values = [row, row], [words, unit]
    gram = unit
    for n in (2, 3):
        gram = mix(gram[:-1] * np.uint64(3) + unit[n - 1:] + np.uint64(n))
        same = row[n - 1:] == row[:len(gram)]
        rows.append(row[:len(gram)][same])
        values.append(gram[same])
    bucket = (np.concatenate(values) >> np.uint64(46)).astype(np.int64)
    return np.concatenate([*rows, empty]), np.concatenate([bucket, np.zeros(len(empty), np.int64)])


def distinct_ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return distinct_pairs(*ngram_features(column), BUCKETS)


def log_count_ratio(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratios of label 1 against label 0 from (2, buckets) counts."""
    q, p = counts + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(features: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, cost: float, passes: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss (Hsieh et al. 2008); row i holds ``scale`` at ``features[i]``.

    The bias is one more feature of value 1.  A row's loss is weighed so that both classes count alike.
    """
    weight, bias = np.zeros(len(scale)), 0.0
    share = np.array([(sign < 0).sum(), (sign > 0).sum()], float)
    most = cost * len(sign) / (2 * np.maximum(share, 1))[(sign > 0).astype(int)]
    alpha = np.zeros(len(sign))
    norm = np.array([(scale[f] ** 2).sum() + 1 for f in features])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(sign)):
            f, y = features[i], sign[i]
            slope = y * ((weight[f] * scale[f]).sum() + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y
            if step:
                weight[f] += step * scale[f]
                bias += step
                moved = max(moved, abs(slope))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight, bias


@dataclass
class Nbsvm:
    weight: np.ndarray  # on plain indicators, the ratios multiplied in
    bias: float
    slope: float
    shift: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (self.slope * (margin + self.bias) + self.shift)))


def one_fit(features, sign, ratio, cost, blend) -> tuple[np.ndarray, float]:
    weight, bias = dual_descent(features, ratio, sign, cost)
    used = weight != 0
    mean = np.abs(weight[used]).mean() if used.any() else 0.0
    return ((1 - blend) * mean * (ratio != 0) + blend * weight) * ratio, bias


def logistic(margin: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of P(label 1 | margin), by Newton steps."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.zeros(2)
    target = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(50):
        p = 0.5 * (1 + np.tanh(0.5 * (x @ beta)))
        grad = x.T @ (p - target) + ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), grad)
        beta = beta - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text",
        fold: int | None = 2, cost: float = 0.1, blend: float = 0.25, least_rows: int = 8) -> Nbsvm:
    """Fit on at most ``sample_rows`` labelled rows outside ``fold`` (crc32 of the id as text, modulo 4).

    The bound holds for fitting only; scores use whole texts.  N-grams in fewer
    than ``least_rows`` rows of the sample get no weight.  Without both labels in
    the sample every row scores the share of label 1, or 0.5.
    """
    keep = None if fold is None else F.crc32(F.col("_lid").cast("string").cast("binary")) % 4 != fold
    sample = labelled_sample(docs, labels, label, sample_rows, id_col, text_col, keep)
    counts = class_counts(sample, distinct_ngrams, BUCKETS)
    picked = counts.sum(0) >= least_rows
    y, features = collect_features(sample, distinct_ngrams, picked)
    y = np.minimum(np.maximum(y, 0), 1)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return Nbsvm(np.zeros(BUCKETS), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratio = np.where(picked, log_count_ratio(counts), 0.0)
    sign = 2.0 * y - 1
    margin = np.zeros(len(y))
    part = np.arange(len(y)) % 2
    for k in (0, 1):  # margins of rows that the fit hasn't seen
        learn = np.flatnonzero(part != k)
        if 0 < y[learn].sum() < len(learn):
            own = np.zeros((2, BUCKETS))
            for i in learn:
                own[y[i], features[i]] += 1
            w, b = one_fit([features[i] for i in learn], sign[learn], np.where(picked, log_count_ratio(own), 0.0), cost, blend)
            for i in np.flatnonzero(part == k):
                margin[i] = w[features[i]].sum() + b
    slope, shift = logistic(margin, y)
    weight, bias = one_fit(features, sign, ratio, cost, blend)
    return Nbsvm(weight, bias, slope, shift)


def score_quality(docs: DataFrame, model: Nbsvm, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """(id, score, predicted), one row per row of ``docs``: the chance of label 1, and 1 from ``limit`` on.

    Only the text is read.  NULL texts are empty; empty texts are scored by a feature of their own.
    """
    def run(batches):
        for batch in small_batches(batches, "_text"):
            score = model.score(sums(*ngram_features(batch.column(1)), model.weight, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= limit).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
