"""Penalised logistic regression: all models and folds in one pass per Newton step.

A model is a choice of dimensions and of C, fitted once for every fold on the
rows outside it (fold -1: on all rows).  Each pass sums gradients, Hessians and
losses of all of them in the tasks; a task sends one row per model, the driver
solves systems of the size of a model.  So the number of Spark jobs is the
number of Newton steps, whatever the number of models, folds and values of C.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut

MODELS = "model string, fold int, c double, n_train long, intercept double, weights array<struct<feature:int,coef:double,a:double,center:double>>"


@dataclass
class Model:
    """One fit: minimises |b|^2 / 2 + C sum(w loss), the intercept free, classes weighted to equal sums."""

    name: str
    fold: int
    dims: list[int]
    c: float
    center: np.ndarray = field(default=None, repr=False)
    scale: np.ndarray = field(default=None, repr=False)
    weight: tuple = (0.0, 0.0)
    n: int = 0
    beta: np.ndarray = field(default=None, repr=False)
    step: np.ndarray = field(default=None, repr=False)
    loss: float = np.inf
    done: bool = False

    def design(self, x: np.ndarray) -> np.ndarray:
        """Rows with missing values at the mean, standardised, and a one."""
        part = (np.where(np.isnan(x[:, self.dims]), self.center, x[:, self.dims]) - self.center) / self.scale
        return np.concatenate([part, np.ones((len(x), 1))], axis=1)

    def sums(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Loss, gradient and Hessian of the rows outside the fold, in one vector."""
        mine = fold != self.fold
        z, y = self.design(x[mine]), y[mine]
        w = np.where(y == 1, self.weight[1], self.weight[0]) * self.c
        t = z @ self.beta
        p = 1 / (1 + np.exp(-np.clip(t, -500, 500)))
        loss = float((w * (np.logaddexp(0, t) - y * t)).sum())
        return np.concatenate([[loss], z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

    def move(self, sums: np.ndarray, tolerance: float) -> None:
        """A Newton step; half of the last one is taken back where it raised the loss."""
        size = len(self.beta)
        flat = np.append(np.ones(size - 1), 0.0)
        loss = sums[0] + 0.5 * float((flat * self.beta**2).sum())
        if self.step is not None and loss > self.loss * (1 + 1e-12) + 1e-12:
            self.step = self.step / 2
            self.beta = self.beta - self.step
            self.done = bool(np.abs(self.step).max() < tolerance)
            return
        self.loss = loss
        gradient = sums[1:size + 1] + flat * self.beta
        hessian = sums[size + 1:].reshape(size, size) + np.diag(flat) + 1e-12 * np.eye(size)
        self.step = -np.linalg.solve(hessian, gradient)
        self.beta = self.beta + self.step
        self.done = bool(np.abs(self.step).max() < tolerance)


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of one length as a matrix; NULL elements are NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def passes(rows: DataFrame, count: int, each) -> list[np.ndarray | None]:
    """Item ``i`` of the answer: the sum over all rows of ``each(x, y, fold)[i]``; a task sends one vector per ``i``."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y, fold = (batch.column(i).cast(pa.float64()).to_numpy() for i in (1, 2))
                new = each(matrix(batch.column(0)), y, fold)
                total = new if total is None else [a + b for a, b in zip(total, new)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array([t.tolist() for t in total], pa.list_(pa.float64()))})

    def add(table):
        return pa.table({"i": table.column("i").slice(0, 1), "v": pa.array([matrix(table.column("v").combine_chunks()).sum(0).tolist()], pa.list_(pa.float64()))})

    found = rows.select("x", "y", "fold").mapInArrow(run, "i int, v array<double>").groupBy("i").applyInArrow(add, "i int, v array<double>").toArrow()
    out = dict(zip(found.column("i").to_pylist(), found.column("v").to_pylist()))
    return [np.array(out[i]) if i in out else None for i in range(count)]


def fit_all(df: DataFrame, k: int, specs: dict[str, tuple[list[int], float]], folds: list[int] | None = None, standardise: bool = True,
            tolerance: float = 1e-8, most: int = 60) -> list[Model]:
    """Models of every spec (dimensions, C) and fold; where a fold's training rows have one class only, none.

    ``df`` has y (0 or 1), fold (0 to k - 1) and an array x of one length, whose
    missing elements take the mean of the training rows.  Rows with a NULL
    label, fold or vector take no part.  Without ``standardise`` values are only
    centred, which the free intercept makes up for.
    """
    rows = cut(df.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold")).dropna())

    def moments(x, y, fold):
        here = ~np.isnan(x)
        flat = np.where(here, x, 0.0)
        return [np.concatenate([[m.sum(), y[m].sum()], here[m].sum(0), flat[m].sum(0), (flat[m]**2).sum(0)]) for m in (fold == f for f in range(k))]

    parts = passes(rows, k, moments)
    if all(p is None for p in parts):
        return []
    size = max(len(p) for p in parts if p is not None)
    parts = np.stack([np.zeros(size) if p is None else p for p in parts])
    models = []
    for name, (dims, c) in specs.items():
        for f in range(k) if folds is None else folds:
            n, pos, *rest = parts.sum(0) - (parts[f] if f >= 0 else 0)
            count, total, square = np.array(rest).reshape(3, -1)[:, dims]
            if not 0 < pos < n:
                continue
            center = total / np.maximum(count, 1)
            spread = np.sqrt(np.maximum(square - count * center**2, 0) / n)
            scale = np.where(spread > 1e-12, spread, 1.0) if standardise else np.ones(len(dims))
            models.append(Model(name, f, list(dims), c, center, scale, (n / (2 * (n - pos)), n / (2 * pos)), int(n), np.zeros(len(dims) + 1)))
    for _ in range(most):
        open_ = [m for m in models if not m.done]
        if not open_:
            break
        for m, s in zip(open_, passes(rows, len(open_), lambda x, y, fold: [m.sums(x, y, fold) for m in open_])):
            m.move(s, tolerance)
    return models


def as_table(spark, models: list[Model], width: int) -> DataFrame:
    """One row per fitted model; a weight per dimension, NULL coefficient where the model does not use it."""
    rows = []
    for m in models:
        weights = [(i, None, 0.0, 0.0) for i in range(width)]
        for i, b, center, scale in zip(m.dims, m.beta[:-1], m.center, m.scale):
            weights[i] = (i, float(b), float(b / scale), float(center))
        rows.append((m.name, m.fold, float(m.c), m.n, float(m.beta[-1]), weights))
    return spark.createDataFrame(rows, MODELS)


def probability(x: Column, intercept: Column, weights: Column) -> Column:
    """What a row of the model table says about an array of values."""
    terms = F.zip_with(x, weights, lambda v, w: w["a"] * (F.coalesce(F.nanvl(v.cast("double"), F.lit(None)), w["center"]) - w["center"]))
    return 1 / (1 + F.exp(-F.aggregate(terms, intercept, lambda s, t: s + t)))


def apply_models(df: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with model and p for every row of the model table that shares its ``keys``."""
    table = models.select("model", "intercept", "weights", *[c for c in ("fold", "c") if c in keys])
    return df.join(table, keys).withColumn("p", probability(F.col("x"), F.col("intercept"), F.col("weights"))).drop("intercept", "weights")


def other_folds(df: DataFrame, k: int) -> DataFrame:
    """Every row once for each fold it is not in: the training rows of all folds."""
    return df.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))))
