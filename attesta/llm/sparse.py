"""Sparse indicator features for the trained classifiers: hashed, counted by class, sampled for fitting."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import small_batches

#: An extractor maps a string column to (row, bucket) pairs, distinct, ordered by row.
Extractor = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def distinct_pairs(row: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row.astype(np.int64) * buckets + bucket.astype(np.int64))
    return key // buckets, key % buckets


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str, keep: Column | None = None) -> DataFrame:
    """(label, _text) of at most ``rows`` labelled documents, the ones with the least hash of their id.

    Only these ids and labels are broadcast, so ``rows`` bounds the broadcast.
    """
    known = labels.select(F.col(id_col).alias("_lid"), F.col(label).cast("int").alias("label")).filter("_lid is not null and label is not null")
    if keep is not None:
        known = known.filter(keep)
    chosen = known.groupBy("_lid").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_lid"), "_lid").limit(rows)
    texts = docs.select(F.col(id_col).alias("_lid"), F.col(text_col).cast("string").alias("_text"))
    return texts.join(F.broadcast(chosen), "_lid").select("_lid", "label", "_text")


def collect_features(sample: DataFrame, extract: Extractor, picked: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and bucket lists of a bounded sample, in the order of ids; only ``picked`` buckets."""
    def run(batches):
        for batch in small_batches(batches, "_text"):
            row, bucket = extract(batch.column(2))
            if picked is not None:
                has = picked[bucket]
                row, bucket = row[has], bucket[has]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))], names=["_lid", "label", "features"])

    kind = sample.schema["_lid"].dataType.simpleString()
    table = sample.mapInArrow(run, f"_lid {kind}, label int, features array<int>").toArrow().sort_by("_lid")
    lists = table.column("features").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return table.column("label").to_numpy().astype(np.int64), [flat[a:b].astype(np.int64) for a, b in zip(ends, ends[1:])]


def class_counts(sample: DataFrame, extract: Extractor, buckets: int) -> np.ndarray:
    """(2, buckets): in how many rows of label 0 and 1 each bucket occurs.  At most 2 * ``buckets`` rows reach the driver."""
    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in small_batches(batches, "_text"):
            row, bucket = extract(batch.column(2))
            label = np.minimum(batch.column(1).to_numpy()[row], 1)
            for y in (0, 1):
                total[y] += np.bincount(bucket[label == y], minlength=buckets)
        y, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[y, b])], names=["y", "b", "n"])

    got = sample.mapInArrow(run, "y int, b int, n long").groupBy("y", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, buckets), np.int64)
    out[got.column("y").to_numpy(), got.column("b").to_numpy()] = got.column("n").to_numpy()
    return out


def association(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """G-squared statistic of every bucket against the two classes of ``rows`` rows each; positive where class 1 has more."""
    have = counts + 1e-9
    lack = rows[:, None] - counts + 1e-9
    total = rows.sum()
    share = (rows / total)[:, None]
    g = 2 * (have * np.log(have / ((have.sum(0)) * share)) + lack * np.log(lack / ((lack.sum(0)) * share))).sum(0)
    return np.where(have[1] / max(rows[1], 1) >= have[0] / max(rows[0], 1), g, -g)


def sums(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of the weights of each row's distinct buckets; buckets without weight are passed over before sorting."""
    has = weight[bucket] != 0
    row, bucket = distinct_pairs(row[has], bucket[has], len(weight))
    return np.bincount(row, weights=weight[bucket], minlength=n_rows)
