"""Seeded sampling and folds.

The order is the md5 of seed and id: repeatable on any cluster and any
partitioning.  Its leading digits give evenly filled, order-preserving buckets,
so even one huge group is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import with_scalar
from .ordered import with_position


def hashed(df: DataFrame, seed: str, idc: str) -> DataFrame:
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(idc).cast("string"))))


def hash_bucket() -> Column:
    return F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")


def capped(df: DataFrame, by: list[str], idc: str, cap: int, seed: str) -> DataFrame:
    """At most ``cap`` rows per group in hash order, with their rank ``_r``.

    The constant bound lets Spark drop the rest before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy("_h", idc)
    return hashed(df, seed, idc).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_h")


def sample_balanced(df: DataFrame, group: str, label: str, idc: str, cap: int, seed: str) -> DataFrame:
    """min(cap, positives, negatives) rows of each class per group."""
    counts = df.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    quota = counts.select(group, F.least("_p", "_q").alias("_n")).filter("_n > 0")
    return capped(df, [group, label], idc, cap, seed).join(quota, group).filter("_r <= _n").select(*df.columns)


def sample_per_category(df: DataFrame, by: list[str], idc: str, cap: int, seed: str) -> DataFrame:
    return capped(df, by, idc, cap, seed).select(*df.columns)


def placebo(selected: DataFrame, cells: DataFrame, layer: str, idc: str, seed: str) -> DataFrame:
    """As many cells per layer outside the selection; too small layers skipped."""
    quota = selected.groupBy(layer).agg(F.count(F.lit(1)).alias("_n"))
    rest = cells.join(selected.select(idc), idc, "left_anti")
    enough = rest.groupBy(layer).agg(F.count(F.lit(1)).alias("_have")).join(quota, layer).filter("_have >= _n").select(layer, "_n")
    ranked = with_position(hashed(rest.join(enough, layer), seed, idc), [layer], ["_h", idc], hash_bucket())
    return ranked.filter("pos < _n").select(*cells.columns)


def placebo_layers(flagged: DataFrame, layers: DataFrame, layer: str, seed: str) -> DataFrame:
    """One hashed choice per flagged layer among the layers without a flag."""
    free = hashed(layers.join(flagged, layer, "left_anti"), seed, layer)
    n = flagged.select(layer).distinct().agg(F.count(F.lit(1)).alias("_n"))
    return with_scalar(with_position(free, [], ["_h", layer], hash_bucket()), n).filter("pos < _n").select(layer)


def sample_n(df: DataFrame, idc: str, n: int, seed: str) -> DataFrame:
    """n rows in hash order, reported in their original order."""
    return hashed(df, seed, idc).orderBy("_h", idc).limit(n).drop("_h").orderBy(idc)


def group_folds(df: DataFrame, group: str, y: str, k: int, seed: str) -> DataFrame:
    """(group, fold) with whole groups in one fold.

    Groups with and without positives are dealt out separately in hash order,
    so every fold gets its share of both.
    """
    g = df.groupBy(group).agg(F.max((F.col(y) == 1).cast("int")).alias("_pos"), F.max((F.col(y) == 0).cast("int")).alias("_neg"))
    size = g.agg(F.least(F.lit(k), F.sum("_pos"), F.sum("_neg")).cast("int").alias("_k"))
    dealt = with_position(hashed(g, seed, group), ["_pos"], ["_h", group], hash_bucket())
    return with_scalar(dealt, size).filter("_k >= 2").select(group, (F.col("pos") % F.col("_k")).alias("fold"))


def leave_n_out(df: DataFrame, group: str, n: int, seed: str) -> DataFrame:
    """(group, fold): permuted groups, n per fold."""
    g = hashed(df.select(group).distinct(), seed, group)
    return with_position(g, [], ["_h", group], hash_bucket()).select(group, F.floor(F.col("pos") / n).alias("fold"))


def holdout_last(df: DataFrame, sample: str, fraction: float) -> DataFrame:
    """Mark the last max(1, ceil(n * fraction)) samples as the test set."""
    ids = df.select(sample).distinct()
    placed = with_position(ids, [], [sample])
    n = placed.agg(F.count(F.lit(1)).alias("_n")).select("_n", F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction)).alias("_t"))
    marked = with_scalar(placed, n).select(sample, (F.col("pos") >= F.col("_n") - F.col("_t")).alias("is_test"))
    return df.join(marked, sample)
