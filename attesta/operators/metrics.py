"""Ranking quality, effect sizes and other statistics.

Everything ranking-like starts from a histogram (distinct score -> positives,
negatives), which combines on the map side, and uses bucketed running sums, so
no window ever holds a whole group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import cut
from .ordered import UP, running_sums, value_bucket, with_position

ONE = "_one"


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row."""
    return df.withColumn(ONE, F.lit(1)).join(F.broadcast(scalar.limit(1).withColumn(ONE, F.lit(1))), ONE).drop(ONE)


def histogram(df: DataFrame, by: list[str], y: str, score: str, weight: str | None = None) -> DataFrame:
    """(by, score, pos, neg) over rows with a label and a finite score."""
    w = F.col(weight) if weight else F.lit(1)
    ok = F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    return df.filter(ok).groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("neg"))


def auroc(hist: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """AUROC with half credit for ties; NULL below ``least`` rows of a class.

    Inside a bucket the window counts the negatives below; across buckets only
    the totals are needed, so the rows are never joined back.
    """
    inner = Window.partitionBy(*by, "_b").orderBy("score").rowsBetween(UP, 0)
    below = F.sum("neg").over(inner) - F.col("neg") / 2
    cells = hist.withColumn("_b", value_bucket(F.col("score"))).withColumn("_below", below) \
        .groupBy(*by, "_b").agg(F.sum(F.col("pos") * F.col("_below")).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(UP, -1)
    sums = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).groupBy(*by).agg(
        F.sum(F.col("_u") + F.col("_p").cast("double") * F.col("_before")).alias("_u"),
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    enough = (F.col("n_pos") >= least) & (F.col("n_neg") >= least)
    return sums.select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos",
                       F.when(enough, F.col("_u") / (p * n)).alias("auroc"))


def one_against_rest(counts: DataFrame, by: list[str], target: str, score: str, c: str) -> DataFrame:
    """(by, target, auroc): every target against all others, from (by, target, score, c) counts.

    The negatives of a target below a score are all rows below it less the
    target's own, so two running sums suffice and no score meets every target.
    """
    counts = cut(counts.select(*by, target, F.col(score).cast("double").alias("_s"), F.col(c).alias("_c")))
    own = running_sums(counts, [*by, target], ["_s"], {"_t": F.col("_c")})
    every = running_sums(counts.groupBy(*by, "_s").agg(F.sum("_c").alias("_e")), by, ["_s"], {"_a": F.col("_e")})
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    below = (F.col("_a") - F.col("_e") / 2) - (F.col("_t") - F.col("_c") / 2)
    u = own.join(every, [*by, "_s"]).groupBy(*by, target).agg(F.sum(F.col("_c") * below).alias("_u"), F.sum("_c").alias("_p"))
    rest = F.col("_n") - F.col("_p")
    return u.join(total, by).select(*by, target, F.try_divide(F.col("_u"), F.col("_p").cast("double") * rest).alias("auroc"))


def curve(hist: DataFrame, by: list[str]) -> DataFrame:
    """Cumulated true and false positives from the highest score downwards."""
    return running_sums(hist, by, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, -value_bucket(F.col("score")))


def average_precision(hist: DataFrame, by: list[str]) -> DataFrame:
    """Sum of (R_n - R_{n-1}) P_n over the distinct thresholds."""
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    out = curve(hist, by).groupBy(*by).agg(F.sum(step).alias("_s"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return out.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_s") / F.col("_p")).alias("auprc"))


def roc_points(hist: DataFrame, by: list[str]) -> DataFrame:
    total = hist.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    both = curve(hist, by).join(total, by) if by else with_scalar(curve(hist, by), total)
    return both.select(*by, "score", F.try_divide("tp", "_p").alias("tpr"), F.try_divide("fp", "_n").alias("fpr"),
                       (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def with_combined(hist: DataFrame, dataset: str, name: str = "All") -> DataFrame:
    """The histogram of every data set and of all of them together."""
    each = hist.withColumn(dataset, F.explode(F.array(F.col(dataset), F.lit(name))))
    return each.groupBy(dataset, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def typed_histogram(df: DataFrame, by: list[str], kind: str, baseline: str, score: str, kinds: list[str], any_name: str = "any") -> DataFrame:
    """Histogram of every error type against the common baseline rows."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(kind).alias("_k"), F.col(score).cast("double").alias("score")) \
        .agg(F.count(F.lit(1)).alias("_c"))
    targets = F.when(F.col("_k") == baseline, F.array(*[F.lit(k) for k in [*kinds, any_name]])) \
        .when(F.col("_k").isin(kinds), F.array(F.col("_k"), F.lit(any_name)))
    return counts.select(*by, F.explode(targets).alias("target"), "score", (F.col("_k") != baseline).alias("_pos"), "_c") \
        .groupBy(*by, "target", "score").agg(F.sum(F.when(F.col("_pos"), F.col("_c")).otherwise(0)).alias("pos"),
                                             F.sum(F.when(F.col("_pos"), 0).otherwise(F.col("_c"))).alias("neg"))


def cohens_d(df: DataFrame, by: list[str], y: str, x: str, ddof: int = 1, eps: float = 1e-10, flat_is_zero: bool = False) -> DataFrame:
    """Standardised difference of means; NULL when a class has one row."""
    var = F.var_samp if ddof == 1 else F.var_pop
    one, zero = F.when(F.col(y) == 1, F.col(x)), F.when(F.col(y) == 0, F.col(x))
    s = df.groupBy(*by).agg(F.avg(one).alias("_m1"), F.avg(zero).alias("_m0"), var(one).alias("_v1"), var(zero).alias("_v0"),
                            F.count(one).alias("n1"), F.count(zero).alias("n0"))
    n1, n0 = F.col("n1"), F.col("n0")
    pooled = F.sqrt(((n1 - 1) * F.col("_v1") + (n0 - 1) * F.col("_v0")) / (n1 + n0 - 2))
    d = (F.col("_m1") - F.col("_m0")) / (pooled + eps)
    if flat_is_zero:
        d = F.when(pooled == 0, 0.0).otherwise((F.col("_m1") - F.col("_m0")) / pooled)
    return s.select(*by, "n1", "n0", F.when((n1 >= 2) & (n0 >= 2), d).alias("d"))


def moments(df: DataFrame, by: list[str], y: str, x: Column) -> DataFrame:
    """n, sum and sum of squares per class: mergeable, see the streaming part."""
    def part(v):
        z = F.when(F.col(y) == v, x)
        return [F.count(z).alias(f"n{v}"), F.sum(z).alias(f"s{v}"), F.sum(z * z).alias(f"q{v}")]

    return df.groupBy(*by).agg(*part(1), *part(0))


def d_from_moments(m: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    def mean(v):
        return F.col(f"s{v}") / F.col(f"n{v}")

    def var(v):
        return (F.col(f"q{v}") - F.col(f"s{v}") * F.col(f"s{v}") / F.col(f"n{v}")) / (F.col(f"n{v}") - 1)

    n1, n0 = F.col("n1"), F.col("n0")
    enough = (n1 >= least) & (n0 >= least)
    pooled = F.sqrt(((n1 - 1) * var(1) + (n0 - 1) * var(0)) / (n1 + n0 - 2))
    return m.select(*by, "n1", "n0", F.when(enough, F.try_divide(mean(1) - mean(0), pooled)).alias("d"))


def select_top_fraction(df: DataFrame, idc: str, score: str, fraction: float, keep_ties: bool = False) -> DataFrame:
    """The round(fraction * rows) rows with the largest |score|; NULL never.

    The cut is found on the histogram of |score|; only rows that share the cut
    value are ordered, by id, in buckets.
    """
    total = df.agg(F.bround(F.count(F.lit(1)) * F.lit(fraction)).cast("bigint").alias("_k"))
    rows = df.filter(F.col(score).isNotNull()).withColumn("_a", F.abs(score))
    hist = rows.groupBy("_a").agg(F.count(F.lit(1)).alias("_c"))
    upto = running_sums(hist, [], [F.desc("_a")], {"_upto": F.col("_c")}, -value_bucket(F.col("_a")))
    edge = with_scalar(upto, total).withColumn("_left", F.col("_k") - (F.col("_upto") - F.col("_c"))).filter("_left > 0") \
        .select("_a", "_c", "_left")
    chosen = rows.join(edge, "_a")
    if keep_ties:
        return chosen.select(*df.columns)
    whole = chosen.filter("_c <= _left").select(*df.columns)
    part = with_position(chosen.filter("_c > _left"), [], [idc], name="_p").filter("_p < _left").select(*df.columns)
    return whole.unionByName(part)


def correlations(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """(x, y, n, r, t) of every pair in one pass; no variance gives r = 0."""
    cells = []
    aggs = []
    for x in xs:
        for y in ys:
            both = F.col(x).isNotNull() & F.col(y).isNotNull()
            aggs += [F.corr(x, y).alias(f"r_{x}_{y}"), F.count_if(both).alias(f"n_{x}_{y}")]
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"n_{x}_{y}").alias("n"), F.col(f"r_{x}_{y}").alias("r")))
    long = df.agg(*aggs).select(F.inline(F.array(*cells)))
    r = F.coalesce(F.nanvl(F.col("r"), F.lit(None)), F.lit(0.0))
    return long.filter("n >= 3").withColumn("r", r).withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r") * F.col("r"))))


def beta_tail():
    """Regularised incomplete beta I_x(a, b), for p-values of small results."""
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        import math

        def fraction(p, q, z):
            # continued fraction, modified Lentz evaluation
            tiny = 1e-300
            c, d = 1.0, 1.0 - (p + q) * z / (p + 1.0)
            d = 1.0 / (d if abs(d) > tiny else tiny)
            h = d
            for m in range(1, 400):
                for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                    d = 1.0 + num * d
                    d = 1.0 / (d if abs(d) > tiny else tiny)
                    c = 1.0 + num / c
                    c = c if abs(c) > tiny else tiny
                    h *= d * c
                if abs(d * c - 1.0) < 1e-15:
                    break
            return h

        def one(p, q, z):
            if pd.isna(z):
                return None
            if z <= 0.0 or z >= 1.0:
                return float(z >= 1.0)
            front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(z) + q * math.log1p(-z))
            if z < (p + 1.0) / (p + q + 2.0):
                return front * fraction(p, q, z) / p
            return 1.0 - front * fraction(q, p, 1.0 - z) / q

        return pd.Series([one(*v) for v in zip(a, b, x)], dtype="float64")

    return tail


def t_p_value(t: Column, dof: Column) -> Column:
    d = dof.cast("double")
    return beta_tail()(d / 2, F.lit(0.5), d / (d + t * t))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    a, b = d1.cast("double"), d2.cast("double")
    return beta_tail()(b / 2, a / 2, b / (b + a * f))


def top_layers(layers: DataFrame, layer: str, effect: str, k: int) -> DataFrame:
    """The k most positive and the k most negative layers of a small table."""
    pos = layers.filter(F.col(effect) > 0).orderBy(F.desc(effect), layer).limit(k).withColumn("side", F.lit("positive"))
    neg = layers.filter(F.col(effect) < 0).orderBy(effect, layer).limit(k).withColumn("side", F.lit("negative"))
    return pos.unionByName(neg)


def youden(hist: DataFrame, layer: str, least: float = 0.05) -> DataFrame:
    """Operating threshold per layer: largest TPR - FPR in the better direction."""
    quality = auroc(hist, [layer]).filter("auroc is not null").select(layer, "auroc", F.when(F.col("auroc") >= 0.5, 1).otherwise(-1).alias("direction"))
    turned = hist.join(quality, layer).withColumn("score", F.col("score") * F.col("direction"))
    total = hist.groupBy(layer).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    points = curve(turned.select(layer, "score", "pos", "neg"), [layer]).join(total, layer) \
        .withColumn("j", F.round(F.col("tp") / F.col("_p") - F.col("fp") / F.col("_n"), 12))
    best = points.groupBy(layer).agg(F.max_by("score", F.struct("j", "score")).alias("_t"), F.max("j").alias("j"))
    return best.filter(F.col("j") >= least).join(quality, layer).select(
        layer, (F.col("_t") * F.col("direction")).alias("threshold"), "direction",
        F.greatest(F.col("auroc"), 1 - F.col("auroc")).alias("auroc"), "j")


def soft_vote(tokens: DataFrame, thresholds: DataFrame, token: str, layer: str, score: str, k: int) -> DataFrame:
    """Weighted share of the k best layers that flag a token."""
    best = thresholds.orderBy(F.desc("j"), layer).limit(k).withColumn("_w", F.col("auroc") - 0.5)
    flag = F.when(F.col("direction") == -1, F.col(score) < F.col("threshold")).otherwise(F.col(score) > F.col("threshold"))
    return tokens.join(F.broadcast(best), layer).groupBy(token).agg(
        (F.sum(F.when(flag, F.col("_w")).otherwise(0.0)) / (F.sum("_w") + 1e-8)).alias("_v")) \
        .select(token, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_v")).alias("vote"))


def anova(df: DataFrame, group: str, x: Column, least: int = 3) -> DataFrame:
    """One-way F and eta squared from one pass of moments."""
    g = df.groupBy(group).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).filter(F.col("n") >= least)
    t = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
              F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("b")
    return t.filter("k >= 2").select(
        "k", "n", ((between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k")))).alias("f"),
        (between / (between + within)).alias("eta2"))


def deviations(df: DataFrame, unit: str, section: str, x: Column) -> DataFrame:
    """Mean of a unit's section minus the mean of all rows of the section."""
    per = df.groupBy(unit, section).agg(F.avg(x).alias("_m"))
    overall = df.groupBy(section).agg(F.avg(x).alias("_g"))
    return per.join(overall, section).select(unit, section, (F.col("_m") - F.col("_g")).alias("deviation"))


def sign_flip(df: DataFrame, x: str) -> DataFrame:
    """Every value with label 1 and its mirror image with label 0."""
    return df.select("*", F.inline(F.array(F.struct(F.col(x).alias("value"), F.lit(1).alias("y")),
                                           F.struct((-F.col(x)).alias("value"), F.lit(0).alias("y")))))


def threshold_metrics(df: DataFrame, by: list[str], y: str, p: str, t: float = 0.5) -> DataFrame:
    """Accuracy family at one threshold and the Brier score; 0 on 0/0."""
    hit, real = F.col(p) >= t, F.col(y) == 1
    c = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select(*by, "n", ((tp + tn) / F.col("n")).alias("accuracy"), ((rec + ratio(tn, tn + fp)) / 2).alias("balanced"),
                    (F.greatest(tp + fn, tn + fp) / F.col("n")).alias("baseline"), prec.alias("precision"), rec.alias("recall"),
                    ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "brier")


def with_groups(df: DataFrame, groups: DataFrame, by: list[str], most: int = 100_000) -> DataFrame:
    """Rows joined with the one row of their group.

    Up to ``most`` groups are counted and sent to every task: a join by few keys
    would deal all rows out to as few tasks, which sort them.
    """
    held = cut(groups)
    few = held.limit(most + 1).count() <= most
    return df.join(F.broadcast(held) if few else held, by)


def exact_quantiles(df: DataFrame, by: list[str], x: str, qs: list[float], name: str = "q") -> DataFrame:
    """(by, q array, n): linearly interpolated quantiles, exact at any size.

    Ranks are read off the running counts of the distinct values, so no task
    holds the values of a whole group as an exact percentile aggregate would.
    """
    hist = cut(df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    total = hist.groupBy(*by).agg(F.sum("_c").alias("_n"))
    up = running_sums(hist, by, ["_v"], {"_up": F.col("_c")})
    ranked = up.join(total, by) if by else with_scalar(up, total)

    def at(rank):
        return F.max(F.when((rank < F.col("_up")) & (rank >= F.col("_up") - F.col("_c")), F.col("_v")))

    cells = []
    for i, q in enumerate(qs):
        place = (F.col("_n") - 1) * F.lit(float(q))
        cells += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    found = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *cells)
    parts = []
    for i, q in enumerate(qs):
        place = (F.col("_n") - 1) * F.lit(float(q))
        parts.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place - F.floor(place)))
    return found.select(*by, F.array(*parts).alias(name), F.col("_n").alias("n"))


def quantile_bins(df: DataFrame, by: list[str], x: str, bins: int) -> DataFrame:
    """Add the number of exact quantile edges at or below each value."""
    edges = exact_quantiles(df, by, x, [i / bins for i in range(1, bins)], "_edges").withColumnRenamed("n", "_n")
    both = with_groups(df, edges, by) if by else with_scalar(df, edges)
    return both.withColumn("bin", F.size(F.filter("_edges", lambda e: e <= F.col(x))).cast("bigint")).drop("_edges")


def rates_by_bin(df: DataFrame, by: list[str], x: str, y: Column, bins: int, least: int) -> DataFrame:
    """(by, bin, rate, n): mean of y per quantile bin of x, for groups of at least ``least`` values.

    An exact quantile edge lies at or below a value when the value at its upper
    rank does, so the bin of a value follows from the running count of the
    distinct values; neither edges nor rows are joined.
    """
    hist = cut(df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.count(y).alias("_k"), F.sum(y).alias("_y")))
    total = hist.groupBy(*by).agg(F.sum("_c").alias("_n")).filter(F.col("_n") >= least)
    up = running_sums(hist, by, ["_v"], {"_up": F.col("_c")})
    ranked = up.join(total, by) if by else with_scalar(up, total)
    below = sum(((F.ceil((F.col("_n") - 1) * F.lit(i / bins) - 1e-9) < F.col("_up")).cast("bigint") for i in range(1, bins)), F.lit(0).cast("bigint"))
    return ranked.groupBy(*by, below.alias("bin")).agg((F.sum("_y") / F.sum("_k")).alias("rate"), F.sum("_c").alias("n"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    return quantile_bins(df, [], p, bins).groupBy("bin").agg(
        F.avg(p).alias("predicted"), F.avg(y).alias("observed"), F.count(F.lit(1)).alias("n"))


BLOCK_BYTES = 16 << 20


def replicate_weights(groups: DataFrame, size: int, first: int, last: int, seed: str) -> np.ndarray:
    """(size, last - first) how often replicate r draws group g; ``BLOCK_BYTES`` at most.

    A draw is 60 bits of one md5 modulo the number of groups (a bias below
    ``size`` / 2**60); one row per group lists the replicates that drew it.
    """
    slots = groups.select(F.col("_g").alias("_slot"), F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("rep"))
    picked = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep"), F.col("_slot"))), 1, 15), 16, 10).cast("bigint") % size
    drawn = slots.select(picked.alias("_g"), (F.col("rep") - first).alias("rep")).groupBy("_g").agg(F.collect_list("rep").alias("reps")).toArrow()
    lists = drawn.column("reps").combine_chunks()
    owner = np.repeat(drawn.column("_g").to_numpy(), lists.value_lengths().to_numpy())
    counts = np.zeros((size, last - first), np.int32)
    np.add.at(counts, (owner, lists.flatten().to_numpy()), 1)
    return counts.astype(np.min_scalar_type(counts.max()))


def weighted_areas(rows: DataFrame, weights: np.ndarray, step: int = 1 << 22) -> DataFrame:
    """(at, pos, neg, twice): per range of scores and for every column of ``weights`` its rows of both classes and twice its area.

    ``rows`` are (_g, score, pos, neg).  They are dealt out by score once; a task
    runs through its sorted rows in slices, with one running count of negatives
    per column.  Nothing per score and replicate leaves the task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    least = max(1, step // weights.shape[1])

    def run(batches):
        w, at, held = shared.value, None, []
        pos, neg, twice = (np.zeros(w.shape[1], np.int64) for _ in range(3))

        def tied(tables):
            """Slices of whole scores, of about ``least`` rows."""
            rest = None
            for batch in tables:
                for i in range(0, batch.num_rows, least):
                    part = [c.to_numpy() for c in batch.slice(i, least).columns]
                    rest = part if rest is None else [np.concatenate(c) for c in zip(rest, part)]
                    whole = int(np.searchsorted(rest[1], rest[1][-1]))
                    if whole:
                        yield [c[:whole] for c in rest]
                        rest = [c[whole:] for c in rest]
                    elif len(rest[1]) > least:  # many groups with one score: their sums are all that counts
                        g, score, p, n = rest
                        held.append((w[g].T.astype(np.int64) @ p, w[g].T.astype(np.int64) @ n))
                        rest = [g[-1:], score[-1:], p[-1:] * 0, n[-1:] * 0]
            if rest is not None:
                yield rest

        for g, score, p, n in tied(batches):
            at = score[0] if at is None else at
            start = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
            drawn = w[g].astype(np.int64)
            ps, ns = np.add.reduceat(drawn * p[:, None], start), np.add.reduceat(drawn * n[:, None], start)
            for more_p, more_n in held:
                ps[0] += more_p
                ns[0] += more_n
            held.clear()
            up = neg + np.cumsum(ns, axis=0)
            twice += (ps * (2 * up - ns)).sum(0)
            pos += ps.sum(0)
            neg = up[-1]
        if at is not None:
            yield pa.RecordBatch.from_pydict({"at": [at], **{k: pa.array([v]) for k, v in (("pos", pos), ("neg", neg), ("twice", twice))}})

    ordered = rows.select("_g", "score", "pos", "neg").repartitionByRange("score").sortWithinPartitions("score")
    return ordered.mapInArrow(run, "at double, pos array<long>, neg array<long>, twice array<long>")


def joined_areas(parts: DataFrame, first: int) -> DataFrame:
    """(rep, auroc) of the ranges of ``weighted_areas``: a range's positives lie above all negatives of the ranges before it."""
    each = parts.select("at", F.posexplode(F.arrays_zip("pos", "neg", "twice")).alias("rep", "x")).select("at", (F.col("rep") + first).alias("rep"), "x.*")
    before = F.sum("neg").over(Window.partitionBy("rep").orderBy("at").rowsBetween(UP, -1))
    area = each.withColumn("_u", F.col("twice") / 2 + F.col("pos").cast("double") * F.coalesce(before, F.lit(0)))
    sums = area.groupBy("rep").agg(F.sum("_u").alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).filter("_p > 0 and _n > 0")
    return sums.select("rep", (F.col("_u") / F.col("_p") / F.col("_n")).alias("auroc"))


def cluster_bootstrap(df: DataFrame, group: str, y: str, score: str, reps: int, seed: str) -> DataFrame:
    """Percentile interval of the AUROC over whole groups drawn with replacement.

    A replicate is a column of multiplicities per group, held as one array; it
    weights the per-group histogram, so no row is copied.  Groups are numbered
    by the order of their md5.  As many replicates as fit ``BLOCK_BYTES`` of
    multiplicities are one pass over the histogram, which is written once.
    """
    by_group = cut(histogram(df, [group], y, score))
    named = by_group.select(group).distinct().withColumn("_h", F.md5(F.col(group).cast("string")))
    groups = cut(with_position(named, [], ["_h", group], F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint"), "_g").drop("_h"))
    size = groups.count()
    rows = by_group.join(groups, group)
    block, areas = max(1, BLOCK_BYTES // max(1, 4 * size)), None
    for first in range(0, reps if size else 0, block):
        weights = replicate_weights(groups, size, first, min(reps, first + block), seed)
        if not first:  # the data themselves, as replicate -1
            weights = np.concatenate([np.ones((size, 1), weights.dtype), weights], axis=1)
        part = joined_areas(weighted_areas(rows, weights), first - (not first))
        areas = part if areas is None else areas.unionByName(part)
    if areas is None:
        areas = df.sparkSession.createDataFrame([], "rep int, auroc double")
    drawn = F.when(F.col("rep") >= 0, F.col("auroc"))
    return areas.agg(F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"), F.count(drawn).alias("n_reps"),
                     F.max(F.when(F.col("rep") < 0, F.col("auroc"))).alias("auroc"))


def ecdf(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Cumulative share of each distinct value."""
    hist = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("value")).agg(F.count(F.lit(1)).alias("_c"))
    total = hist.groupBy(*by).agg(F.sum("_c").alias("_n"))
    up = running_sums(hist, by, ["value"], {"_cum": F.col("_c")}, value_bucket(F.col("value")))
    return up.join(total, by).select(*by, "value", (F.col("_cum") / F.col("_n")).alias("share"))


def center(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Subtract the mean of the group; the means come from a small join."""
    means = df.groupBy(*by).agg(F.avg(x).alias("_m"))
    return df.join(means, by).withColumn("centered", F.col(x) - F.col("_m")).drop("_m")


def contrast(df: DataFrame, label: str, layer: str, x: str, baseline: str) -> DataFrame:
    """Mean of a class minus the mean of the baseline class, per layer."""
    m = df.groupBy(label, layer).agg(F.avg(x).alias("_m"), F.count(x).alias("n"))
    base = m.filter(F.col(label) == baseline).select(layer, F.col("_m").alias("_b"))
    return m.filter(F.col(label) != baseline).join(base, layer).select(label, layer, "n", (F.col("_m") - F.col("_b")).alias("difference"))


def contrast_matched(df: DataFrame, label: str, layer: str, x: str, length: str, baseline: str, bins: int) -> DataFrame:
    """The same inside length buckets, weighted by the rows of the class."""
    m = quantile_bins(df, [], length, bins).groupBy(label, layer, "bin").agg(F.avg(x).alias("_m"), F.count(x).alias("_c"))
    base = m.filter(F.col(label) == baseline).select(layer, "bin", F.col("_m").alias("_b"))
    return m.filter(F.col(label) != baseline).join(base, [layer, "bin"]).groupBy(label, layer).agg(
        (F.sum((F.col("_m") - F.col("_b")) * F.col("_c")) / F.sum("_c")).alias("difference"), F.sum("_c").alias("n"))


def mean_ci(df: DataFrame, by: list[str], x: str, unit: str) -> DataFrame:
    """Mean, sd, standard error, 95 % half width and number of distinct units."""
    sd = F.stddev_samp(x)
    sem = F.coalesce(sd / F.sqrt(F.count(x)), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), sd.alias("sd"), F.count(x).alias("n"), sem.alias("sem"),
                               (1.96 * sem).alias("half_width"), F.countDistinct(unit).alias("n_units"))


def macro(per_unit: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean and population sd of a per-unit metric, NULL ignored."""
    return per_unit.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n_units"))


def recovery(clean: Column, corrupted: Column, patched: Column) -> Column:
    """(patched - corrupted) / (clean - corrupted), 0 for a vanishing gap."""
    gap = clean - corrupted
    return F.when(F.abs(gap) < 1e-6, 0.0).otherwise((patched - corrupted) / gap)
