"""Report tables: numeric results, formatting is left to the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .metrics import exact_quantiles, with_scalar


def section_table(df: DataFrame, section: str, u: str) -> DataFrame:
    """Rows, share per quartile band and mean by section, and over all."""
    x = F.col(u)
    bands = [(0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.001)]
    shares = [F.avg(((x >= lo) & (x < hi)).cast("int")).alias(f"share_q{i}") for i, (lo, hi) in enumerate(bands, 1)]
    out = df.filter(F.col(section).isin(K.TABLE_SECTIONS)).rollup(section).agg(
        F.count(F.lit(1)).alias("n"), *shares, F.avg(x).alias("mean_u"))
    names = F.array(*[F.lit(s) for s in K.TABLE_SECTIONS + ["All"]])
    named = out.withColumn("section", F.coalesce(F.col(section), F.lit("All")))
    return named.withColumn("position", F.array_position(names, F.col("section"))).select(
        "position", "section", "n", "share_q1", "share_q2", "share_q3", "share_q4", "mean_u")


def stats_by(df: DataFrame, key: str, x: str) -> DataFrame:
    stats = df.groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"))
    middle = exact_quantiles(df, [key], x, [0.5]).select(key, F.get("q", F.lit(0)).alias("median"))
    return stats.join(middle, key)


def bucket_counts(df: DataFrame, x: Column, bins: int = 10) -> DataFrame:
    """Right-closed bins over [0, 1], the lowest value included, zero-filled."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    inside = df.select(x.alias("_x")).filter(F.col("_x").between(0.0, 1.0))
    counts = inside.groupBy(F.size(F.filter(edges, lambda e: e < F.col("_x"))).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def five_numbers(df: DataFrame, by: list[str], x: str) -> DataFrame:
    q = exact_quantiles(df, by, x, [0.0, 0.25, 0.5, 0.75, 1.0], "_q").drop("n")
    s = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(x).alias("n"))
    return s.join(q, by).select(*by, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))], "mean", "sd", "n")


def pivot_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def judge_summary(df: DataFrame, keys: list[str], label: str, span: str, labels: list[str]) -> DataFrame:
    """Rows, spans, error rate (unparsed rows count as errors), count per label."""
    lab = F.col(label)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.nullif(F.col(span), F.lit(""))).alias("n_spans"),
        (1 - F.count_if(lab == "Faithful") / F.count(F.lit(1))).alias("error_rate"),
        *[F.count_if(lab == v).alias(f"n_{v.lower()}") for v in labels])


def match_summary(df: DataFrame, keys: list[str], methods: list[str]) -> DataFrame:
    """Facts and matches by method per note, and one total row."""
    m = F.col("matched_by")
    return df.rollup(*keys).agg(
        F.count(F.lit(1)).alias("n_facts"), F.count(m).alias("n_clean"), *[F.count_if(m == v).alias(f"n_{v}") for v in methods]) \
        .withColumn("clean_rate", F.try_divide("n_clean", "n_facts"))


def coverage(df: DataFrame, by: list[str], stages: dict[str, Column]) -> DataFrame:
    """How many rows pass each stage and all stages before it."""
    aggs, passed = [F.count(F.lit(1)).alias("n_rows")], F.lit(True)
    for name, test in stages.items():
        passed = passed & F.coalesce(test, F.lit(False))
        aggs.append(F.count_if(passed).alias(f"n_{name}"))
    return df.groupBy(*by).agg(*aggs)


def rubric_summary(scores: DataFrame) -> DataFrame:
    """Mean and number of values per rubric item from array<struct<item,value,..>>."""
    return scores.select(F.inline("scores")).groupBy("item").agg(
        F.avg("value").alias("mean"), F.count("value").alias("n"), F.count_if(~F.col("valid")).alias("n_invalid"))


def rank_contributions(df: DataFrame, keys: list[str], x: Column, n: int) -> DataFrame:
    """The n cells with the largest mean |contribution|."""
    cells = df.groupBy(*keys).agg(F.round(F.avg(F.abs(x)), 9).alias("mean_abs"), F.count(F.lit(1)).alias("appearances"))
    return cells.orderBy(F.desc("mean_abs"), *keys).limit(n)


def cost_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by stage and model, totals per stage and overall.

    ``prices`` (model, price_in, price_out per million) is a short dimension;
    an unknown model costs 0 and is counted.
    """
    per = calls.groupBy("stage", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_in").alias("ti"), F.sum("tokens_out").alias("to"))
    priced = per.join(prices, "model", "left")
    cost = F.coalesce((F.col("ti") * F.col("price_in") + F.col("to") * F.col("price_out")) / 1e6, F.lit(0.0))
    return priced.rollup("stage", "model").agg(
        F.sum("n").alias("n_calls"), F.sum("ti").alias("tokens_in"), F.sum("to").alias("tokens_out"), F.sum(cost).alias("cost"),
        F.sum(F.when(F.col("price_in").isNull(), F.col("n")).otherwise(0)).alias("n_unpriced"))


def workload(requested: DataFrame, counts: DataFrame, key: str, sentences: str, k: int, default: int, tokens: int, price: float) -> DataFrame:
    """Calls, tokens and money for the requested samples; a default where unknown."""
    n = F.coalesce(F.col(sentences), F.lit(default))
    total = requested.join(counts, key, "left").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col(sentences).isNull()).alias("n_default"), (F.sum(n) * (k - 1)).alias("n_calls"))
    return total.withColumn("tokens", F.col("n_calls") * tokens).withColumn("cost", F.col("tokens") * price / 1e6)


def centroids(df: DataFrame, label: str, xs: list[str], baseline: str) -> DataFrame:
    """Mean of every score by label, with the medians of the baseline label."""
    means = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"mean_{x}") for x in xs])
    out = means
    for x in xs:
        middle = exact_quantiles(df.filter(F.col(label) == baseline), [], x, [0.5]).select(F.get("q", F.lit(0)).alias(f"line_{x}"))
        out = with_scalar(out, middle)
    return out


def select_cases(df: DataFrame, idc: str, a: Column, b: Column, c: Column, n: int) -> DataFrame:
    """Cases of three categories in id order.

    B and C stop at n of their own; A stops when the whole list holds n, so the
    earlier B and C cases count against it.  All parts are short lists.
    """
    def first(test, name):
        return df.filter(test).orderBy(idc).limit(n).select(idc, F.lit(name).alias("category"))

    bc = first(b, "B").unionByName(first(c, "C"))
    listed = bc.agg(F.collect_list(idc).alias("_taken")).withColumn("_1", F.lit(1))
    ranked = first(a, "A").agg(F.sort_array(F.collect_list(idc)).alias("_ids")).select(F.posexplode("_ids").alias("_r", idc)).withColumn("_1", F.lit(1))
    kept = ranked.join(listed, "_1").filter(
        F.col("_r") + F.size(F.filter("_taken", lambda t: t < F.col(idc))) < n).select(idc, F.lit("A").alias("category"))
    return kept.unionByName(bc)


def grounding(attention: Column, mlp: Column, threshold: float = 0.3) -> Column:
    a, m = F.array_max(attention), F.array_max(mlp)
    return (F.when((F.size(attention) == 0) | attention.isNull(), "unknown").when((a > threshold) & (m <= threshold), "retrieval")
            .when((m > threshold) & (a <= threshold), "parametric").when((a > threshold) & (m > threshold), "mixed").otherwise("neither"))


def peak(scores: Column) -> Column:
    """0-based position of the largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def case_report(cases: DataFrame, category: str, attention: str, mlp: str) -> DataFrame:
    """Grounding class, blind spot flag and peak layers of each case."""
    g, cat = F.col("grounding"), F.col(category)
    return cases.withColumn("grounding", grounding(F.col(attention), F.col(mlp))) \
        .withColumn("blind_spot", F.when(cat.isin("A", "C"), g == "parametric").when(cat == "B", g == "retrieval").otherwise(F.lit(False))) \
        .withColumn("peak_attention", peak(F.col(attention))).withColumn("peak_mlp", peak(F.col(mlp)))
