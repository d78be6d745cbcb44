"""Support, uncertainty, entropy and overlap scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .metrics import exact_quantiles, with_groups
from .ordered import running_sums, with_position


def two_way_support(entail: Column, contradict: Column) -> Column:
    return 1 / (1 + F.exp(contradict - entail))


def three_way_entail(entail: Column, neutral: Column, contradict: Column) -> Column:
    return 1 / (1 + F.exp(neutral - entail) + F.exp(contradict - entail))


def argmax_label(entail: Column, neutral: Column, contradict: Column) -> Column:
    top = F.greatest(entail, neutral, contradict)
    return F.when(entail == top, "entailment").when(neutral == top, "neutral").otherwise("contradiction")


def vote_uncertainty(votes: DataFrame, keys: list[str], vote: str, empty_support: float) -> DataFrame:
    """1 minus the share of yes votes; NULL votes are not counted."""
    return votes.groupBy(*keys).agg(
        (1 - F.coalesce(F.avg(vote), F.lit(empty_support))).alias("uncertainty"), F.count(vote).alias("n_votes"))


def first_notes(votes: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    return with_position(votes, by, order).filter(F.col("pos") < k).drop("pos")


def self_check(answers: DataFrame, keys: list[str], yes: str) -> DataFrame:
    """Share of no answers; a failed answer counts as no, no answer at all is 1."""
    n_yes, n_all = F.count_if(F.coalesce(F.col(yes), F.lit(False))), F.count(F.lit(1))
    return answers.groupBy(*keys).agg(
        n_yes.alias("n_yes"), (n_all - n_yes).alias("n_no"),
        F.coalesce(F.try_divide(n_all - n_yes, n_all), F.lit(1.0)).alias("uncertainty"))


def atom_faithfulness(sents: DataFrame, atoms: DataFrame, key: str, header: str, support: str, atom_support: str) -> DataFrame:
    """Mean atom support of a sentence, its own support without atoms, 1 for headers."""
    means = atoms.groupBy(key).agg(F.avg(atom_support).alias("_m"))
    return sents.join(means, key, "left").withColumn("faithfulness", F.when(F.col(header), 1.0).otherwise(
        F.coalesce("_m", F.col(support)))).drop("_m")


def classify_support(ranked: DataFrame, key: list[str], entailed: str, contradicted: str) -> DataFrame:
    """Verdict per fact from its ranked candidates (cos, rank and two flags)."""
    best = ranked.groupBy(*key).agg(
        F.max_by("cos", -F.col("rank")).alias("top_cos"),
        F.max_by(contradicted, -F.col("rank")).alias("_top_contra"),
        F.min(F.when(F.col(entailed), F.col("rank"))).alias("_first"),
        F.min_by("c_id", F.when(F.col(entailed), F.col("rank"))).alias("_first_id"),
        F.max_by("c_id", -F.col("rank")).alias("_top_id"))
    cos = F.round("top_cos", 4)
    middle = (cos >= K.COSINE_FLOOR) & (cos < K.COSINE_SUPPORT)
    supported = (cos >= K.COSINE_SUPPORT) | (middle & F.col("_first").isNotNull())
    kind = F.when(supported, "").when(middle & F.col("_top_contra") & (cos >= K.COSINE_NEGATION), "negation").otherwise("fabrication")
    return best.select(*key, cos.alias("top_cos"), supported.cast("bigint").alias("supported"), kind.alias("error_type"),
                       F.when(middle & F.col("_first").isNotNull(), F.col("_first_id")).otherwise(F.col("_top_id")).alias("match_id"))


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-p * F.ln(p) - (1 - p) * F.ln(1 - p))


def semantic_entropy(claims: DataFrame, clusters: DataFrame, sample: list[str], kind: str, gen: str, idc: str, k: int) -> DataFrame:
    """Mean binary entropy of cluster presence per claim type.

    ``clusters`` maps a claim id to its component.  A generation without the
    claim type is a cluster of its own, present once.
    """
    member = claims.join(clusters, idc)
    per = member.groupBy(*sample, kind, "component").agg(F.countDistinct(gen).alias("_k"))
    have = member.groupBy(*sample, kind).agg(F.countDistinct(gen).alias("_have"))
    total = per.groupBy(*sample, kind).agg(
        F.sum(binary_entropy(F.col("_k") / k)).alias("_h"), F.count(F.lit(1)).alias("_c"))
    absent = k - F.col("_have")
    return total.join(have, [*sample, kind]).select(
        *sample, kind, (F.col("_c") + absent).alias("n_clusters"),
        ((F.col("_h") + absent * binary_entropy(F.lit(1.0 / k))) / (F.col("_c") + absent)).alias("entropy"))


def share_entropy(counts: DataFrame, by: list[str], n: str, groups: int | None = None) -> DataFrame:
    """-sum p ln p of counted categories per group, one category gives 0.

    With p = n/N this is ln N - sum(n ln n)/N, a single aggregate.
    ``groups`` divides by ln(groups) to normalise.
    """
    total = F.sum(n)
    h = F.ln(total) - F.sum(F.col(n) * F.ln(n)) / total
    if groups:
        h = h / F.ln(F.lit(float(groups)))
    return counts.filter(F.col(n) > 0).groupBy(*by).agg(h.alias("entropy"), total.alias("total"))


def position_entropy(members: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """Entropy over cluster shares; fewer than two valid members give 0."""
    counts = members.filter(F.col(cluster).isNotNull()).groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"))
    return share_entropy(counts, by, "n").withColumn("entropy", F.when(F.col("total") < 2, 0.0).otherwise(F.col("entropy")))


def js_divergence(p: DataFrame, q: DataFrame, by: list[str], cell: str, mass: str, share: str, eps: float = 1e-10) -> DataFrame:
    """Jensen-Shannon divergence of each group to the common shares q, in [0, 1].

    Cells a group lacks hold mass on the q side only, worth q ln 2, so they are
    added as one remainder and never materialised.
    """
    total = p.groupBy(*by).agg(F.sum(mass).alias("_t"))
    x, y = F.col(mass) / F.col("_t") + eps, F.coalesce(share, F.lit(0.0)) + eps
    m = (x + y) / 2
    terms = p.join(total, by).join(q.select(cell, share), cell, "left").groupBy(*by).agg(
        F.sum(x * F.ln(x / m) + y * F.ln(y / m)).alias("_kl"), F.coalesce(F.sum(share), F.lit(0.0)).alias("_used"))
    both = 0.5 * (F.col("_kl") + (1 - F.col("_used")) * F.ln(F.lit(2.0)))
    return terms.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), both)).alias("js"))


def centroid_cosine(units: DataFrame, by: str, idc: str, vec: str, weight: Column, k: int) -> DataFrame:
    """Cosine of each unit with the mean of the k heaviest units of its group."""
    w = Window.partitionBy(by).orderBy(F.desc("_w"), idc)
    top = units.withColumn("_w", weight).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    dims = top.select(by, F.posexplode(vec).alias("_d", "_x")).groupBy(by, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    center = dims.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("_c"))
    dot, na, nb = T.dot(F.col(vec), F.col("_c")), F.sqrt(T.dot(F.col(vec), F.col(vec))), F.sqrt(T.dot(F.col("_c"), F.col("_c")))
    return units.join(center, by).select(by, idc, F.when((na < 1e-8) | (nb < 1e-8), F.lit(None)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / na / nb))).alias("cosine"))


def context_ratio(tokens: DataFrame, by: list[str], order: list[str], context: Column, value: Column) -> DataFrame:
    """context mean / (context mean + new mean) over what precedes each row.

    ``value`` should be exact (decimal).  NULL when both means are zero, 1 when
    nothing new precedes.
    """
    sums = running_sums(tokens, by, order, {
        "_cs": F.when(context, value).otherwise(0), "_cn": F.when(context, 1).otherwise(0),
        "_ns": F.when(~context, value).otherwise(0), "_nn": F.when(~context, 1).otherwise(0)})
    own = F.when(context, value).otherwise(0)
    new = F.when(~context, value).otherwise(0)
    cn, nn = F.col("_cn") - context.cast("int"), F.col("_nn") - (~context).cast("int")
    cmean = F.coalesce(F.try_divide((F.col("_cs") - own).cast("double"), cn), F.lit(0.0))
    nmean = F.coalesce(F.try_divide((F.col("_ns") - new).cast("double"), nn), F.lit(0.0))
    ratio = F.when(nn == 0, F.lit(1.0)).otherwise(F.try_divide(cmean, cmean + nmean))
    return sums.select(*tokens.columns, ratio.alias("ratio"))


def risk(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (a + b) / 2))


def quadrants(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Add the quadrant of two scores relative to their exact group medians."""
    med = exact_quantiles(df, by, a, [0.5], "_qa").select(*by, F.get("_qa", F.lit(0)).alias("_ma")).join(
        exact_quantiles(df, by, b, [0.5], "_qb").select(*by, F.get("_qb", F.lit(0)).alias("_mb")), by)
    hi_a, hi_b = F.col(a) >= F.col("_ma"), F.col(b) >= F.col("_mb")
    name = (F.when(hi_a & ~hi_b, "extractive").when(~hi_a & hi_b, "parametric").when(hi_a & hi_b, "synthesized")
            .otherwise("hallucinatory"))
    return with_groups(df, med, by).withColumn("quadrant", name).drop("_ma", "_mb")


def absent_values(claims: DataFrame, sample: str, gen: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """(sample, gen, kind, entropy, found, position): the values of the other generations for every kind that one lacks.

    ``found`` lists value:count, the most frequent first; kinds are ordered by
    the entropy of their values.  Values are counted before they are gathered.
    """
    keys = [sample, kind]
    counts = claims.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    share = F.col("_n") / F.col("_t")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))))
    summary = counts.join(total, keys).groupBy(*keys).agg(
        (F.round(-F.sum(share * F.ln(share)), 6) + 0.0).alias("entropy"),
        F.array_join(F.transform(listed, lambda x: F.concat(x["v"].cast("string"), F.lit(":"), (-x["n"]).cast("string"))), " ").alias("found"))
    wanted = claims.select(sample, gen).distinct().withColumn(kind, F.explode(F.array(*[F.lit(k) for k in kinds])))
    absent = wanted.join(claims.select(sample, gen, kind).distinct(), [sample, gen, kind], "left_anti")
    order = Window.partitionBy(sample, gen).orderBy(F.desc("entropy"), kind)  # at most one row per kind
    return absent.join(summary, keys).withColumn("position", F.row_number().over(order).cast("bigint")) \
        .select(sample, gen, kind, "entropy", "found", "position")


QUADRANTS = ("extractive", "parametric", "synthesized", "hallucinatory")


def quadrant_shares(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Share of every quadrant, mean of b - a and the most frequent quadrant (first name of equals) per group."""
    shares = [F.round(F.avg((F.col("quadrant") == q).cast("int")), 6).alias(q) for q in QUADRANTS]
    counts = F.array_sort(F.array(*[F.struct((-F.count_if(F.col("quadrant") == q)).alias("n"), F.lit(q).alias("q")) for q in QUADRANTS]))
    return df.groupBy(*by).agg(*shares, F.round(F.avg(F.col(b) - F.col(a)), 6).alias("net"), F.get(counts, F.lit(0))["q"].alias("dominant"))


def contribution_fractions(df: DataFrame, by: list[str], first: Column, second: Column, flagged: Column) -> DataFrame:
    """Share of |first| in |first| + |second|, and the mean of first on flagged and on other rows."""
    total = F.sum(F.abs(first)) + F.sum(F.abs(second))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.abs(first)), total).alias("first_fraction"),
                               F.avg(F.when(flagged, first)).alias("flagged_mean"), F.avg(F.when(~flagged, first)).alias("clean_mean"))


def bleu1(hyp: Column, ref: Column) -> Column:
    """Clipped unigram precision with brevity penalty for two word arrays."""
    def count_in(ws, w):
        return F.size(F.filter(ws, lambda x: x == w))

    def score(h, r):
        hits = F.aggregate(F.array_distinct(h), F.lit(0), lambda acc, w: acc + F.least(count_in(h, w), count_in(r, w)))
        penalty = F.when(F.size(h) > F.size(r), F.lit(1.0)).otherwise(F.exp(1 - F.size(r) / F.size(h)))
        return F.when(F.size(h) > 0, penalty * hits / F.size(h)).otherwise(F.lit(0.0))

    return T.let(hyp, lambda h: T.let(ref, lambda r: score(h, r)))


def rouge_l(hyp: Column, ref: Column) -> Column:
    """F measure of the longest common subsequence of two token arrays."""
    def score(h, r):
        return T.let(T.lcs_length(h, r), lambda n: F.when(n > 0, 2.0 * n / (F.size(h) + F.size(r))).otherwise(F.lit(0.0)))

    return T.let(hyp, lambda h: T.let(ref, lambda r: score(h, r)))


def band_features(tokens: DataFrame, by: list[str], layer: Column, value: Column, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean |x| and mean positive part over the layers of each band."""
    aggs = []
    for name, (lo, hi) in bands.items():
        inside = layer.between(lo, hi)
        aggs += [F.avg(F.when(inside, F.abs(value))).alias(f"{name}_abs"),
                 F.avg(F.when(inside, F.greatest(value, F.lit(0.0)))).alias(f"{name}_pos")]
    return tokens.groupBy(*by).agg(*aggs)


def top_components(tokens: DataFrame, entity: str, keys: list[str], value: str, k: int) -> DataFrame:
    """The k components of each entity with the largest |value|."""
    w = Window.partitionBy(entity).orderBy(F.desc(F.abs(value)), *keys)
    return tokens.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
