"""Labels, votes and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

FIVE = ["Faithful", *K.ERROR_TYPES]


def binary_label(label: Column) -> Column:
    """Faithful 0, a known error 1, anything else NULL."""
    return F.when(label == "Faithful", 0).when(label.isin(K.ERROR_TYPES), 1).cast("bigint")


def five_class(label: Column) -> Column:
    return F.when(label.isin(FIVE), label).otherwise("Not Faithful")


def two_class(label: Column) -> Column:
    return F.when(label == "Faithful", "Faithful").otherwise("Not Faithful")


def vote_class(verdict: Column, kind: Column) -> Column:
    """Five-class label of a human verdict with its optional error type."""
    return F.when(verdict == "Faithful", "Faithful").when(kind.isin(K.ERROR_TYPES), kind).otherwise("Not Faithful")


def collapse(rows: DataFrame, keys: list[str], pos: Column, text: str, label: str) -> DataFrame:
    """One row per sentence: first text, 1 when any row is not faithful."""
    return rows.groupBy(*keys).agg(
        F.min_by(text, pos).alias(text), F.max((F.lower(F.trim(label)) != "faithful").cast("bigint")).alias("label"))


def strict_label(sentence_label: Column, fact: Column, flagged: Column) -> Column:
    """0 in a faithful sentence, 1 when fact and flagged span share a long word."""
    y = binary_label(sentence_label)
    return F.when(y == 0, y).when((y == 1) & F.arrays_overlap(T.long_words(fact), T.long_words(flagged)), y)


def loose_facts(rows: DataFrame, fact: str, label: str, flagged: str, clean: str) -> DataFrame:
    """Add ``loose`` (every fact of a bad sentence is 1) and ``touches``: a fact word above 3 characters occurs in the flagged span.

    Only facts with a clean match and a known label stay.
    """
    inside = F.exists(T.words(F.col(fact)), lambda w: (F.length(w) > 3) & F.contains(F.lower(F.col(flagged)), F.lower(w)))
    return rows.filter(F.coalesce(F.col(clean), F.lit(False))).withColumn("loose", binary_label(F.col(label))).filter("loose is not null") \
        .withColumn("touches", F.coalesce(inside, F.lit(False)))


def overlap_rate(facts: DataFrame, by: list[str], uncertainty: str, flagged: str, floor: float = 0.5) -> DataFrame:
    """(by, n, rate): of the uncertain facts of bad sentences with a flagged span, the share that touches it."""
    wanted = (F.col(uncertainty) > floor) & (F.col("loose") == 1) & (F.coalesce(F.col(flagged), F.lit("")) != "")
    return facts.filter(wanted).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("touches").cast("int")).alias("rate"))


def span_label(sentence: Column, sentence_label: Column, fact_span: Column, flagged: Column) -> Column:
    """struct<y,method> from character overlap inside the sentence, else words."""
    y = binary_label(sentence_label)

    def judged(a, b):
        both = a.isNotNull() & b.isNotNull()
        chars = (a["start"] < b["end"]) & (b["start"] < a["end"])
        shared = F.arrays_overlap(T.long_words(fact_span), T.long_words(flagged))
        return (F.when(y == 0, F.struct(y.alias("y"), F.lit("faithful").alias("method")))
                .when((y == 1) & both & chars, F.struct(y.alias("y"), F.lit("chars").alias("method")))
                .when((y == 1) & ~both & shared, F.struct(y.alias("y"), F.lit("words").alias("method"))))

    return T.let(T.find_span(sentence, fact_span), lambda a: T.let(T.find_span(sentence, flagged), lambda b: judged(a, b)))


def outer_clean_spans(units: DataFrame, flagged: DataFrame, by: list[str], size: str) -> DataFrame:
    """Text before the first and after the last flagged span, or all of it."""
    edge = flagged.groupBy(*by).agg(F.min("start").alias("_a"), F.max("end").alias("_z"))
    spans = F.when(F.col("_a").isNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col(size).alias("end")))) \
        .otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("_a").alias("end")),
                           F.struct(F.col("_z").alias("start"), F.col(size).alias("end"))))
    return units.join(edge, by, "left").select(*by, F.inline(spans)).filter("end > start")


def clean_groups(rows: DataFrame, keys: list[str], faithful: Column) -> DataFrame:
    """Units all of whose rows are faithful."""
    return rows.groupBy(*keys).agg(F.bool_and(faithful).alias("_ok"), F.count(F.lit(1)).alias("n_rows")).filter("_ok").drop("_ok")


def threshold_label(value: Column, t: float) -> Column:
    return (value > t).cast("bigint")


def majority(votes: DataFrame, consensus: DataFrame, item: str) -> DataFrame:
    """Resolved verdict of each item and how it came about.

    ``votes`` holds (item, rater, verdict, type), ``consensus`` (item, agreed).
    """
    counts = votes.groupBy(item).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") != "Faithful").alias("bad"))
    kinds = votes.filter(F.col("type").isNotNull()).groupBy(item, "type").agg(
        F.count(F.lit(1)).alias("_c"), F.min("rater").alias("_first"))
    top = kinds.groupBy(item).agg(F.min_by("type", F.struct(-F.col("_c"), F.col("_first"))).alias("error_type"))
    joined = counts.join(consensus, item, "left").join(top, item, "left")
    good = F.col("n") - F.col("bad")
    how = (F.when(F.col("n") == 1, "single_annotator").when((F.col("bad") == 0) | (good == 0), "unanimous")
           .when(F.col("bad") != good, "majority").when(F.col("agreed").isNotNull(), "consensus_file").otherwise("unresolved_tie"))
    verdict = (F.when(F.col("bad") > good, "Not Faithful").when(F.col("bad") < good, "Faithful").otherwise(F.col("agreed")))
    out = joined.select(item, "n", "bad", how.alias("resolution"), verdict.alias("verdict"), "error_type")
    return out.withColumn("error_type", F.when(F.col("verdict") == "Not Faithful", F.col("error_type")))


def disagreements(votes: DataFrame, item: str) -> DataFrame:
    """Items whose raters differ in the verdict or in the type of the error."""
    return votes.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_raters"), F.countDistinct("verdict").alias("n_verdicts"),
        F.countDistinct(F.when(F.col("verdict") != "Faithful", F.coalesce("type", F.lit("")))).alias("n_types")) \
        .filter((F.col("n_raters") >= 2) & ((F.col("n_verdicts") > 1) | (F.col("n_types") > 1)))


def rater_pairs(votes: DataFrame, item: str, label: str) -> DataFrame:
    """Counts of label pairs per pair of raters; reduced before any statistic."""
    a = votes.select(item, F.col("rater").alias("rater_a"), F.col(label).alias("la"))
    b = votes.select(item, F.col("rater").alias("rater_b"), F.col(label).alias("lb"))
    return a.join(b, item).filter("rater_a < rater_b").groupBy("rater_a", "rater_b", "la", "lb").agg(F.count(F.lit(1)).alias("n"))


def cohen_kappa(pair_counts: DataFrame, by: list[str]) -> DataFrame:
    """Kappa and raw agreement from label-pair counts; NULL below two items."""
    ra = pair_counts.groupBy(*by, F.col("la").alias("l")).agg(F.sum("n").alias("na"))
    rb = pair_counts.groupBy(*by, F.col("lb").alias("l")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, [*by, "l"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("_e"))
    seen = pair_counts.groupBy(*by).agg(
        F.sum("n").alias("n_items"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("_o"))
    po, pe = F.col("_o") / F.col("n_items"), F.coalesce("_e", F.lit(0)) / (F.col("n_items") * F.col("n_items"))
    return seen.join(chance, by, "left").select(
        *by, "n_items", F.when(F.col("n_items") >= 2, po).alias("agreement"),
        F.when(F.col("n_items") >= 2, F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def fleiss_kappa(votes: DataFrame, item: str, label: str, raters: int) -> DataFrame:
    """Fleiss' kappa over the items rated by everybody, with the items used."""
    cells = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("_c"))
    items = cells.groupBy(item).agg(F.sum("_c").alias("_m"), F.sum(F.col("_c") * F.col("_c")).alias("_sq"))
    full = items.filter(F.col("_m") == raters)
    observed = items.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("_m") == raters).alias("n_used"),
        F.avg(F.when(F.col("_m") == raters, (F.col("_sq") - raters) / (raters * (raters - 1)))).alias("_p"))
    share = cells.join(full.select(item), item, "left_semi").groupBy(label).agg(F.sum("_c").alias("_t"))
    chance = share.agg((F.sum(F.col("_t") * F.col("_t")) / (F.sum("_t") * F.sum("_t"))).alias("_e"))
    one = F.lit(1).alias("_one")
    return observed.select("*", one).join(chance.select("*", one), "_one").select(
        "n_used", "n_total", F.try_divide(F.col("_p") - F.col("_e"), 1 - F.col("_e")).alias("kappa"))


def krippendorff_alpha(votes: DataFrame, item: str, label: str) -> DataFrame:
    """Nominal alpha from coincidences; items with one rating do not count."""
    cells = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("_c"))
    items = cells.groupBy(item).agg(F.sum("_c").alias("_m")).filter("_m >= 2")
    used = cells.join(items, item)
    per = used.groupBy(label).agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_c") * (F.col("_c") - 1) / (F.col("_m") - 1)).alias("_same"))
    total = F.sum("_n")
    agree = F.sum("_same")
    chance = (F.sum(F.col("_n") * (F.col("_n") - 1))) / (total - 1)
    return per.agg(total.alias("n_ratings"), F.try_divide(agree - chance, total - chance).alias("alpha"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def class_report(counts: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts."""
    t = counts.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"))
    g = counts.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("guessed"))
    hit = counts.filter(F.col(truth) == F.col(guess)).select(F.col(truth).alias("label"), F.col("n").alias("hits"))
    all_ = t.join(g, "label", "full").join(hit, "label", "left").na.fill(0)
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide("hits", "guessed"), zero), F.coalesce(F.try_divide("hits", "support"), zero)
    return all_.select("label", p.alias("precision"), r.alias("recall"),
                       F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"), "support")
