"""Best support of a claim by other texts, without materialising the pairs.

Texts to compare with are packed, a bounded number per row, and every claim row
meets the packs of its sample; the pairs exist only inside a row expression and
leave it as one number per pack.  A hot sample is therefore many bounded packs,
spread by the join, and partial results are combined by an ordinary aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NOTES_PER_PACK = 64
SOURCES_PER_PACK = 256


def coverage(claim: Column, premise: Column) -> Column:
    """Share of the distinct claim words found in the premise."""
    return F.coalesce(F.try_divide(T.overlap(claim, premise), F.size(claim)), F.lit(0.0))


def best_of(windows: Column, claim: Column) -> Column:
    """Highest coverage over an array of word arrays, NULL when there is none."""
    return F.array_max(F.transform(windows, lambda w: coverage(claim, w)))


def _packs(notes: DataFrame, sample: str, note: str, sections: str) -> DataFrame:
    return notes.groupBy(sample, F.floor(F.col(note) / NOTES_PER_PACK).alias("_pack")).agg(
        F.collect_list(F.struct(F.col(note).alias("note"), F.col(sections).alias("sections"))).alias("_notes"))


def _fold(claims: DataFrame, packs: DataFrame, sample: str, note: str, score) -> DataFrame:
    """Sum of scores and number of compared notes per claim."""
    joined = claims.join(packs, sample).withColumn("_r", F.aggregate(
        F.filter("_notes", lambda n: n["note"] != F.col(note)),
        F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, n: T.let(score(n), lambda s: F.struct(
            (acc["total"] + F.coalesce(s, F.lit(0.0))).alias("total"),
            (acc["n"] + F.when(s.isNotNull(), 1).otherwise(0)).alias("n")))))
    keys = [c for c in claims.columns if c != "words"]
    return joined.groupBy(*keys).agg(F.sum("_r.total").alias("support_sum"), F.sum("_r.n").alias("n_compared"))


def pair_support(claims: DataFrame, notes: DataFrame, sample: str, note: str, section: str) -> DataFrame:
    """Each claim against the same section of every other note of its sample.

    ``claims`` has an array column ``words``; ``notes`` a map ``sections`` from
    section to windows (arrays of words) with the key 'all' used when a note
    lacks the section.
    """
    def score(n):
        return best_of(F.coalesce(F.try_element_at(n["sections"], F.col(section)),
                                  F.try_element_at(n["sections"], F.lit("all"))), F.col("words"))

    return _fold(claims, _packs(notes, sample, note, "sections"), sample, note, score)


def fallback_support(claims: DataFrame, notes: DataFrame, sample: str, note: str, section: str,
                     threshold: float) -> DataFrame:
    """Same section first; weak claims also meet the other sections.

    A note counts only if some of its text was compared.
    """
    def score(n):
        own = best_of(F.try_element_at(n["sections"], F.col(section)), F.col("words"))
        rest = F.flatten(F.map_values(F.map_filter(n["sections"], lambda k, _: k != F.col(section))))
        return T.let(own, lambda s: F.when(s >= threshold, s).otherwise(
            F.greatest(s, best_of(rest, F.col("words")))))

    return _fold(claims, _packs(notes, sample, note, "sections"), sample, note, score)


def max_support(targets: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Best coverage of each target by any source text of the same document.

    Equal source texts count once; packs hold at most ``SOURCES_PER_PACK``.
    """
    different = sources.select(key, F.array_sort(F.array_distinct("words")).alias("words")).distinct()
    sizes = different.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / SOURCES_PER_PACK).alias("_n"))
    packs = different.join(sizes, key).groupBy(key, F.pmod(F.xxhash64("words"), F.col("_n")).alias("_pack")) \
        .agg(F.collect_list("words").alias("_pool")).drop("_pack")
    keys = [c for c in targets.columns if c != "words"]
    return targets.join(packs, key, "left").withColumn("_s", best_of(F.col("_pool"), F.col("words"))) \
        .groupBy(*keys).agg(F.max("_s").alias("support"))
