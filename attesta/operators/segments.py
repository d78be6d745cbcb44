"""Operators that need rows of several texts or a running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.durable import cut
from .metrics import with_scalar
from .ordered import carry_last, running_sums, with_position


def fill_sections(sents: DataFrame, by: list[str], idx: str, s: str) -> DataFrame:
    """A header sentence names the section of the following sentences."""
    filled = carry_last(sents, by, [idx], T.table_section(F.col(s)), "section")
    return filled.withColumn("section", F.coalesce("section", F.lit("Preamble")))


def as_of(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, default: str) -> DataFrame:
    """Latest value at or before each row; headers and tokens share one order."""
    return carry_last(rows, by, order, value, name).withColumn(name, F.coalesce(name, F.lit(default)))


MOST_BITS = 1 << 27


def gram_filter(known: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """One row with ``bits``, a bitmap of the hashes of (gram), and its size: 16 bits a gram or more, 16 MB at most."""
    rows, size = known.count(), 1 << 12
    while size < min(16 * rows, most_bits):
        size *= 2
    at = F.pmod(F.xxhash64("gram"), F.lit(size))
    words = known.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
    dense = known.sparkSession.range(size // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")))), lambda x: x["b"]).alias("bits")), size


def may_be_known(gram: Column, bits: Column, size: int) -> Column:
    return T.let(F.pmod(F.xxhash64(gram), F.lit(size)), lambda h: F.getbit(F.get(bits, (h / 64).cast("int")), (h % 64).cast("int")) == 1)


def ngram_share(docs: DataFrame, gold: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Share of distinct word n-grams of each text found in any gold text.

    A text's n-grams are counted in its row.  Only those that a bitmap of the
    gold n-grams lets pass are shuffled, and met by their words; the gold
    n-grams are distinct, so the join adds no rows, however frequent one is.
    """
    known = cut(gold.select(F.explode(T.ngrams(T.words(F.lower(F.col("text"))), n)).alias("gram")).distinct())
    bits, size = gram_filter(known)
    own = with_scalar(docs.select(key, T.ngrams(T.words(F.lower(F.col(text))), n).alias("_g")), bits)
    hits = own.select(key, F.coalesce(F.size("_g"), F.lit(0)).alias("_n"), F.posexplode_outer(F.filter("_g", lambda g: may_be_known(g, F.col("bits"), size))).alias("_i", "gram"))
    met = hits.join(known.withColumn("known", F.lit(1)), "gram", "left").groupBy(key).agg(
        F.sum(F.when(F.coalesce("_i", F.lit(0)) == 0, F.greatest("_n", F.lit(0)))).cast("bigint").alias("n_grams"), F.count("known").alias("n_found"))
    return met.withColumn("share", F.coalesce(F.try_divide(F.col("n_found"), F.col("n_grams")), F.lit(0.0)))


def uncovered_tokens(docs: DataFrame, gold: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """Words of each text covered by no n-gram of the gold texts; only n-grams that their bitmap lets pass are shuffled."""
    known = cut(gold.select(F.explode(T.ngrams(T.words(F.lower(F.col("text"))), n)).alias("gram")).distinct())
    bits, size = gram_filter(known)
    toks = docs.select(key, T.words(F.lower(F.col(text))).alias("w"))
    grams = F.transform(T.ngrams_at(F.col("w"), n), lambda g, i: F.struct(i.alias("i"), g.alias("gram")))
    at = with_scalar(toks, bits).select(key, F.inline(F.filter(grams, lambda x: may_be_known(x["gram"], F.col("bits"), size))))
    covered = at.join(known, "gram", "left_semi") \
        .select(key, F.explode(F.array(*[F.col("i") + k for k in range(n)])).alias("tok")) \
        .distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_covered"))
    return toks.select(key, F.size("w").cast("bigint").alias("n_tokens")).join(covered, key, "left") \
        .withColumn("n_uncovered", F.col("n_tokens") - F.coalesce("n_covered", F.lit(0))).drop("n_covered")


def paired_share(note: Column, source: Column, n: int) -> Column:
    """Share of the distinct word n-grams of a note that occur in its own source; 0 without n-grams."""
    def share(own, other):
        return F.coalesce(F.try_divide(F.size(F.array_intersect(own, other)), F.size(own)), F.lit(0.0))

    def grams(c):
        return T.ngrams(T.words(F.lower(c)), n)

    return T.share4(share(grams(note), grams(source)))


def paired_uncovered(note: Column, source: Column, n: int = 3) -> Column:
    """Words of a note that lie in no n-gram of its own source.

    A word is covered by any of the n-grams that start at it or up to n - 1
    words before it.
    """
    def count(words, known):
        hit = F.transform(T.ngrams_at(words, n), lambda g: F.map_contains_key(known, g).cast("int"))
        padded = F.concat(F.array_repeat(F.lit(0), n - 1), hit, F.array_repeat(F.lit(0), n - 1))
        covered = F.slice(padded, F.lit(1), F.size(words))
        for k in range(1, n):
            covered = F.zip_with(covered, F.slice(padded, F.lit(1 + k), F.size(words)), lambda a, b: F.greatest(a, b))
        return F.when(F.size(words) >= n, F.size(F.filter(covered, lambda x: x == 0))).otherwise(F.size(words))

    known = F.map_from_entries(F.transform(T.ngrams(T.words(F.lower(source)), n), lambda g: F.struct(g, F.lit(1))))
    return T.let(T.words(F.lower(note)), lambda w: T.let(known, lambda m: count(w, m)))


def echo_guard(items: DataFrame, notes: DataFrame, key: str, item: str, note: str) -> DataFrame:
    """Keep the items that occur in their own note."""
    joined = items.join(notes.select(key, T.normalise(F.col(note)).alias("_note")), key)
    plain = T.normalise(F.col(item))
    return joined.filter((plain != "") & F.contains(F.col("_note"), plain)).drop("_note")


def token_chunks(tokens: DataFrame, by: list[str], order: list, width: int, flag: str, kind: str,
                 score: str) -> DataFrame:
    """Fixed chunks of tokens: any flag, kind of the first flagged token, mean."""
    placed = with_position(tokens, by, order, name="tok").withColumn("chunk", F.floor(F.col("tok") / width))
    return placed.groupBy(*by, "chunk").agg(
        F.max(F.col(flag).cast("int")).cast("bigint").alias("label"),
        F.min_by(kind, F.when(F.col(flag), F.col("tok"))).alias("kind"),
        F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n_tokens"))


def low_runs(tokens: DataFrame, by: list[str], order: list[str], value: str, threshold: float, shortest: int) -> DataFrame:
    """Unbroken runs of low relative coverage, at least ``shortest`` long."""
    tokens = cut(tokens.select(*by, *order, value))  # read for the largest values and for the rows
    top = tokens.groupBy(*by).agg(F.max(value).alias("_top"))
    scaled = tokens.join(top, by).withColumn("coverage", F.col(value) / F.col("_top")).drop("_top")
    # position and number of the run come from one pass along the order
    low = F.col("coverage") < threshold
    placed = running_sums(scaled, by, order, {"pos": F.lit(1).cast("bigint"), "run": 1 - low.cast("bigint")}).filter(low)
    return placed.groupBy(*by, "run").agg(
        (F.min("pos") - 1).alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n_tokens"),
        F.avg("coverage").alias("mean_coverage")).filter(F.col("n_tokens") >= shortest).drop("run")


def span_means(series: DataFrame, spans: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Mean of a positioned series over [start, end): two look-ups of prefix sums.

    ``series`` holds (by, pos); the spans are clamped to it and empty ones get
    NULL.  No token-by-span pairs are formed.
    """
    sums = running_sums(series, by, ["pos"], {"acc": value}).select(*by, "pos", "acc")
    size = series.groupBy(*by).agg((F.max("pos") + 1).alias("_n"))
    cut = spans.join(size, by).withColumn("_a", F.least("start", "_n")).withColumn("_z", F.least("end", "_n"))
    low = sums.select(*by, (F.col("pos") + 1).alias("_a"), F.col("acc").alias("_lo"))
    high = sums.select(*by, (F.col("pos") + 1).alias("_z"), F.col("acc").alias("_hi"))
    out = cut.join(low, [*by, "_a"], "left").join(high, [*by, "_z"], "left")
    total = F.coalesce("_hi", F.lit(0)) - F.coalesce("_lo", F.lit(0))
    return out.withColumn("mean", F.when(F.col("_z") > F.col("_a"), total.cast("double") / (F.col("_z") - F.col("_a")))) \
        .select(*spans.columns, "mean")
