"""Phrase collocations by prefix-free parsing.

1. Every text is parsed into chunks: a word whose hash falls on a fixed residue
   begins one, whatever stands around it, so that passages shared by many texts
   give the same chunks.  A chunk owns the words up to the next one and carries
   the ``longest`` - 1 words after them, as far as their piece goes.  An n-gram
   belongs to the chunk that owns its first word, so overlaps count once.
2. Distinct chunks and how often each was parsed form the dictionary, combined
   on the map side; it is written once, and all counting reads it, every n-gram
   weighted by its chunk's frequency.
3. Words are counted first, then n-grams of growing length whose two parts of
   n - 1 words are frequent.  The frequent parts reach the tasks as a bitmap of
   hashes, 16 MB at most: a false hit is counted and dropped later, nothing is
   lost.  Counts are keyed by the words themselves, combined in the task, then
   by Spark.
4. Scores and the test against longer candidates are joins of the frequent
   phrases with each other; ranks are cut per salt of a language first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.durable import cut, written
from .words import LOWER, joined, mix, sliced, small_batches, span_codes, text_bytes, word_spans

TRIGGER = 32
BATCH_BYTES = 4 << 20
MOST_BITS = 1 << 27
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
GAPS = BREAKS.copy()
GAPS[list(b" \t")] = True
BETWEEN = np.zeros(256, bool)
BETWEEN[list(b" \n")] = True
LINE_END = np.zeros(256, bool)
LINE_END[10] = True
TOTAL = ""


def piece_starts(data: np.ndarray, starts: np.ndarray, row: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Whether a word is the first of its piece."""
    seen = np.cumsum(breaks[data])[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (seen[1:] != seen[:-1]) | (row[1:] != row[:-1])
    return first


def run_ends(first: np.ndarray) -> np.ndarray:
    """For every word the index after the last of its run; ``first`` marks where runs begin."""
    at = np.append(np.flatnonzero(first), len(first))
    return np.repeat(at[1:], np.diff(at))


def parse(docs: DataFrame, text_col: str, lang_col: str, longest: int, trigger: int) -> DataFrame:
    """(lang, chunk, owned): chunks of words joined by a space, or by a line feed where a piece ends, and the words they own."""
    def run(batches):
        for batch in small_batches(batches, "_text"):
            data, offsets = text_bytes(batch.column(1))
            data = LOWER[data]
            starts, ends, row = word_spans(data, offsets, GAPS)
            if not len(starts):
                continue
            fresh = piece_starts(data, starts, row, BREAKS)
            buffer, begin = joined(data, starts, ends)
            end = begin + (ends - starts)
            buffer[end[:-1][fresh[1:]]] = 10
            opens = span_codes(data, starts, ends) % np.uint64(trigger) == 0
            opens[np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))] = True
            at = np.flatnonzero(opens)
            after = np.append(at[1:], len(starts))
            last = np.minimum(after + longest - 1, run_ends(fresh)[after - 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), sliced(buffer, begin[at], end[last - 1]),
                                              pa.array((after - at).astype(np.int32))], names=["lang", "chunk", "owned"])

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "lang string, chunk string, owned int")


def gram_codes(codes: np.ndarray, n: int) -> list[np.ndarray]:
    """Hashes of the 1- to n-grams that begin at every word (those that run over the end are of no use)."""
    out = [codes]
    for k in range(1, n):
        out.append(mix(out[-1] * np.uint64(3) + np.append(codes[k:], np.zeros(k, np.uint64))))
    return out


def seen(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = codes & np.uint64(64 * len(bitmap) - 1)
    return bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


def lang_codes(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    return span_codes(data, offsets[:-1], offsets[1:], 7)


def large_batches(batches, most_bytes: int):
    """Arrow batches put together up to about ``most_bytes``, so that one pass combines more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def count_grams(dictionary: DataFrame, n: int, frequent: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f) of the n-grams whose two (n - 1)-grams ``frequent`` may hold; for n = 1 also all words as phrase ''."""
    shared = dictionary.sparkSession.sparkContext.broadcast(frequent) if n > 1 else None

    def run(batches):
        for table in large_batches(small_batches(batches, "chunk"), BATCH_BYTES):
            if not table.num_rows:
                continue
            lang = table.column("lang").combine_chunks()
            data, offsets = text_bytes(table.column("chunk").combine_chunks())
            weight, owned = table.column("weight").to_numpy(), table.column("owned").to_numpy()
            starts, ends, row = word_spans(data, offsets, BETWEEN)
            count = np.bincount(row, minlength=len(owned))
            mine = np.arange(len(row)) - (np.cumsum(count) - count)[row] < owned[row]
            inside = run_ends(piece_starts(data, starts, row, LINE_END)) - np.arange(len(row)) >= n
            tongue = lang_codes(lang)
            codes = gram_codes(mix(span_codes(data, starts, ends) + tongue[row]), n)
            wanted = mine & inside
            if n > 1:
                hit = seen(shared.value, codes[n - 2])
                wanted &= hit & np.append(hit[1:], False)
            at = np.flatnonzero(wanted)
            keys = codes[n - 1][at]
            second = span_codes(data, starts, ends, 11)
            check = sum(second[at + k] * np.uint64(2 * k + 3) for k in range(n))
            order = np.argsort(keys, kind="stable")
            at, keys, check = at[order], keys[order], check[order]
            # equal hashes with another check are kept apart: Spark meets them by their words
            fresh = np.ones(len(at), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])
            head = np.flatnonzero(fresh)
            total = np.add.reduceat(weight[row[at]], head) if len(head) else np.zeros(0, np.int64)
            first = at[head]
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(row[first])), sliced(data, starts[first], ends[first + n - 1]), pa.array(total, pa.int64())],
                                             names=["lang", "phrase", "f"])
            if n == 1:
                sums = pa.table({"lang": lang, "f": pa.array(np.bincount(row[mine], minlength=len(owned)) * weight)}).group_by("lang").aggregate([("f", "sum")])
                yield pa.RecordBatch.from_arrays([sums.column("lang").combine_chunks(), pa.array([TOTAL] * len(sums)), sums.column("f_sum").combine_chunks()],
                                                 names=["lang", "phrase", "f"])

    return dictionary.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bitmap_of(phrases: DataFrame, n: int) -> np.ndarray:
    """Bitmap of the hashes of (lang, phrase): 16 bits or more a phrase, ``MOST_BITS`` (16 MB) at most."""
    size = 1 << 16
    rows = phrases.count()
    while size < min(16 * rows, MOST_BITS):
        size *= 2

    def run(batches):
        for batch in small_batches(batches, "phrase"):
            data, offsets = text_bytes(batch.column(1))
            starts, ends, row = word_spans(data, offsets, BETWEEN)
            codes = gram_codes(mix(span_codes(data, starts, ends) + lang_codes(batch.column(0))[row]), n)[n - 1][::n]
            yield pa.RecordBatch.from_arrays([pa.array((codes & np.uint64(size - 1)).view(np.int64))], names=["at"])

    words = phrases.select("lang", "phrase").mapInArrow(run, "at long").groupBy(F.expr("at div 64").alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(size // 64, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int, trigger: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``longest`` words with f >= ``least``, and (lang, n)."""
    dictionary = written(parse(docs, text_col, lang_col, longest, trigger).groupBy("lang", "chunk", "owned").agg(F.count(F.lit(1)).alias("weight")))
    levels, bitmap = [], None
    for n in range(1, longest + 1):
        level = cut(count_grams(dictionary, n, bitmap).filter((F.col("f") >= least) | (F.col("phrase") == TOTAL)))
        levels.append(level.withColumn("k", F.lit(n)))
        if n < longest:
            bitmap = bitmap_of(level.filter(F.col("phrase") != TOTAL), n)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return whole.filter(F.col("phrase") != TOTAL), levels[0].filter(F.col("phrase") == TOTAL).select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, top: int = 2000,
                 trigger: int = TRIGGER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations.

    A-Z are lowered; texts end a piece at ``[.,;:!?\\x0A-\\x0D]``, words are
    ``[^\\x20\\x09]+``.  n counts a language's words, a = f(phrase) all
    occurrences inside pieces.  Candidates have 2 to ``longest`` words and
    a >= ``least``; the cut with the lowest floor(1000 a n / (l r)) counts, the
    smallest first part on ties.  A candidate inside a longer one that is as
    frequent is dropped; as counts can only fall with length, the phrases one
    word longer decide.  NULL texts are empty, a NULL language is ``und``; an
    empty table gives no rows; repeated rows count each time; long texts and
    words are read whole; other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, longest, least, trigger)
    split = phrases.withColumn("w", F.split("phrase", " "))
    several = split.filter("k > 1")
    inner = several.filter("k > 2").select("lang", "f", F.explode(F.array(
        part(F.col("w"), F.lit(1), F.col("k") - 1), part(F.col("w"), F.lit(2), F.col("k") - 1))).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = several.join(inner, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * f").drop("longer")
    cuts = kept.select("lang", "phrase", "f", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c")) \
        .select("lang", "phrase", "f", "c", part(F.col("w"), F.lit(1), F.col("c")).alias("x"), part(F.col("w"), F.col("c") + 1, F.col("k")).alias("y"))
    known = phrases.select("lang", "phrase", "f")
    scored = cuts.join(known.toDF("lang", "x", "l"), ["lang", "x"]).join(known.toDF("lang", "y", "r"), ["lang", "y"]).join(totals, "lang") \
        .withColumn("score", F.expr("(cast(1000 as decimal(4, 0)) * cast(f as decimal(15, 0)) * cast(n as decimal(19, 0)))"
                                    " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    best = scored.groupBy("lang", "phrase", F.col("f").alias("a"), "n").agg(F.min(F.struct("score", "c", "l", "r")).alias("b")) \
        .select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    return salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
