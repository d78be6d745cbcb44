"""Tables that Spark derives from the given ones to exercise the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.digests import md5_heads
from ..sources.tables import spread, table

SLICE = 1 << 20  # bytes of text whose shingles are digested together

NOTE_HEADERS = ["Subjective", "Objective", "Assessment / Problem List", "Plan", "Follow-up"]


def note_column(key: Column, text: Column) -> Column:
    """A document as a note: every third line is preceded by a header line."""
    heads = F.array(*[F.lit(h) for h in NOTE_HEADERS])
    marked = F.transform(F.split(text, "\n"), lambda ln, i: F.concat(
        F.when(i % 3 == 0, F.concat(
            F.get(heads, ((F.floor(i / 3) + key) % 5).cast("int")), F.lit(":\n"))).otherwise(""), ln))
    return F.when(key % 7 == 0, text).otherwise(F.array_join(marked, "\n"))


def notes(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    return docs.select("doc_id", note_column(F.col("doc_id"), F.col("text")).alias("note"))


def documents(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    return spread(table(spark, root, "documents").select("doc_id", "text", *cols))


def document_sentences(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    """(doc_id, *cols, idx, s): one row per sentence of each document."""
    return documents(spark, root, *cols).select(
        "doc_id", *cols, F.posexplode(T.sentences(F.col("text"))).alias("idx", "s")
    ).withColumn("idx", F.col("idx").cast("bigint"))


def turn_sentences(spark: SparkSession, root: str) -> DataFrame:
    """(conv_id, turn, role, idx, s): one row per sentence of each turn."""
    return spread(table(spark, root, "conversations")).select(
        "conv_id", "turn", "role", F.posexplode(T.sentences(F.col("text"))).alias("idx", "s")
    ).withColumn("idx", F.col("idx").cast("bigint"))


def document_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, lang, v array<double>): signed counts of the three-word shingles of each text, dealt to 64 places by md5.

    Near copies get nearby vectors, unrelated texts do not.
    """
    rows = documents(spark, root, "lang").select("doc_id", "lang", F.arrow_udf(shingle_counts, "array<int>")(F.lower("text")).alias("v"))
    sums = rows.groupBy("doc_id", "lang").agg(*[F.sum(F.get("v", F.lit(i))).cast("double").alias(f"_{i}") for i in range(64)])
    return sums.select("doc_id", "lang", F.array(*[f"_{i}" for i in range(64)]).alias("v")).filter(F.exists("v", lambda x: x != 0))


def shingle_counts(texts: pa.Array) -> pa.Array:
    """64 signed counts of each text: md5 of a shingle, first byte modulo 64 the place, next digit below 8 plus; NULL has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, first = np.zeros((len(texts), 64), np.int32), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE, "right")) - 1)
        out[first:last] = _shingle_counts(data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first])
        first = last
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * 64), pa.array(out.ravel()))


def _shingle_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    plain = pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(rows)), pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
    lens = pc.binary_length(plain).to_numpy()
    data = np.frombuffer(b"".join(plain.to_pylist()), np.uint8)
    end = np.cumsum(lens)
    row = np.repeat(np.arange(len(lens)), lens)
    spaces = np.flatnonzero(data == 32)
    some = np.flatnonzero(lens)
    starts = np.sort(np.concatenate([spaces + 1, (end - lens)[some]]))
    ends = np.sort(np.concatenate([spaces, end[some]]))
    three = np.flatnonzero(row[starts[:-2]] == row[starts[2:]]) if len(starts) > 2 else np.zeros(0, np.int64)
    head = md5_heads(data, starts[three], ends[three + 2])
    place = row[starts[three]] * 64 + (head & np.uint32(63))
    return np.bincount(place, weights=1 - 2.0 * (head >> np.uint32(15) & np.uint32(1)), minlength=64 * len(lens)).astype(np.int32).reshape(-1, 64)


DOCUMENT_VECTORS_SQL = """dw AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
dg AS (SELECT doc_id, lang, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS h FROM (SELECT doc_id, lang, w, unnest(range(1, len(w) - 1)) AS i FROM dw)),
ds AS (SELECT doc_id, lang, ('0x' || h[1:2])::INT % 64 AS i, sum(CASE WHEN h[3:3] < '8' THEN 1 ELSE -1 END)::DOUBLE AS s FROM dg GROUP BY ALL),
dk AS (SELECT doc_id, lang, k AS i FROM (SELECT DISTINCT doc_id, lang FROM ds), range(64) r(k)),
dv AS (SELECT doc_id, lang, list(coalesce(s, 0) ORDER BY i) AS v FROM dk LEFT JOIN ds USING (doc_id, lang, i) GROUP BY ALL HAVING bool_or(coalesce(s, 0) <> 0)),
dn AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM dv),
dc AS (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, round(list_dot_product(a.v, b.v) / a.n / b.n, 9) AS cos FROM dn a JOIN dn b ON a.lang = b.lang AND a.doc_id < b.doc_id)"""
