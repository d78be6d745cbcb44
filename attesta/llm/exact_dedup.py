"""Exact de-duplication by an exchange of Golomb-coded fingerprints.

1. Every row gets a 48-bit fingerprint of its text; the slim rows (id, digest,
   fingerprint, sending part) are written once, so that a recomputed task sees
   the same parts.
2. Each part sends to every owner of a fingerprint range its distinct
   fingerprints, sorted, as a Golomb-Rice code of the gaps, and whether it
   holds one twice itself.
3. An owner decodes all lists and answers each part with a bitmap: which of
   its fingerprints some other part, or the part itself, holds again.
4. Only suspects are shuffled with their texts and grouped by the texts
   themselves, byte for byte, combined on the map side first, so that a group
   of copies travels once per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut

BITS = 48
DIGEST = "_digest_of_the_text"


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Golomb-Rice code (parameter 2**k) of the gaps of sorted distinct integers.

    All quotients in unary (zeros, then a one) come first, then all k-bit
    remainders, so that both parts decode without a loop.
    """
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    ends = np.cumsum((gaps >> k) + 1)
    bits = np.zeros((int(ends[-1]) if len(ends) else 0) + k * len(gaps), np.uint8)
    bits[ends - 1] = 1
    if len(gaps) and k:
        bits[ends[-1]:] = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).ravel()
    return np.packbits(bits).tobytes()


def rice_decode(code: bytes, n: int, k: int) -> np.ndarray:
    """Inverse of ``rice_encode`` for ``n`` values."""
    if not n:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ones = np.flatnonzero(bits)[:n]
    low = bits[ones[-1] + 1:ones[-1] + 1 + k * n].reshape(n, k) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((np.diff(ones, prepend=-1) - 1 << k | low) + 1) - 1


def rice_parameter(n: int, span: int) -> int:
    """The parameter for ``n`` even gaps over ``span``."""
    return max(0, int(np.floor(np.log2(max(1.0, 0.69 * span / max(n, 1))))))


def slim_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("text_sha256"),
                       F.shiftrightunsigned(F.xxhash64(text), 64 - BITS).alias("_print"), F.spark_partition_id().alias("_part"))


def suspects(slim: DataFrame, per_owner: int = 1 << 20) -> DataFrame:
    """The fingerprints that occur more than once anywhere, found by the exchange."""
    rows = slim.count()
    owners = max(1, -(-rows // per_owner))
    width = -(-(1 << BITS) // owners)

    def send(key, table):
        part = key[0].as_py()
        prints, times = np.unique(table.column("_print").to_numpy(), return_counts=True)
        owner = prints // width
        rows = []
        for o in np.unique(owner):
            own = owner == o
            local = prints[own] - o * width
            k = rice_parameter(len(local), width)
            rows.append((int(o), part, len(local), k, rice_encode(local, k), np.packbits(times[own] > 1).tobytes()))
        return pa.Table.from_pylist([dict(zip(("owner", "part", "n", "k", "code", "twice"), r)) for r in rows], schema=pa.schema(
            [("owner", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("k", pa.int32()), ("code", pa.binary()), ("twice", pa.binary())]))

    def answer(key, table):
        lists, flags = [], []
        for n, k, code, twice in zip(*(table.column(c).to_pylist() for c in ("n", "k", "code", "twice"))):
            lists.append(rice_decode(code, n, k))
            flags.append(np.unpackbits(np.frombuffer(twice, np.uint8))[:n].astype(bool))
        found, where, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        again = (times[where] > 1) | np.concatenate(flags)
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        maps = [np.packbits(x).tobytes() for x in np.split(again, cuts)]
        return pa.table({"part": table.column("part"), "owner": table.column("owner"), "bitmap": pa.array(maps, pa.binary())})

    def read(key, table, answers):
        prints = np.unique(table.column("_print").to_numpy())
        owner = prints // width
        hit = np.zeros(len(prints), bool)
        for o, bitmap in zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist()):
            own = np.flatnonzero(owner == o)
            hit[own] = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:len(own)].astype(bool)
        ids = table.filter(pa.array(np.isin(table.column("_print").to_numpy(), prints[hit])))
        return ids.select(["_id", "_print", "text_sha256"])

    sent = slim.groupBy("_part").applyInArrow(send, "owner long, part int, n long, k int, code binary, twice binary")
    answers = sent.groupBy("owner").applyInArrow(answer, "part int, owner long, bitmap binary")
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.groupBy("_part").cogroup(answers.withColumnRenamed("part", "_part").groupBy("_part")).applyInArrow(
        read, f"_id {kind}, _print long, text_sha256 string")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_owner: int = 1 << 20) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    NULL counts as an empty text.  The largest id of equal texts stays; ids that
    are NULL never stay unless all of the group's are, and rows that repeat
    both id and text share one decision.  Other columns are not read.
    """
    slim = cut(slim_rows(docs, id_col, text_col))
    doubt = cut(suspects(slim, per_owner))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    # the same text is fetched once per suspect row; NULL ids are met by the digest instead
    fetched = texts.join(doubt.filter("_id is not null").select("_id").distinct(), "_id", "left_semi") \
        .unionByName(texts.filter("_id is null"))
    equal = fetched.groupBy("_text").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")) \
        .select(F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size").filter("group_size > 1")
    return slim.join(equal, "text_sha256", "left").select(
        F.col("_id").alias(id_col), F.coalesce("keep_id", "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "_id").eqNullSafe(F.col("_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: the one that ``exact_groups`` keeps.

    Rows are told apart by id and digest, so an id that carries two texts loses
    neither unless it is a copy, copies without id go, and of rows that repeat
    both one stays.  An empty table stays empty.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    marked = docs.withColumn(DIGEST, digest)
    groups = cut(exact_groups(docs, id_col, text_col).select(F.col(id_col).alias("_i"), F.col("text_sha256").alias("_t"), "kept", "group_size"))

    def same(rows):
        return marked[id_col].eqNullSafe(rows["_i"]) & (marked[DIGEST] == rows["_t"])

    gone = groups.filter(~F.col("kept")).select("_i", "_t").distinct()
    left = marked.join(gone, same(gone), "left_anti")
    again = groups.filter("kept and group_size > 1").groupBy("_i", "_t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not again.isEmpty():
        once = left.join(again, same(again), "left_semi").dropDuplicates([id_col, DIGEST])
        left = left.join(again, same(again), "left_anti").unionByName(once)
    return left.drop(DIGEST)
