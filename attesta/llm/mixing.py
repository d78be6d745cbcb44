"""Mixing sources to target weights from fixed-length token blocks.

Every source's documents, in a pseudorandom order, form one stream of words
that is cut into blocks of ``block`` words.  An output shard has a fixed number
of slots; a multinomial draw gives the slots of each source.  The k-th slot of
a source takes block P(k mod blocks), where P is a pseudorandom permutation of
the source's block indices, a new one for each pass over the source.  Slots and
blocks are joined by (source, block).

Only one row per source reaches the driver (``most_sources`` at most, else an
error); block indices are never listed there, a permutation is a function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import id_bucket, running_sums
from ..sources.durable import cut
from .words import mix

WORD = r"[^\x20\x09-\x0D]+"


def share_out(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Targets that share the total by weight, none above ``most`` times its size; excess is reshared."""
    total, open_ones, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_ones:
        weight = sum(weights[i] for i in open_ones)
        full = {i for i in open_ones if weights[i] * left / weight > most * sizes[i]}
        for i in full:
            target[i] = most * sizes[i]
        if not full:
            for i in open_ones:
                target[i] = weights[i] * left / weight
            break
        open_ones -= full
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_ones)
    return target


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(size), one per key: a Feistel network that walks until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    at = index.astype(np.uint64)
    todo = np.arange(len(at))
    while len(todo):
        left, right = at[todo] >> half[todo], at[todo] & mask[todo]
        for turn in range(4):
            left, right = right, left ^ (mix(right + key[todo] * np.uint64(31) + np.uint64(turn * 0x51ED270B)) & mask[todo])
        at[todo] = left << half[todo] | right
        todo = todo[at[todo] >= size[todo].astype(np.uint64)]
    return at.astype(np.int64)


def source_plan(sized: DataFrame, weights: list[float], most: float, block: int, most_sources: int) -> list[dict]:
    """Per source, by code point with NULL last: size, target, blocks and slots."""
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    sizes = [r["size"] for r in found]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    plan = []
    for r, target in zip(found, targets):
        blocks = -(-r["size"] // block)
        slots = min(int(most * blocks), round(target * blocks / r["size"])) if r["size"] else 0
        plan.append({"source": r["source"], "size": r["size"], "target": float(target), "blocks": blocks, "slots": slots})
    return plan


def placed(sized: DataFrame, plan: list[dict], per_bucket: int = 10_000) -> DataFrame:
    """``sized`` with the source's number and the offset of its first word in the source's stream."""
    spark = sized.sparkSession
    names = spark.createDataFrame([(p["source"], i) for i, p in enumerate(plan)], f"_s {sized.schema['source'].dataType.simpleString()}, sid int")
    known = sized.join(names, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    buckets = max(1, sized.count() // per_bucket)
    keyed = known.withColumn("_o", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    return running_sums(keyed, ["sid"], ["_o", "id", "size"], {"_end": F.col("size")}, F.col("_o")) \
        .select("id", "size", "sid", (F.col("_end") - F.col("size")).alias("start"))


def slots(spark, plan: list[dict], per_shard: int, seed: int) -> DataFrame:
    """(shard, slot, sid, block): which block fills each slot of each output shard."""
    quota = np.array([p["slots"] for p in plan], np.int64)
    blocks = np.array([max(1, p["blocks"]) for p in plan], np.int64)
    total = int(quota.sum())
    shards = -(-total // per_shard)

    def draw(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(per_shard, total - shard * per_shard)
                got = np.random.default_rng([seed, shard]).multinomial(n, quota / total)
                sid = np.flatnonzero(got)
                first = np.cumsum(got)[sid] - got[sid]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), shard)), pa.array(sid.astype(np.int32)), pa.array(got[sid]),
                                                  pa.array(first)], names=["shard", "sid", "n", "slot"])

    if not total:
        return spark.createDataFrame([], "shard long, slot long, sid int, block long")
    drawn = cut(spark.range(shards).mapInArrow(draw, "shard long, sid int, n long, slot long"))
    sums = {r["sid"]: r["n"] for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).collect()}
    made = np.array([sums.get(i, 0) for i in range(len(plan))], np.int64)
    over, under = np.maximum(made - quota, 0), np.maximum(quota - made, 0)
    over_first, under_end = np.cumsum(over) - over, np.cumsum(under)

    def fill(batches):
        for batch in batches:
            shard, sid, n, slot, end = (batch.column(i).to_numpy() for i in range(5))
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            s, k = sid[row].astype(np.int64), (end - n)[row] + step
            # draws beyond a source's slots go to the sources that drew too few, in order
            spare = k >= quota[s]
            g = over_first[s] + k - quota[s]
            other = np.minimum(np.searchsorted(under_end, g, "right"), len(plan) - 1)
            k = np.where(spare, made[other] + g - (under_end - under)[other], k)
            s = np.where(spare, other, s)
            key = mix(s.astype(np.uint64) * np.uint64(1_000_003) + (k // blocks[s]).astype(np.uint64) + np.uint64(seed << 32))
            at = permuted(k % blocks[s], blocks[s], key)
            yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(slot[row] + step), pa.array(s.astype(np.int32)), pa.array(at)],
                                             names=["shard", "slot", "sid", "block"])

    numbered = running_sums(drawn, ["sid"], ["shard"], {"end": F.col("n")}, id_bucket(F.col("shard")))
    return numbered.select("shard", "sid", "n", "slot", "end").mapInArrow(fill, "shard long, slot long, sid int, block long")


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def pieces_of(at: DataFrame, block: int) -> DataFrame:
    """(sid, block, start, id, low, high): the words low <= i < high of a document that lie in a block."""
    spans = at.filter("size > 0").select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    low = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    return spans.select("sid", "block", "start", "id", low.alias("low"), high.alias("high"))


def mixture(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0, block: int = 128, per_shard: int = 1024, seed: int = 7,
            id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_sources: int = 100_000):
    """(placed rows, plan, slots), the parts from which the digest and the texts are made."""
    sized = cut(sized_rows(docs, id_col, text_col, source_col))
    plan = source_plan(sized, list(weights), most, block, most_sources)
    at = cut(placed(sized, plan)) if plan else None
    return sized, at, plan, slots(docs.sparkSession, plan, per_shard, seed)


def mix_digest(docs: DataFrame, id_col: str = "doc_id", block: int = 128, **options) -> DataFrame:
    """(id, source, size, source_size, target, taken), one row per row of ``docs``.

    A NULL or empty text has size 0 and is never taken; a NULL source is a
    source, the last one.  No row is taken more than ``most`` times.  Rows that
    repeat an id are rows of their own; other columns are not read.
    """
    sized, at, plan, filled = mixture(docs, id_col=id_col, block=block, **options)
    kind = sized.schema["source"].dataType.simpleString()
    if at is None:
        return sized.select(F.col("id").alias(id_col), "source", "size", F.lit(0).cast("long").alias("source_size"),
                            F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    times = filled.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces_of(at, block).join(times, ["sid", "block"]).groupBy("sid", "start").agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    sources = docs.sparkSession.createDataFrame([(i, p["source"], p["size"], p["target"]) for i, p in enumerate(plan)],
                                                f"sid int, source {kind}, source_size long, target double")
    full = at.filter("size > 0").join(taken, ["sid", "start"], "left").unionByName(at.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return full.join(sources, "sid").select(F.col("id").alias(id_col), "source", "size", "source_size", "target",
                                            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 128, **options) -> DataFrame:
    """(shard, slot, source, text): the mixed blocks themselves, words joined by a space.  Ids must be unique."""
    _, at, plan, filled = mixture(docs, id_col=id_col, text_col=text_col, block=block, **options)
    if at is None:
        return docs.sparkSession.createDataFrame([], "shard long, slot long, source string, text string")
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"))
    cutouts = pieces_of(at, block).join(docs.select(F.col(id_col).alias("id"), words.alias("w")), "id") \
        .select("sid", "block", "start", F.array_join(F.slice("w", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")), " ").alias("words"))
    whole = cutouts.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("p")) \
        .select("sid", "block", F.array_join(F.col("p.words"), " ").alias("text"))
    sources = docs.sparkSession.createDataFrame([(i, p["source"]) for i, p in enumerate(plan)], "sid int, source string")
    return filled.join(whole, ["sid", "block"]).join(sources, "sid").select("shard", "slot", "source", "text")
