"""Near-duplicate documents by SimHash fingerprints and anchor-point covering.

1. A text's fingerprint has bit i set if bit i is set in over half of the XXH64
   values of its word shingles, repeats included.
2. Equal fingerprints are one node, combined on the map side.
3. A pair that differs in at most 3 bits differs in at most one bit of one of
   its 32-bit halves.  On each half the anchors are the words of a covering
   code: the perfect Hamming code on 31 bits (every word is within R = 1 of
   exactly one code word) times the free 32nd bit.  A half goes to every anchor
   within R + 1, 17 at most, so both members of such a pair meet at the anchor
   nearest to either.  A code over all 64 bits at once would need at least
   Vol(R + 3) / Vol(R) copies of every fingerprint by the sphere bound, 180
   with 3.6e9 anchors (R = 8), or fewer with anchors that hold a large share of
   all fingerprints (4.6 copies and 13 % at R = 24).
4. Members of an anchor, sorted together, are compared on all 64 bits.  Only
   links that join two parts of a group leave the task, at most one a member.
   A group above ``tile`` members is dealt into tiles, every pair of tiles
   compared by a task of its own.
5. Alternating stars join the links; the smallest id of a component names it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import components
from ..sources.durable import cut
from .words import LOWER, joined, small_batches, text_bytes, word_spans

SEED = 42
DISTANCE = 3


def shingle_spans(begin: np.ndarray, end: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every ``size``-word shingle of words laid out one after another; a shorter row is one shingle."""
    count = np.bincount(row, minlength=n_rows)
    length = np.minimum(size, count)
    at = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    first = np.flatnonzero(at <= (count - length)[row])
    return begin[first], end[first + length[row[first]] - 1], row[first]


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray, size: int, step: int = 1 << 16) -> np.ndarray:
    """64-bit SimHash of every row's bytes; shingles are counted ``step`` at a time."""
    n = len(offsets) - 1
    starts, ends, row = word_spans(data, offsets)
    buffer, begin = joined(data, starts, ends)
    first, last, owner = shingle_spans(begin, begin + (ends - starts), row, n, size)
    text, digest = buffer.tobytes(), xxhash.xxh64_intdigest
    ones = np.zeros((n, 64), np.int64)
    for at in range(0, len(first), step):
        spans = zip(first[at:at + step].tolist(), last[at:at + step].tolist())
        values = np.fromiter((digest(text[s:e], SEED) for s, e in spans), np.uint64)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = owner[at:at + step]
        cuts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        ones[who[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    total = np.bincount(owner, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(_id, fp long): a NULL text and one without words have fingerprint 0."""
    def run(batches):
        for batch in small_batches(batches, "_text"):
            data, offsets = text_bytes(batch.column(1))
            prints = fingerprint_rows(LOWER[data], offsets, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, fp long")


def flips() -> np.ndarray:
    """(32, 16) bit patterns of weight 1 or 2 by syndrome: what leads from a word to the code words within 2 of it.

    Position p of the Hamming code carries the syndrome p, so one flip at p = s
    or two at positions whose exclusive or is s end in a code word.  Syndrome 0
    is a code word itself and no other is within 2.
    """
    table = np.zeros((32, 16), np.uint32)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        table[s] = [1 << (s - 1)] + [1 << (i - 1) | 1 << (j - 1) for i, j in pairs]
    return table


FLIPS = flips()
CHECKS = np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1) for b in range(5)], np.uint32)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and anchor of every copy of 32-bit words: the code words within R + 1 = 2."""
    word, free = half & np.uint32(0x7FFFFFFF), (half >> np.uint32(31)).astype(np.int64)
    syndrome = sum((np.bitwise_count(word & check).astype(np.int64) & 1) << b for b, check in enumerate(CHECKS))
    codes = (word[:, None] ^ FLIPS[syndrome]).astype(np.int64)
    near = np.concatenate([codes | (free << 31)[:, None], (codes[:, :1] | ((1 - free) << 31)[:, None])], axis=1)
    real = np.ones(near.shape, bool)
    real[syndrome == 0, 1:16] = False
    return np.nonzero(real)[0], near[real]


def to_anchors(prints: DataFrame) -> DataFrame:
    """(anchor, fp): both halves of every fingerprint at all their anchors."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                fp = whole.column(0).slice(at, 1 << 14).to_numpy().view(np.uint64)
                for side in (0, 1):
                    who, anchor = anchors((fp >> np.uint64(32 * side)).astype(np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | side << 32), pa.array(fp[who].view(np.int64))], names=["anchor", "fp"])

    return prints.mapInArrow(run, "anchor long, fp long")


def forest(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all members of a group that ``distance`` links; groups are runs of equal values.

    Members k places apart are compared for all groups at once; a pair already
    joined leaves nothing.
    """
    parent = np.arange(len(fp))
    a, b = [], []
    here = np.arange(len(fp) - 1)
    k = 1
    while True:
        here = here[here + k < len(fp)]
        here = here[group[here] == group[here + k]]
        if not len(here):
            break
        close = here[np.bitwise_count(fp[here] ^ fp[here + k]) <= distance]
        close = close[parent[close] != parent[close + k]]
        for i, j in zip(parent[close].tolist(), parent[close + k].tolist()):
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            if i != j:
                parent[max(i, j)] = min(i, j)
                a.append(fp[i])
                b.append(fp[j])
        if len(close):
            while (parent[parent] != parent).any():
                parent = parent[parent]
        k += 1
    return np.array(a, np.uint64), np.array(b, np.uint64)


def as_links(a: np.ndarray, b: np.ndarray, anchor: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([none if anchor is None else pa.array(anchor), pa.array(a.view(np.int64)),
                                       none if b is None else pa.array(b.view(np.int64))], names=["anchor", "a", "b"])


def meet(placed: DataFrame, distance: int, tile: int) -> DataFrame:
    """(anchor, a, b): links (anchor NULL), and the members of groups above ``tile`` (b NULL) for ``meet_tiles``."""
    def run(batches):
        anchor, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        over = None
        for batch in chain_end(batches):
            if batch is not None:
                anchor = np.concatenate([anchor, batch.column(0).to_numpy()])
                fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(anchor):
                continue
            start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.diff(np.append(start, len(anchor)))
            large = (size > tile) | (anchor[start] == over if over is not None else False)
            done = len(anchor) if batch is None or large[-1] else start[-1]
            over = anchor[-1] if large[-1] else None
            big = np.repeat(large, size)[:done]
            if big.any():
                yield as_links(fp[:done][big], None, anchor[:done][big])
            small = np.repeat((size > 1) & ~large, size)[:done]
            if small.any():
                yield as_links(*forest(anchor[:done][small], fp[:done][small], distance))
            anchor, fp = anchor[done:], fp[done:]

    return placed.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(run, "anchor long, a long, b long")


def chain_end(batches):
    """The batches and then None."""
    yield from batches
    yield None


def meet_tiles(members: DataFrame, distance: int, tile: int) -> DataFrame:
    """(a, b) links of large groups: every pair of tiles is one bounded group."""
    def run(key, table):
        a, b = forest(np.zeros(table.num_rows), np.unique(table.column("fp").to_numpy()).view(np.uint64), distance)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    count = members.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = members.join(count, "anchor").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")) \
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("anchor", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp") \
        .groupBy("anchor", "lo", "hi").applyInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = DISTANCE,
                   tile: int = 2048) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, shingles ``size`` words
    joined by one space (a shorter text is one shingle).  Texts without words,
    empty and NULL ones have fingerprint 0 and are linked like any other.
    Fingerprints are linked at ``distance`` or fewer differing bits, 3 at most;
    ``component_id`` is the smallest id reachable, NULL where no id is.  Repeated
    rows and ids share their text's component, ties have no meaning, an empty
    table gives an empty one, other columns are not read.  Long texts are read
    whole, their shingles counted in steps.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the anchors cover up to 3 differing bits")
    prints = cut(fingerprints(docs, id_col, text_col, size))
    nodes = prints.groupBy("fp").agg(F.min("_id").alias("least"))
    met = cut(meet(to_anchors(nodes.select("fp")), distance, tile))
    links = met.filter("anchor is null").select("a", "b")
    members = met.filter("anchor is not null").select("anchor", F.col("a").alias("fp"))
    if not members.isEmpty():
        links = links.unionByName(meet_tiles(members, distance, tile))
    placed = nodes.join(components(links, "a", "b").withColumnRenamed("id", "fp"), "fp", "left") \
        .withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the rows that carry the smallest id of their component; rows without id stay."""
    gone = simhash_groups(docs, id_col, text_col, **options).filter(F.col("component_id") != F.col(id_col)) \
        .select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
