"""The prefix trie of conversations: which turns they share from the start.

1. A turn is known by 16 bytes of a digest of its role and text, so that a
   conversation is a byte string of fixed-width big-endian turn ids.
2. Sequences are range-partitioned by (key, conversation); copies of one
   sequence are packed, so that a hot one is spread over tasks and leaves each
   as a few long rows.
3. After a second range partitioning, by key alone, every task runs through its
   sorted keys in chunks of bounded size and builds an adaptive radix tree
   (``radix.py``) of each chunk.  Compressed paths are unrolled: every
   turn-aligned byte depth is a node, no other depth is.
4. A chunk knows all about its nodes except those on the way to its first and
   last key, which other chunks may share.  These open nodes, two paths a chunk,
   are merged by a digest of their path; what is counted once for a node goes to
   its ancestors from the least chunk that holds it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.durable import cut
from .radix import Node, insert, preorder, walk

WIDTH = 16
CHUNK_BYTES = 2 << 20
PACK_BYTES = 1 << 12
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits: the first half of the SHA-256 of role and text, NULL as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * WIDTH))


def sequences(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns array<struct<id, len>>): the turns of each conversation in order.

    A NULL order comes first; turns of equal order follow role and digest.  Rows
    without a conversation belong to none.
    """
    slim = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.struct(
            F.col(order).isNotNull().alias("given"), F.col(order).alias("at"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            turn_id(F.col(role), F.col(text)).alias("id"), F.coalesce(F.length(F.col(text).cast("string")), F.lit(0)).alias("len")).alias("t"))
    return slim.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t")) \
        .select("conv", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["len"].alias("len"))).alias("turns"))


def rebuilt(seqs: DataFrame, every: int = 100, spread: int = 6) -> DataFrame:
    """Sequences whose first h turns are those of conversation c - c % every; h = crc32(decimal c) % spread."""
    heads = seqs.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, spread - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % spread).cast("int")
    own = seqs.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    return own.join(heads, "base", "left").select("conv", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def rows_of(batches):
    """The rows of Arrow batches, one after another."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


PACKED = "key binary, lens array<int>, lo long, n long, ids string"


def packed(seqs: DataFrame) -> DataFrame:
    """Copies of a sequence in rows of up to ``PACK_BYTES`` of their ids, ascending; no order between rows is lost."""
    def run(batches):
        rows, held = [], None
        for key, conv, lens in rows_of(batches):
            name = str(conv)
            if held and held[0] == key and held[5] < PACK_BYTES:
                held[3] += 1
                held[4].append(name)
                held[5] += len(name) + 1
                continue
            if held:
                rows.append(held)
            held = [key, lens, conv, 1, [name], len(name)]
            if len(rows) == 1024:
                yield as_packed(rows)
                rows = []
        if held:
            rows.append(held)
        if rows:
            yield as_packed(rows)

    def as_packed(rows):
        cols = [[r[i] for r in rows] for i in range(4)] + [[",".join(r[4]) for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
            pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()))], names=["key", "lens", "lo", "n", "ids"])

    keyed = seqs.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), "conv",
                        F.transform("turns", lambda t: t["len"]).alias("lens"))
    return keyed.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(run, PACKED)


PARTS = [("chunk", pa.int64()), ("side", pa.int32()), ("depth", pa.int64()), ("fp", pa.string()), ("pfp", pa.string()), ("parent", pa.int64()),
         ("lo", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("len", pa.int64()),
         ("turn_id", pa.string()), ("ends", pa.string())]
PARTS_DDL = ", ".join(f"{n} {'int' if t == pa.int32() else 'long' if t == pa.int64() else 'string'}" for n, t in PARTS)


def path_digests(key: bytes) -> list[str]:
    """Digest of the first d turns for every d."""
    out, run = [], hashlib.sha256()
    out.append(run.hexdigest()[:32])
    for at in range(0, len(key), WIDTH):
        run.update(key[at:at + WIDTH])
        out.append(run.copy().hexdigest()[:32])
    return out


class Sum:
    """What a node of the radix tree holds: members, least member, lengths by depth, and its subtree without open nodes."""

    __slots__ = ("n", "lo", "lens", "leaves", "saved", "kids", "side", "at", "per_depth")

    def __init__(self):
        self.n, self.lo, self.lens, self.leaves, self.saved, self.kids, self.side, self.at, self.per_depth = 0, None, None, 0, 0, 0, None, 0, None


def chunk_nodes(keys: list, chunk: int) -> list[tuple]:
    """Rows of ``PARTS`` for a chunk of (key, lens, lo, n, ends), sorted by key.

    Closed nodes have ``side`` NULL and final numbers.  Open nodes (``side`` 0 on
    the way to both the first and the last key, 1 to the first, 2 to the last)
    have what the chunk adds: its members and the closed nodes below.
    """
    root = Node()
    for key, *value in keys:
        insert(root, key, value)
    for node in walk(root, keys[0][0]):
        node.note = Sum()
        node.note.side = 1
    for node in walk(root, keys[-1][0]):
        if node.note:
            node.note.side = 0
        else:
            node.note = Sum()
            node.note.side = 2
    order = []
    for node, above, parent in preorder(root):
        node.note = node.note or Sum()
        node.note.at = above
        order.append((node, above, above + (parent is not None) + len(node.prefix), parent))
    for node, above, end, parent in reversed(order):
        s = node.note
        if node.value:
            lens, lo, n, _ = node.value
            s.n, s.lo, s.lens = s.n + n, lo if s.lo is None else min(s.lo, lo), lens
        top = 0 if parent is None else above // WIDTH + 1
        s.per_depth = []
        for depth in range(end // WIDTH, top - 1, -1):
            length = s.lens[depth - 1] if depth else 0
            if s.side is None:
                s.leaves += not s.kids
                s.saved += (s.n - 1) * length
            s.per_depth.append((depth, s.kids, s.leaves, s.saved, length))
            s.kids = int(s.side is None)
        if parent is not None:
            p = parent.note
            p.n, p.leaves, p.saved, p.kids = p.n + s.n, p.leaves + s.leaves, p.saved + s.saved, p.kids + s.kids
            p.lo, p.lens = s.lo if p.lo is None else min(p.lo, s.lo), s.lens
    ways = {1: path_digests(keys[0][0]), 2: path_digests(keys[-1][0])}
    ways[0] = ways[1]
    rows = []
    base = {}  # the key bytes that lead to a node's children, by node
    for node, above, end, parent in order:
        s = node.note
        head, (up_lo, up_fp) = base.pop(id(node), (b"", (None, None)))
        path = head + node.prefix
        for depth, kids, leaves, saved, length in reversed(s.per_depth):
            name = path[(depth - 1) * WIDTH - (end - len(path)):depth * WIDTH - (end - len(path))].hex() if depth else None
            ends = node.value[3] if node.value and depth * WIDTH == end else None
            fp = None if s.side is None else ways[s.side][depth]
            rows.append((chunk, s.side, depth, fp, up_fp, up_lo, s.lo, s.n, kids, leaves, saved, length, name, ends))
            up_lo, up_fp = (s.lo, None) if fp is None else (None, fp)
        keep = end % WIDTH
        for byte, kid in node.children():
            base[id(kid)] = ((path[len(path) - keep:] if keep else b"") + bytes([byte]), (up_lo, up_fp))
    return rows


def trie_parts(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """Open and closed nodes of all chunks; ``rows`` are packed sequences."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(PARTS)], names=[n for n, _ in PARTS])

    def distinct(batches):
        """(key, lens, lo, n, digest of all ids) of every sequence; the ids pass through."""
        held = None
        for key, lens, lo, n, ids in rows_of(batches):
            if held and held[0] == key:
                held[3] += n
                held[4].update(b",")
            else:
                if held:
                    yield *held[:4], held[4].hexdigest()
                held = [key, lens, lo, n, hashlib.sha256()]
            held[4].update(ids.encode())
        if held:
            yield *held[:4], held[4].hexdigest()

    def run(batches):
        chunk, keys, size = TaskContext.get().partitionId() << 32, [], 0
        for one in distinct(batches):
            keys.append(one)
            size += len(one[0]) + 64
            if size >= chunk_bytes:
                yield from cut_up(chunk_nodes(keys, chunk))
                chunk, keys, size = chunk + 1, [], 0
        if keys:
            yield from cut_up(chunk_nodes(keys, chunk))

    def cut_up(rows):
        for at in range(0, len(rows), 8192):
            yield batch(rows[at:at + 8192])

    return rows.repartitionByRange("key").sortWithinPartitions("key", "lo").mapInArrow(run, PARTS_DDL)


def whole_nodes(opened: DataFrame) -> DataFrame:
    """Open nodes with final numbers from what their chunks hold of them."""
    merged = opened.groupBy("fp").agg(
        F.min(F.struct("chunk", "side")).alias("own"), F.first("depth").alias("depth"), F.max("pfp").alias("pfp"), F.min("lo").alias("lo"), F.sum("n").alias("n"),
        F.sum("kids").alias("kids"), F.max("len").alias("len"), F.max("turn_id").alias("turn_id"), F.max("ends").alias("ends"))
    below = merged.filter("pfp is not null").groupBy(F.col("pfp").alias("fp")).agg(F.count(F.lit(1)).alias("open_kids"))
    merged = merged.join(below, "fp", "left").withColumn("n_children", F.col("kids") + F.coalesce("open_kids", F.lit(0))).drop("kids", "open_kids")
    once = merged.select("fp", F.col("own.chunk").alias("chunk"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("len")).alias("save"))
    held = opened.select("chunk", "fp", "side", "depth", "leaves", "saved").join(once, ["chunk", "fp"], "left")
    deeper = Window.partitionBy("chunk", "side").orderBy(F.desc("depth"))
    chunk = Window.partitionBy("chunk")

    def under(own: str, closed: str) -> Column:
        """A node's share in a chunk: its closed nodes, and the open ones it owns on the node's path or beyond a fork."""
        value = F.coalesce(own, F.lit(0))
        fork = F.when(F.col("side") == 0, F.sum(F.when(F.col("side") > 0, value).otherwise(0)).over(chunk)).otherwise(0)
        return F.col(closed) + F.sum(value).over(deeper) + fork

    shares = held.select("fp", under("leaf", "leaves").alias("leaves"), under("save", "saved").alias("saved"))
    totals = shares.groupBy("fp").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = merged.select(F.col("fp").alias("pfp"), F.col("lo").alias("parent"))
    return merged.join(totals, "fp").join(parents, "pfp", "left")


def prefix_trie(seqs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per distinct prefix of the sequences (conv, turns array<struct<id, len>>), conv long and unique.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and turn_id, the id of the last turn
    (``turn_id`` of role and text, by which ``with_turns`` adds both).
    No sequence, no node: not even the root.  A sequence without turns is a
    member of the root only.  Repeated sequences are one path.
    """
    parts = cut(trie_parts(packed(seqs), chunk_bytes))
    opened = parts.filter("side is not null")
    whole = cut(whole_nodes(opened))
    # a chunk's own copy of its open nodes' least members, so that no node is a hot key for the closed nodes below it
    known = opened.select("chunk", F.col("fp").alias("pfp")).distinct().join(whole.select(F.col("fp").alias("pfp"), F.col("lo").alias("open_parent")), "pfp")
    closed = parts.filter("side is null").join(known, ["chunk", "pfp"], "left").select(
        F.col("lo").alias("conv_id"), "depth", F.coalesce("parent", "open_parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends", "turn_id")
    rest = whole.select(F.col("lo").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        "n_children", "n_leaves", "saved_tokens", "ends", "turn_id")
    return closed.unionByName(rest).withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).drop("ends")


def with_turns(nodes: DataFrame, turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Nodes with the role and text of their last turn (NULL at the root)."""
    known = turns.select(turn_id(F.col(role), F.col(text)).alias("turn_id"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).dropDuplicates(["turn_id"])
    return nodes.join(known, "turn_id", "left")
