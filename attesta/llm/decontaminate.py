"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments.  A text that holds a segment
of n characters with at most e edits shares at least n - q + 1 - e * q of its
q-grams, on diagonals that differ by at most e.  So the shared q-grams are
counted in diagonal bands that overlap by e; only segments whose count within a
band reaches the bound are verified by an alignment.  No occurrence within the
budget is lost.  The index holds each item once, however many segments it has.

Documents stay where they are: each task reads its texts once and compares them
with the benchmark, which travels to the tasks in slices of bounded size (one
pass over the documents per slice), so a benchmark of any size can be used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BYTE_CODE, LOWER, mix, powers, small_batches, text_bytes

#: Letters, digits and bytes of other scripts, in lower case; everything else is a separator.
SEPARATOR = np.ones(256, bool)
for _part in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    SEPARATOR[list(_part)] = False
SPACE = np.uint8(32)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with every run of separators as one space; the byte each comes from; new row offsets."""
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SEPARATOR[data]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[0] = True
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = np.flatnonzero(keep)
    out = np.where(gap[place], SPACE, LOWER[data[place]])
    return out, place, np.searchsorted(place, offsets)


def lower_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the column in lower case, code point by code point."""
    return text_bytes(pc.utf8_lower(column.cast(pa.large_string())))


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes from every position on."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:-1], out=run[1:])
    return mix((run[q:] - run[:-q]) * down[:len(data) - q + 1])


def cuts(line: np.ndarray, length: int, words: int, short: int, stride: int) -> list[tuple[int, int]]:
    """(first byte, size) of the segments of one item: see ``contaminated``."""
    last = max(0, len(line) - length)
    found = {(first, min(length, len(line))) for first in (*range(0, last, length // 2), last)}
    if words and len(line):
        solid = line != SPACE
        starts = np.flatnonzero(solid & ~np.append(False, solid[:-1])).tolist()
        ends = (np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1).tolist()
        for w, (start, after) in enumerate(zip(starts, [*starts[1:], len(line)])):
            for first in range(start, after, stride):
                end = first + short
                if first == start and w + words <= len(ends):
                    end = min(end, ends[w + words - 1])
                if end <= len(line):
                    found.add((first, end - first))
        found.add((max(0, len(line) - short), min(short, len(line))))  # spans reach the end of the item
    return sorted(found)


class Segments:
    """A slice of the benchmark: its items and an index of their q-grams, their segments with budgets and bounds."""

    def __init__(self, items: list[tuple], q: int, rate: float, length: int, words: int = 0, short: int = 64, stride: int = 16):
        self.q, self.item, self.line = q, [], []
        owner, at, size = [], [], []
        for item, text in items:
            data, offsets = lower_bytes(pa.array([text], pa.large_string()))
            line, _, _ = normal(data, offsets)
            line = np.frombuffer(line.tobytes().strip(), np.uint8)
            if len(line) < q:
                continue
            for first, n in cuts(line, length, words, short, stride):
                if n >= q:
                    owner.append(len(self.line))
                    at.append(first)
                    size.append(n)
            self.item.append(item)
            self.line.append(line)
        self.at, self.size = np.array(at, np.int64), np.array(size, np.int64)
        # the lemma needs a bound of at least one shared q-gram
        self.budget = np.minimum((self.size * rate).astype(np.int64), np.maximum(0, (self.size - q) // q))
        self.bound = self.size - q + 1 - self.budget * q
        #: where the segments of each item begin; the most edits and the least bound of any of them
        self.cut = np.searchsorted(np.array(owner, np.int64), np.arange(len(self.line) + 1))
        self.most = np.maximum.reduceat(self.budget, self.cut[:-1]) if self.line else self.budget
        self.least = np.minimum.reduceat(self.bound, self.cut[:-1]) if self.line else self.bound
        grams = [gram_hashes(t, q) for t in self.line]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, self.pos = owner[order], pos[order]
        self.keys, self.first, self.times = np.unique(flat[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item number and position in the item of every shared q-gram."""
        place = np.flatnonzero(self.seen[(grams >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(self.keys, grams[place])
        at[at == len(self.keys)] = 0
        good = self.keys[at] == grams[place] if len(self.keys) else np.zeros(0, bool)
        place, at = place[good], at[good]
        n = self.times[at]
        posting = np.repeat(self.first[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(place, n), self.owner[posting], self.pos[posting]


def banded_distance(pattern: bytes, window: bytes) -> list[int]:
    """Least edits of ``pattern`` against a part of ``window`` that ends at each place; ends are free on both sides.

    ``window`` already is the band's region, so it is short.  One number holds
    the differences down a whole column (Myers' bit vectors).
    """
    top, full = 1 << (len(pattern) - 1), (1 << len(pattern)) - 1
    equal: dict[int, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, cost = full, 0, len(pattern)
    out = [cost]
    for c in window:
        eq = equal.get(c, 0)
        down = eq | minus
        along = (((eq & plus) + plus) ^ plus) | eq
        up, less = minus | (full & ~(along | plus)), plus & along
        cost += bool(up & top) - bool(less & top)
        up, less = up << 1, less << 1
        plus, minus = (less | ~(down | up)) & full, up & down & full
        out.append(cost)
    return out


def matches(segments: Segments, data: np.ndarray, offsets: np.ndarray, once: bool = False) -> list[tuple]:
    """(row, segment, item number, first, end, edits) with positions in ``data``, verified; ``once``: one a row is enough."""
    q = segments.q
    place, owner, pos = segments.hits(gram_hashes(data, q))
    row = np.searchsorted(offsets, place, "right") - 1
    inside = place + q <= offsets[row + 1]
    place, owner, pos, row = place[inside], owner[inside], pos[inside], row[inside]
    if not len(place):
        return []
    width = segments.most[owner] + 1  # bands of 2 * width diagonals, one every width
    band = (place - pos) // width
    key = np.concatenate([np.stack([row, owner, band, pos]), np.stack([row, owner, band - 1, pos])], axis=1)
    order = np.lexsort(key[::-1])
    key = key[:, order]
    fresh = np.ones(key.shape[1], bool)
    fresh[1:] = (key[:3, 1:] != key[:3, :-1]).any(0)
    starts = np.flatnonzero(fresh)
    count = np.diff(starts, append=key.shape[1])
    many = count >= segments.least[key[1, starts]]
    found, done, rows = {}, {}, set()
    for k, n_hits in zip(starts[many].tolist(), count[many].tolist()):
        r, item, b = key[:3, k].tolist()
        if once and r in rows:
            continue
        shared, first, last = key[3, k:k + n_hits], segments.cut[item], segments.cut[item + 1]
        at, size = segments.at[first:last], segments.size[first:last]
        inside = np.searchsorted(shared, at + size - q, "right") - np.searchsorted(shared, at)
        line, wide = segments.line[item].tobytes(), int(segments.most[item]) + 1
        for s in (first + np.flatnonzero(inside >= segments.bound[first:last])).tolist():
            e, n, begin = int(segments.budget[s]), int(segments.size[s]), int(segments.at[s])
            text = line[begin:begin + n]
            low = max(int(offsets[r]), b * wide + begin - e)
            high = min(int(offsets[r + 1]), (b + 2) * wide + begin + n + e)
            window = data[low:high].tobytes()
            whole = window.find(text)
            if whole >= 0:  # an exact copy needs no alignment
                hit = (low + whole, low + whole + n, 0)
            elif not e or any(low <= x < high for x in done.get((r, s), ())):  # met in the band before
                continue
            else:
                cost = banded_distance(text, window)
                edits = min(cost)
                if edits > e:
                    continue
                end = cost.index(edits)
                back = banded_distance(text[::-1], window[:end][::-1])
                hit = (low + end - back.index(min(back)), low + end, edits)
            found[r, s, hit[0]] = (r, s, item, *hit)
            done.setdefault((r, s), []).append(hit[0])
            rows.add(r)
            if once:
                break
    return list(found.values())


def merged(segments: Segments, found: list[tuple], place: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> list[tuple]:
    """(row, item, start, end, edits, segments): touching spans of one item in one text, in characters of the text."""
    out = []
    for r, item, lo, hi, edits in sorted(((r, segments.item[i], lo, hi, edits) for r, _, i, lo, hi, edits in found), key=lambda x: (x[0], repr(x[1]), x[2], x[3])):
        if out and out[-1][:2] == [r, item] and lo <= out[-1][3]:
            out[-1][3:] = [max(out[-1][3], hi), max(out[-1][4], edits), out[-1][5] + 1]
        else:
            out.append([r, item, lo, hi, edits, 1])
    head = {}
    for x in out:
        r, first = x[0], int(offsets[x[0]])
        chars = head.setdefault(r, np.cumsum((data[first:int(offsets[r + 1])] & 0xC0) != 0x80))
        a, z = int(place[x[2]]) - first, int(place[x[3] - 1]) - first
        x[2], x[3] = int(chars[a]) - 1, int(chars[z])
    return [tuple(x) for x in out]


def benchmark_slices(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int):
    """The benchmark in slices that hold about ``most_bytes`` each, so that every slice is bounded."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    parts = -(-total // most_bytes)
    for k in range(parts):
        yield [(r["item"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).orderBy("item", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", q: int = 12, rate: float = 0.05, length: int = 120, most_bytes: int = 1 << 24, words: int = 0) -> DataFrame:
    """(id, item_id, start, end, edits, segments): the parts of texts that repeat parts of the benchmark.

    Texts are compared in lower case, with everything but letters and digits as
    one space.  A segment of ``length`` characters (the whole item, if shorter)
    matches with up to ``rate`` times its length edits; touching spans of one
    item are one row, ``start`` and ``end`` count characters of the text.  So
    any run of 1.5 * ``length`` characters of an item is found.

    ``words`` adds short segments: from every word start of an item (and every
    16 bytes of a longer word) on, that many words or 64 bytes, whichever ends
    first.  Then every run that holds ``words`` whole words of an item, or 80
    bytes without them, is found as well, wherever it begins.  Items of fewer
    than ``q`` characters and NULL texts match nothing; a NULL id is reported as
    it is; a repeated row is reported again.  Other columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, start long, end long, edits long, segments long"
    found = None
    for items in benchmark_slices(benchmark, item_col, item_text, most_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Segments(items, q, rate, length, words))

        def run(batches, index=index):
            for batch in small_batches(batches, "_text"):
                raw, at = lower_bytes(batch.column(1))
                data, place, offsets = normal(raw, at)
                rows = merged(index.value, matches(index.value, data, offsets), place, at, raw)
                if rows:
                    ids = batch.column(0).take(pa.array([x[0] for x in rows]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in rows]), *[pa.array([x[j] for x in rows], pa.int64()) for j in range(2, 6)]],
                                                     names=[id_col, item_col, "start", "end", "edits", "segments"])

        part = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      q: int = 12, rate: float = 0.05, length: int = 120, most_bytes: int = 1 << 24, words: int = 0) -> DataFrame:
    """``docs`` without the rows whose text ``contaminated`` reports; nothing is shuffled."""
    at = docs.columns.index(text_col)
    for items in benchmark_slices(benchmark, item_col, item_text, most_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Segments(items, q, rate, length, words))

        def run(batches, index=index):
            for batch in small_batches(batches, text_col):
                data, _, offsets = normal(*lower_bytes(batch.column(at)))
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in matches(index.value, data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
