"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered) and one end.  The model
is made of Chinese restaurants on two levels:

* Contexts.  Every word, and the end, is a restaurant for the word that follows
  it (the end stands before the first word too).  All distinct pairs of training
  words are seated, whatever their counts.
* Words.  All contexts share one parent restaurant.  Its base is uniform over
  all training types and one more, the unknown word.

Seating is sampled by Gibbs: in every sweep each dish of each restaurant is
seated anew, given all other tables and the parent's current predictions, and
its tables become the parent's customers.  Probabilities are averaged over the
sweeps after the first ones.

Nothing that grows with the corpus is held by the driver or by one task.  Words
are numbered in the order of their hash and bytes and dealt to owners by ranges
of the hash, pairs (first * words + second, exact) by a hash, some
``OWNED`` bytes of text each.  Tasks send each other packed columns of numbers:
a batch of texts asks the owners for its distinct words and pairs, owners of
pairs ask owners of words once per sweep.  Draws depend on the pair, so a batch
seats its own pairs again when it scores instead of being sent every table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import shared_folder
from .words import LOWER, mix, small_batches, span_codes, text_bytes

BATCH = 4 << 20  # bytes of text in a batch
OWNED = 24 << 20  # bytes of text whose words and pairs fall to one owner
END = b""


def seat(customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, draw) -> np.ndarray:
    """Tables of each dish after its customers sat down one after another.

    A customer opens a table with probability proportional to
    (strength + discount * tables in the restaurant) * base, or joins one.  Up
    to 20 customers come singly, later ones in groups of a twentieth of those
    seated, whose new tables are their expected number, rounded at random.
    ``draw`` gives uniform numbers for the dishes at these places and this step.
    """
    tables = (customers > 0).astype(np.int64)
    live, seated = np.flatnonzero(customers > 1), 1
    while len(live):
        group = np.minimum(max(1, seated // 20), customers[live] - seated)
        t = tables[live]
        fresh = (strength + discount * (others[live] + t)) * base[live]
        chance = fresh / (fresh + np.maximum(seated - discount * t, 1e-9))
        tables[live] = t + np.floor(group * chance + draw(live, seated)).astype(np.int64)
        seated += max(1, seated // 20)
        live = live[customers[live] > seated]
    return tables


def restaurant_sweep(count: np.ndarray, parent: np.ndarray, tables: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """One Gibbs sweep over restaurants (rows) and dishes (columns) given the parents' predictions."""
    at = np.nonzero(count)
    total = tables.sum(1)
    fresh = np.zeros_like(tables)
    fresh[at] = seat(count[at], parent[at], total[at[0]] - tables[at], discount, strength, lambda live, step: rng.random(len(live)))
    return fresh


def predictions(count: np.ndarray, tables: np.ndarray, parent: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """P(dish | restaurant) for all restaurants (rows); ``parent`` has the same shape."""
    seats, all_tables = count.sum(1, keepdims=True), tables.sum(1, keepdims=True)
    return (count - discount * tables + (strength + discount * all_tables) * parent) / (strength + seats)


class Hierarchy:
    """Restaurants in levels: level k has ``sizes[k]`` contexts, and context i's parent is i // (sizes[k] // sizes[k - 1])."""

    def __init__(self, sizes: list[int], dishes: int, discount: float = 0.6, strength: float = 1.0):
        self.sizes, self.dishes, self.discount, self.strength = sizes, dishes, discount, strength
        self.tables: list = [None] * len(sizes)

    def sample(self, count: np.ndarray, rng) -> np.ndarray:
        """One sweep, from the longest contexts to the shortest, then their predictions; ``count`` is of the longest."""
        counts, seats = [None] * len(self.sizes), count.astype(np.int64)
        for k in range(len(self.sizes) - 1, -1, -1):
            counts[k] = seats
            if self.tables[k] is None or (self.tables[k] > seats).any() or ((seats > 0) & (self.tables[k] == 0)).any():
                self.tables[k] = np.minimum(seats, 1)
            given = self.base(counts, k)
            self.tables[k] = restaurant_sweep(seats, given, self.tables[k], self.discount, self.strength, rng)
            if k:
                seats = self.tables[k].reshape(self.sizes[k - 1], -1, self.dishes).sum(1)
        current = np.full((1, self.dishes), 1 / self.dishes)
        for k, size in enumerate(self.sizes):
            spread = np.repeat(current, size // len(current), axis=0)
            current = predictions(counts[k], self.tables[k], spread, self.discount, self.strength)
        self.last = current
        return current

    def base(self, counts: list, k: int) -> np.ndarray:
        """What the parents of level k predict: from their last tables, or, at first, from one table per dish below."""
        current = np.full((1, self.dishes), 1 / self.dishes)
        for j in range(k):
            size = self.sizes[j]
            spread = np.repeat(current, size // len(current), axis=0)
            held = self.tables[j]
            if held is None:
                held = np.minimum(counts[k], 1).reshape(size, -1, self.dishes).sum(1)
            current = predictions(held, np.minimum(held, 1), spread, self.discount, self.strength)
        return np.repeat(current, self.sizes[k] // len(current), axis=0)


# --- packed columns ---------------------------------------------------------

MESSAGE = "kind int, to long, src long, x long, y long, a binary, b binary, c binary"
COLUMNS = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("to", "src", "x", "y")), *((n, pa.binary()) for n in "abc")])
NAMES = COLUMNS.names


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs, byte by byte of all and compressed."""
    top = int(values.max()) if len(values) else 0
    small = values.astype(np.min_scalar_type(top))
    planes = np.ascontiguousarray(small.view(np.uint8).reshape(len(small), small.dtype.itemsize).T)
    return small.dtype.itemsize.to_bytes(1, "little") + len(small).to_bytes(8, "little") + squeeze(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    """``pack`` undone, as int64; keys come back by ``keys``."""
    return _unpacked(blob).astype(np.int64)


def _unpacked(blob: bytes) -> np.ndarray:
    size, n = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(expand(blob[9:], size * n), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"u{size}").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned numbers as their steps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob).astype(np.uint64), dtype=np.uint64)


def squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def expand(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def messages(rows: list) -> pa.Table:
    """(kind, to, src, x, y, a, b, c), short rows filled up with NULL."""
    whole = [(*r, *[None] * (len(NAMES) - len(r))) for r in rows]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*whole) if whole else [[]] * len(NAMES), COLUMNS.types)], schema=COLUMNS)


def read(table: pa.Table) -> dict[int, list[dict]]:
    """Rows of a group by kind, each kind in the order of its senders."""
    found: dict = {}
    for row in table.to_pylist():
        found.setdefault(row["kind"], []).append(row)
    for rows in found.values():
        rows.sort(key=lambda r: (r["src"] is not None, r["src"]))
    return found


def joined(rows: list[dict], column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(unpack(r[column]) for r in rows)])


def split(of: np.ndarray, owners: np.ndarray):
    """(owner, slice) of each run of equal, ascending owners."""
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    for a, z in zip(first, np.append(first[1:], len(of))):
        yield int(owners[of[a]]) if owners is not None else int(of[a]), slice(a, z)


class Tables:
    """Tables of messages in the shared folder."""

    def __init__(self, spark, tasks: int):
        self.spark, self.tasks = spark, tasks
        self.folder = f"{shared_folder(spark)}/pitman-yor-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def meet(self, run, *sent: DataFrame, schema: str = MESSAGE) -> DataFrame:
        """What ``run`` makes of all messages to one receiver."""
        both = sent[0]
        for other in sent[1:]:
            both = both.unionByName(other, allowMissingColumns=True)
        return both.repartition(self.tasks, "to").groupBy("to").applyInArrow(run, schema)


def kind(df: DataFrame, number: int, as_kind: int | None = None, turned: bool = False) -> DataFrame:
    """Messages of a kind, perhaps as another kind, or sent back to where they came from."""
    out = df.filter(F.col("kind") == number)
    if turned:
        out = out.select("kind", F.col("src").alias("to"), F.col("to").alias("src"), "x", "y", "a", "b", "c")
    return out if as_kind is None else out.withColumn("kind", F.lit(as_kind))


# --- words ------------------------------------------------------------------

def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:]


def in_order(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct words by hash, then bytes, and their hashes in that order."""
    data, starts, ends = binary(words)
    code = span_codes(data, starts, ends)
    order = np.argsort(code, kind="stable")
    if (code[order][1:] == code[order][:-1]).any():
        order = np.array(sorted(range(len(code)), key=lambda i: (code[i], words[i].as_py())), np.int64)
    return order, code[order]


def tokens(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words with the end, word of each token, tokens of each text); every text ends in the end."""
    data, offsets = text_bytes(column)
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(LOWER[data])))
    flat = lists.flatten().cast(pa.large_binary())
    full = pc.greater(pc.binary_length(flat), 0)
    rows = pc.list_parent_indices(lists).to_numpy()[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    lens = np.bincount(rows, minlength=len(column)) + 1
    words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.large_binary())])
    line = np.full(int(lens.sum()), len(words) - 1, np.int64)
    inner = np.ones(len(line), bool)
    inner[np.cumsum(lens) - 1] = False
    line[inner] = coded.indices.to_numpy()
    return words, line, lens


def read_texts(docs: DataFrame, text: str, train: str, owners: int) -> DataFrame:
    """Kind 0: a batch of texts as numbers of its own words, with its ids; kind 1: its words and their training counts, to each owner."""
    id_col = docs.columns[0]
    id_type = docs.limit(0).select(id_col).toArrow().schema.field(0).type

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, text, BATCH):
            to, number = (part << 32) + number, number + 1
            words, line, lens = tokens(batch.column(1))
            order, code = in_order(words)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            line, words = place[line], words.take(pa.array(order))
            learnt = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.bincount(line, weights=np.repeat(learnt, lens), minlength=len(words)).astype(np.int64)
            rows = [(0, to, None, len(words), None, pack(lens), pack(line), pack(learnt))]
            data, starts, ends = binary(words)
            for owner, cut in split(owner_of(code, owners), None):
                blob = data[starts[cut][0]:ends[cut][-1]].tobytes()
                rows.append((1, owner, to, len(blob), None, pack((ends - starts)[cut]), squeeze(blob), pack(n[cut])))
            ids = pa.ListArray.from_arrays(pa.array([0] + [batch.num_rows] * len(rows), pa.int32()), batch.column(0).cast(id_type))
            out = messages(rows).append_column("ids", ids)
            yield from out.to_batches()

    kinds = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text, train).mapInArrow(run, f"{MESSAGE}, ids array<{kinds}>")


def owner_of(code: np.ndarray, owners: int) -> np.ndarray:
    """Owners by ranges of the hash, so that the numbers of words don't depend on how many there are."""
    return ((code >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def count_words(table: pa.Table) -> pa.Table:
    """An owner's words: kind 0 their training counts, in order; kind 1 to each batch their places and counts;
    kind 2 how many words training saw, once, twice."""
    asked, parts = read(table)[1], []
    for r in asked:
        lens = unpack(r["a"])
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(expand(r["b"], r["x"]))]))
    coded = pa.concat_arrays(parts).dictionary_encode()
    order, _ = in_order(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[coded.indices.to_numpy()]
    count = np.bincount(at, weights=joined(asked, "c"), minlength=len(order)).astype(np.int64)
    to = asked[0]["to"]
    out = [(0, to, None, len(order), int(count.sum()), pack(count)),
           (2, to, int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum()))]
    first = 0
    for r, part in zip(asked, parts):
        here, first = at[first:first + len(part)], first + len(part)
        out.append((1, r["src"], to, None, None, pack(here), pack(count[here])))
    return messages(out)


# --- pairs ------------------------------------------------------------------

class Numbering:
    """Numbers of words: the owners' words one after another."""

    def __init__(self, sizes: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.words, self.owners = int(self.first[-1]), len(sizes)
        if self.words >= 1 << 32:
            raise ValueError("a pair of words is one 64-bit number: at most 2 ** 32 words")

    def numbers(self, rows: list[dict]) -> np.ndarray:
        """Numbers of the words that owners answered for, from their places there."""
        return np.concatenate([np.zeros(0, np.int64), *(unpack(r["a"]) + self.first[r["src"]] for r in rows)])

    def dealt(self, numbers: np.ndarray):
        """(owner, slice) of ascending numbers."""
        return split(np.searchsorted(self.first, numbers, "right") - 1, None)

    def key(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first.astype(np.uint64) * np.uint64(self.words) + second.astype(np.uint64)

    def both(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.uint64(max(self.words, 1))
        return (pair // size).astype(np.int64), (pair % size).astype(np.int64)

    def pair_owners(self, pair: np.ndarray) -> np.ndarray:
        return (mix(pair) % np.uint64(self.owners)).astype(np.uint16 if self.owners < 1 << 16 else np.int64)


def batch_pairs(line: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a batch (first, second, ascending) and the pair that ends at each token."""
    before = np.concatenate([[line[-1]], line[:-1]])  # a text ends in the end, which begins the next one
    pair, at = np.unique(before * words + line, return_inverse=True)
    return pair // words, pair % words, at


def ask_pairs(numbering: Numbering):
    def run(table):
        got = read(table)
        head, number = got[0][0], numbering.numbers(got[1])
        line, lens = unpack(head["b"]), unpack(head["a"])
        first, second, at = batch_pairs(line, len(number))
        n = np.bincount(at, weights=np.repeat(unpack(head["c"]), lens), minlength=len(first)).astype(np.int64)
        pair = numbering.key(number[first], number[second])
        owner = numbering.pair_owners(pair)
        order = np.argsort(owner, kind="stable")
        return messages([(0, to, head["to"], None, None, pack_keys(pair[order[cut]]), pack(n[order[cut]])) for to, cut in split(owner[order], None)])
    return run


def count_pairs(numbering: Numbering):
    """Kind 0: training counts, to each batch; 1: the owner's pairs seen twice or more; 2 and 3, to owners of words:
    places of its words with the pairs they begin and end, and places of the words of kind 1; 4: pairs seen once, twice."""
    def run(table):
        asked = read(table)[0]
        me, asks = asked[0]["to"], [keys(r["a"]) for r in asked]
        pair, at = np.unique(np.concatenate(asks), return_inverse=True)
        n = np.bincount(at, weights=joined(asked, "b"), minlength=len(pair)).astype(np.int64)
        out, first = [], 0
        for r, mine in zip(asked, asks):
            out.append((0, r["src"], me, None, None, pack(n[at[first:first + len(mine)]])))
            first += len(mine)
        out.append((4, me, None, int((n == 1).sum()), int((n == 2).sum())))
        word, u, w = distinct(numbering, pair[n > 0])
        begun, ended = np.bincount(u, minlength=len(word)), np.bincount(w, minlength=len(word))
        out += [(2, to, me, None, None, pack(word[cut] - numbering.first[to]), pack(begun[cut]), pack(ended[cut])) for to, cut in numbering.dealt(word)]
        many = n > 1
        word, _, _ = distinct(numbering, pair[many])
        out += [(3, to, me, None, None, pack(word[cut] - numbering.first[to])) for to, cut in numbering.dealt(word)]
        if many.any():
            out.append((1, me, None, None, None, pack_keys(pair[many]), pack(n[many])))
        return messages(out)
    return run


def distinct(numbering: Numbering, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of pairs, ascending, and the places of the first and the second of each pair among them."""
    u, w = numbering.both(pair)
    word, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    return word, at[:len(u)], at[len(u):]


# --- Gibbs sweeps -----------------------------------------------------------

class Prior:
    """Discounts and totals that all tasks share."""

    def __init__(self, tokens: int, types: int, contexts: float, words: float, seed: int, strength: float = 1.0):
        self.tokens, self.types, self.contexts, self.words = tokens, types, contexts, words
        self.seed, self.strength = seed, strength

    def base(self, count):
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def seat_words(self, customers, number, before, tables: int, sweep: int):
        return seat(customers, np.full(len(customers), 1 / (self.types + 1)), tables - before, self.words, self.strength, self.draw(number.astype(np.uint64), 2 * sweep + 1))

    def predict(self, customers, tables, total: tuple[int, int]):
        """P(word) in the parent restaurant with ``total`` tables and customers."""
        rest = (self.strength + self.words * total[0]) / (self.types + 1)
        return (customers - self.words * tables + rest) / (self.strength + total[1])

    def seat_pairs(self, n, pair, word, others, sweep: int):
        return seat(n, word, others, self.contexts, self.strength, self.draw(pair, 2 * sweep))

    def draw(self, code, salt: int):
        code = mix(code)

        def uniform(live, step):
            return (mix(code[live] + np.uint64((step * 0x9E3779B97F4A7C15 + (self.seed + salt) * 0xD1342543DE82EF95) % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53

        return uniform


def discount_of(once: int, twice: int) -> float:
    """n1 / (n1 + 2 * n2) from what was seen once and twice, inside [0.05, 0.95]."""
    return min(0.95, max(0.05, (once + 0.5) / (once + 2 * twice + 1)))


def sweep_words(numbering: Numbering, prior: Prior, sweep: int, tables: int):
    """An owner's words: their tables as contexts and customers as dishes, from what pairs say, then their own tables.

    Kind 0: these three; kind 1: the same for the words an owner of pairs asked for.
    """
    def run(table):
        got = read(table)
        me = table.column("to")[0].as_py()
        size = int(numbering.first[me + 1] - numbering.first[me])
        if sweep == 0:
            opened, served = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for r in got.get(2, []):
                at = unpack(r["a"])
                opened[at] += unpack(r["b"])
                served[at] += unpack(r["c"])
            before = np.minimum(served, 1)
        else:
            start, last = got[5][0], got[6][0]
            opened, served, before = unpack(start["a"]), unpack(start["b"]), unpack(last["c"])
        asks = {r["src"]: unpack(r["a"]) for r in got.get(3, [])}
        for r in got.get(7, []):
            at = asks[r["src"]]
            opened[at] += unpack(r["a"])
            served[at] += unpack(r["b"])
        own = prior.seat_words(served, numbering.first[me] + np.arange(size), before, tables, sweep)
        out = [(0, me, sweep, int(own.sum()), int(served.sum()), pack(opened), pack(served), pack(own))]
        out += [(1, to, me, None, None, pack(opened[at]), pack(served[at]), pack(own[at])) for to, at in asks.items()]
        return messages(out)
    return run


def sweep_pairs(numbering: Numbering, prior: Prior, sweep: int, total: tuple[int, int]):
    """An owner's pairs seen twice or more, seated anew.  Kind 6: their tables; kind 7, to owners of words: tables beyond the first."""
    def run(table):
        got = read(table)
        me, pair, n = got[1][0]["to"], keys(got[1][0]["a"]), unpack(got[1][0]["b"])
        before = unpack(got[6][0]["a"]) if 6 in got else np.ones(len(n), np.int64)
        word, u, w = distinct(numbering, pair)
        opened, served, own = (joined(got[8], c) for c in "abc")
        tables = prior.seat_pairs(n, pair, prior.predict(served, own, total)[w], opened[u] - before, sweep)
        more = [np.bincount(x, weights=tables - 1, minlength=len(word)).astype(np.int64) for x in (u, w)]
        out = [(6, me, None, None, None, pack(tables))]
        out += [(7, to, me, None, None, pack(more[0][cut]), pack(more[1][cut])) for to, cut in numbering.dealt(word)]
        return messages(out)
    return run


def fit(store: Tables, words: DataFrame, pairs: DataFrame, numbering: Numbering, prior: Prior, sweeps: int) -> tuple[DataFrame, list]:
    """Seatings of all words after 0 .. ``sweeps`` sweeps over the pairs (kind 0, ``src`` the sweep), and the parent's tables and customers."""
    totals, seen, last = [], [], None
    for sweep in range(sweeps + 1):
        given = [kind(pairs, 2), kind(words, 0, 9)] if sweep == 0 else [kind(seen[0], 0, 5), kind(seen[-1], 0, 6), kind(last, 7)]
        tables = totals[-1][0] if totals else prior.types
        seen.append(store.write(f"words-{sweep}", store.meet(sweep_words(numbering, prior, sweep, tables), kind(pairs, 3), *given)))
        got = seen[-1].filter("kind = 0").agg(F.sum("x"), F.sum("y")).collect()[0]
        totals.append((got[0] or 0, got[1] or 0))
        if sweep < sweeps:
            held = [] if last is None else [kind(last, 6)]
            last = store.write(f"pairs-{sweep}", store.meet(sweep_pairs(numbering, prior, sweep, totals[-1]), kind(pairs, 1), kind(seen[-1], 1, 8), *held))
    history = kind(seen[0], 0)
    for other in seen[1:]:
        history = history.unionByName(kind(other, 0))
    return history, totals


# --- scores -----------------------------------------------------------------

def serve_words(table: pa.Table) -> pa.Table:
    """Kind 1, to each batch: places, counts and all seatings of its words."""
    got = read(table)
    held = [unpack(r[c]) for r in got[0] for c in "abc"]
    return messages([(1, r["src"], r["to"], None, None, r["a"], r["b"], pack(np.concatenate([x[at] for x in held])))
                     for r in got.get(1, []) for at in [unpack(r["a"])]])


def score_batch(numbering: Numbering, prior: Prior, totals: list, burn: int, out: pa.Schema):
    def run(table):
        got = read(table.drop_columns(["ids"]))
        ids = pc.list_flatten(table.filter(pc.equal(table.column("kind"), 0)).column("ids")).cast(out.field(0).type)
        head, number, count = got[0][0], numbering.numbers(got[1]), joined(got[1], "b")
        lens, line = unpack(head["a"]), unpack(head["b"])
        held = [unpack(r["c"]).reshape(3 * len(totals), -1) for r in got[1]]
        opened, served, own = np.concatenate(held, axis=1).reshape(len(totals), 3, -1).transpose(1, 0, 2)
        first, second, at = batch_pairs(line, len(number))
        pair = numbering.key(number[first], number[second])
        n = np.empty(len(pair), np.int64)
        n[np.argsort(numbering.pair_owners(pair), kind="stable")] = joined(got[2], "a")
        many = np.flatnonzero(n > 1)
        tables, p = np.minimum(n, 1), np.zeros(len(pair))
        for sweep in range(len(totals) - 1):
            word = prior.predict(served[sweep], own[sweep], totals[sweep])
            tables[many] = prior.seat_pairs(n[many], pair[many], word[second[many]], opened[sweep][first[many]] - tables[many], sweep)
            if sweep >= burn:
                word = prior.predict(served[sweep + 1], own[sweep + 1], totals[sweep + 1])
                rest = prior.strength + prior.contexts * opened[sweep + 1]
                p += (n - prior.contexts * tables + rest[first] * word[second]) / (prior.strength + count)[first]
        score = np.log10(p / (len(totals) - 1 - burn))
        begin = np.cumsum(lens) - lens
        sums = [np.add.reduceat(x, begin) for x in ((count > 0).astype(np.int64)[line], prior.base(count)[line], score[at])]
        return pa.table([ids, *map(pa.array, (lens, sums[0], np.full(len(lens), prior.tokens), sums[1], sums[2]))], schema=out)
    return run


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 4, burn: int = 2, seed: int = 11) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``; logarithms to base 10.

    ``train`` marks the rows to learn from (NULL: learn).  NULL and empty texts
    are an end alone; repeated rows are rows like others, for counts as well;
    other columns aren't read.  Without training rows every probability is that
    of the uniform base; all words that training never saw share one type.  Draws
    depend on ``seed`` and the words of the table, so reruns agree.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), F.coalesce(train, F.lit(True)).alias("_train"))
    size = given.agg(F.sum(F.octet_length("_text").cast("long"))).collect()[0][0] or 0
    owners = max(spark.sparkContext.defaultParallelism, -(-size // OWNED))  # by bytes: every batch writes to every owner
    store = Tables(spark, owners)
    texts = store.write("texts", read_texts(given, "_text", "_train", owners))
    batches = kind(texts, 0).drop("ids")
    words = store.write("words", store.meet(count_words, kind(texts, 1).drop("ids")))
    sizes = np.zeros(owners, np.int64)
    total = 0
    for r in words.filter("kind = 0").select("to", "x", "y").collect():
        sizes[r["to"]], total = r["x"], total + r["y"]
    numbering = Numbering(sizes)
    seen = words.filter("kind = 2").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("src", "x", "y")]).collect()[0]
    pairs = store.write("pairs", store.meet(count_pairs(numbering), store.meet(ask_pairs(numbering), batches, kind(words, 1))))
    twice = pairs.filter("kind = 4").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("x", "y")]).collect()[0]
    prior = Prior(total, seen[0], discount_of(*twice), discount_of(seen[1], seen[2]), seed)
    history, totals = fit(store, words, pairs, numbering, prior, sweeps)
    served = store.meet(serve_words, history, kind(words, 1, turned=True))
    result = f"`{id_col}` {given.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    shape = spark.createDataFrame([], result).toArrow().schema
    return store.meet(score_batch(numbering, prior, totals, burn, shape), kind(texts, 0), served, kind(pairs, 0, 2), schema=result)
