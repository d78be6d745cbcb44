"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find grouping.

1. Every row's set of word shingles gets a SuperMinHash signature (Ertl 2017):
   element e draws a random permutation of the slots and places rank j plus a
   fraction at its j-th slot; a slot keeps the least value.  The ranks of one
   element are correlated, which lowers the variance, and a document stops at
   the first rank that cannot lower any slot.
2. Rows with the same set are collapsed to the smallest id, combined on the map
   side, so that a hot group of copies meets the rest as one row.
3. Equal bands make candidates.  Every bucket first links its members to its
   smallest id only; the candidates are verified on the full sets.
4. Where a bucket still holds several components, a member picked by hash stands
   for it: the members of other components are compared with it, and components
   that a link joins are merged.  A round melts a large family down to few
   components and makes at most one pair per member and bucket; ``TURNS`` of
   them are run, more would add small stages.
5. Members of buckets that are still mixed also meet by an
   exact filter: with every set in order of rarity, two sets can only be similar
   enough if what follows their first common shingle is long enough in both.  No
   pair inside a component is made: it could not change the grouping.
6. Verified links are grouped: union-find inside each task leaves a forest,
   alternating stars join the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import components, few
from ..sources.durable import cut
from .words import LOWER, mix, shingles, small_batches, span_codes, text_bytes, word_spans

GOLD = 0x9E3779B97F4A7C15
TURNS = 1
KEY = "_id_and_digest"
ROWS_PER_TASK = 10_000


def superminhash(row: np.ndarray, element: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """(n_rows, slots) signatures of sets given as (row, 64-bit element); infinite where a row is empty."""
    sig = np.full(n_rows * slots, np.inf)
    perm = None
    for j in range(slots):
        if not len(row):
            break
        seed = mix(element + np.uint64((2 * j + 1) * GOLD % 2**64))
        fraction = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = mix(seed + np.uint64(GOLD))
        k = j + ((pick >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            each = np.arange(len(row))
            slot = perm[each, k]
            perm[each, k] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, row * slots + slot, fraction + j)
        worst = sig.reshape(n_rows, slots).max(1)
        going = worst[row] >= j + 1
        if j == 0:
            row, element, k = row[going], element[going], k[going]
            perm = np.tile(np.arange(slots, dtype=np.int16), (len(row), 1))
            each = np.arange(len(row))
            perm[each, k] = 0
            perm[:, 0] = k
        elif not going.all():
            row, element, perm = row[going], element[going], perm[going]
    return sig.reshape(n_rows, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of every band of every signature."""
    code = mix(np.ascontiguousarray(sig).view(np.uint64) + np.uint64(7))
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(3) + code[:, b * rows + j])
        keys[:, b] = key
    return keys


def set_sums(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum modulo 2**64 of the mixed elements of every row; rows are sorted."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(1)), dtype=np.uint64)])
    ends = np.cumsum(np.bincount(row, minlength=n_rows))
    return run[ends] - run[np.concatenate([[0], ends[:-1]])] if n_rows else run[:0]


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(_id, n_shingles, f1, f2, bands): set size, set fingerprints from two hashes of the words, band keys."""
    def run(batches):
        for batch in small_batches(batches, "_text"):
            data, offsets = text_bytes(batch.column(1))
            data = LOWER[data]
            starts, ends, row = word_spans(data, offsets)
            n = batch.num_rows
            second = shingles(span_codes(data, starts, ends, 1), row, n, size)
            row, value = shingles(span_codes(data, starts, ends), row, n, size)
            count = np.bincount(row, minlength=n)
            f1, f2 = set_sums(row, value, n), set_sums(*second, n)
            keys = band_keys(superminhash(row, value, n, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))],
                names=["_id", "n_shingles", "f1", "f2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        run, f"_id {kind}, n_shingles long, f1 long, f2 long, bands array<long>")


PARITY = [f"m{i}" for i in range(8)]


def parity_map(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows, 8) longs: for each of 512 hash slots whether an odd number of the row's elements falls into it.

    Two maps differ in at most as many bits as the sets differ in elements.
    """
    slot = (mix(value + np.uint64(13)) >> np.uint64(55)).astype(np.int64)
    odd = np.bincount(row * 512 + slot, minlength=512 * n_rows).reshape(n_rows, 512) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(_id, set array<long>, parity map) of (_id, _text)."""
    def run(batches):
        for batch in small_batches(batches, "_text"):
            data, offsets = text_bytes(batch.column(1))
            data = LOWER[data]
            starts, ends, row = word_spans(data, offsets)
            row, value = shingles(span_codes(data, starts, ends), row, batch.num_rows, size)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            odd = parity_map(row, value, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(value.view(np.int64))), *[pa.array(odd[:, i]) for i in range(8)]], names=["_id", "set", *PARITY])

    return texts.mapInArrow(run, f"_id {texts.schema['_id'].dataType.simpleString()}, set array<long>, " + ", ".join(f"{m} long" for m in PARITY))


def possible_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components whose sets may reach ``percent``; none that does is left out.

    Every set is ordered by how many of the crowd hold a shingle, the rarest
    first.  If the first common shingle of two sets is at places i and j, they
    share at most min(n - i, m - j).  So only the places up to which a set could
    still reach the bound are joined, and only pairs that can reach it pass.
    Of what they share at most (n + m - d) / 2 is left when their parity maps
    differ in d bits, which sorts out most of the rest; both bounds are exact.
    """
    held = sets.join(crowd.withColumnRenamed("rep", "_id"), "_id").select("_id", "comp", F.size("set").alias("n"), F.explode("set").alias("e"))
    often = held.groupBy("e").agg(F.count(F.lit(1)).alias("often"))
    ranked = held.join(often, "e").groupBy("_id", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("often", "e"))).alias("order"))
    reach = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    first = ranked.select("_id", "comp", "n", F.posexplode(F.slice("order", F.lit(1), reach)).alias("i", "x")).filter("x.often > 1") \
        .select("_id", "comp", "n", "i", F.col("x.e").alias("e"))
    first = first.join(sets.select("_id", *PARITY), "_id")
    x, y = (first.select(F.col("_id").alias(s), F.col("comp").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("i").alias(f"i{s}"), F.col("e").alias(f"e{s}"),
                         *[F.col(m).alias(m + s) for m in PARITY]) for s in "ab")
    differ = sum((F.bit_count(F.col(m + "a").bitwiseXOR(F.col(m + "b"))) for m in PARITY[1:]), F.bit_count(F.col("m0a").bitwiseXOR(F.col("m0b"))))
    both = F.col("na") + F.col("nb")
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"), F.floor((both - differ) / 2))
    met = x.join(y, (F.col("ea") == F.col("eb")) & (F.col("ca") < F.col("cb")) & (most * (100 + percent) >= both * percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """The (a, b) pairs with 100 * |intersection| >= percent * |union| on the full sets."""
    plain = sets.select("_id", "set")
    met = few(pairs.join(plain.toDF("b", "sb"), "b"), tasks).join(plain.toDF("a", "sa"), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return met.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def local_forest(links: DataFrame) -> DataFrame:
    """Union-find inside each task: links that say the same with at most one link per node."""
    def run(batches):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in parent if find(x) != x]
        kind = links_kind
        yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], kind), pa.array(nodes, kind)], names=["a", "b"])

    links_kind = pa.int64() if links.schema["a"].dataType.simpleString() == "bigint" else None
    kind = links.schema["a"].dataType.simpleString()
    return links.mapInArrow(run, f"a {kind}, b {kind}")


def mixed_buckets(placed: DataFrame) -> DataFrame:
    """(key) of the buckets that hold several components."""
    return placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")


def picked_pairs(placed: DataFrame, turn: int, tasks: int | None = None) -> DataFrame:
    """(a, b): in every bucket of several components, one member picked by hash and each member of another component."""
    picked = F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", F.lit(turn)))
    buckets = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), picked.alias("p")).filter("lo < hi")
    pairs = placed.join(buckets, "key").filter(F.col("comp") != F.col("p.comp")) \
        .select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"))
    return few(few(pairs, tasks).distinct(), tasks)


def merged(comps: DataFrame, links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(rep, comp) after the components that the (a, b) links join are one."""
    a, b = (comps.select(F.col("rep").alias(s), F.col("comp").alias(f"c{s}")) for s in "ab")
    joined = components(few(few(links.join(a, "a"), tasks).join(b, "b"), tasks), "ca", "cb", tasks=tasks)
    return comps.join(few(joined, tasks).withColumnRenamed("id", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                bands: int = 30, rows: int = 4) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered.  Two rows are linked
    when their sets of distinct ``size``-word shingles reach ``percent`` percent
    of their union; a row with fewer words has its whole sequence as one
    shingle, a NULL text or one without words is linked with nothing.  The
    smallest id of a component stays; where rows repeat an id, the smallest text
    decides its links.  30 bands of 4 miss a pair of similarity
    0.8 with probability 1e-7, one of 0.85 with 2e-10.  A NULL id is its own.
    Very long texts are read whole, ties have no meaning, an empty table gives
    an empty one.  Other columns are not read.
    """
    wide = cut(sketch(docs, id_col, text_col, size, bands, rows))
    # a step of many partitions leaves files for each, which outweigh few rows
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-wide.count() // ROWS_PER_TASK))

    def held(df):
        return few(cut(few(df, tasks)), tasks)

    wide = few(wide, tasks)
    same = ["n_shingles", "f1", "f2"]
    filled = wide.filter("n_shingles > 0 and _id is not null")
    reps = held(filled.groupBy(*same).agg(F.min("_id").alias("rep"), F.first("bands").alias("bands")))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = held(few(keys.withColumnRenamed("rep", "b").join(buckets, "key").filter("a <> b").select("a", "b"), tasks).distinct())
    # members of shared buckets are the only rows whose sets can be asked for
    asked = held(stars.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(asked, "_id", "left_semi")
    sets = held(shingle_sets(texts.groupBy("_id").agg(F.min("_text").alias("_text")), size))
    links = held(local_forest(few(verified(stars, sets, percent, tasks), tasks)))
    found = few(components(links, "a", "b", tasks=tasks), tasks)

    near = reps.join(asked.withColumnRenamed("_id", "rep"), "rep", "left_semi").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    placed = held(near.select("rep", F.coalesce("component", "rep").alias("comp"), F.explode("bands").alias("key")))
    # components only merge, so a bucket of one stays one and is done with
    live = held(placed.join(mixed_buckets(placed), "key", "left_semi"))
    comps = few(live.select("rep", "comp").distinct(), tasks)
    for turn in range(TURNS):
        more = held(verified(picked_pairs(live, turn, tasks), sets, percent, tasks))
        if more.isEmpty():
            break
        comps = held(merged(comps, more, tasks))
        live = few(live.select("rep", "key").join(comps, "rep"), tasks)
        live = held(live.join(mixed_buckets(live), "key", "left_semi"))
    crowd = held(live.select("rep", "comp").distinct())
    rest = few(possible_pairs(crowd, sets, percent).join(stars, ["a", "b"], "left_anti"), tasks)
    more = held(verified(rest, sets, percent, tasks))
    comps = held(merged(comps, more, tasks)) if not more.isEmpty() else comps
    # a merge moves whole components, also their members outside the mixed buckets
    before = held(placed.select("rep", "comp").distinct())
    moved = few(before.join(comps.withColumnRenamed("comp", "now"), "rep"), tasks).groupBy("comp").agg(F.min("now").alias("now"))
    found = few(before.join(moved, "comp", "left").select(F.col("rep").alias("id"), F.coalesce("now", "comp").alias("component")), tasks)
    return wide.select("_id", *same).join(reps.select(*same, "rep"), same, "left") \
        .join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
            F.col("_id").alias(id_col), "n_shingles",
            F.when(F.col("_id").isNull() | (F.col("n_shingles") == 0), F.col("_id")).otherwise(F.coalesce("component", "rep")).alias("component_id")) \
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate component; rows without id stay.

    Where ids repeat, rows are told apart by id and digest of the text instead,
    so that an id with two texts does not lose the one that has no near copy.
    """
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter(F.col(id_col).isNotNull() & (F.col("n") > 1)).isEmpty():
        gone = near_groups(docs, id_col, text_col, **options).filter(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
        return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    keyed = docs.withColumn(KEY, F.when(F.col(id_col).isNotNull(), F.concat_ws(":", F.col(id_col).cast("string"), F.sha2(F.coalesce(
        F.col(text_col).cast("string"), F.lit("")), 256))))
    gone = near_groups(keyed, KEY, text_col, **options).filter(~F.col("kept")).select(F.col(KEY).alias("_gone")).distinct()
    return keyed.join(gone, keyed[KEY] == gone["_gone"], "left_anti").drop(KEY)
