"""Exact vector search with pruned lists.

Some vectors of a block serve as pivots (one in 16 and more where these are far
away, some thousands at most); every vector is at home in the list of its
nearest one.  On unit vectors the
chord |a - b| is a metric and cos = 1 - |a - b|^2 / 2, so two bounds say which
lists another vector has to visit to miss nothing within a distance r:

* ball: a list whose members all lie within R of pivot p only holds something
  within r if d(v, p) <= R + r;
* cell: a member of p's list is at least as near to p as to v's own pivot, so
  something within r of v only lies there if d(v, p) <= d(v, home) + 2 r.

Clustered vectors visit few lists and the pairs scored grow well below the
square; vectors without any structure in many dimensions visit most lists, no
exact method saves them from that.  The visits are matrix products between
chunks of bounded size (``vectors.py``); only answers leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.durable import cut
from .vectors import CHUNK, _kernel, _meet

MOST_PIVOTS = 4096
ONE_IN = 16
FAR = 0.5  # a chord beyond which a vector may get a pivot nearer by
SLACK = 1e-6  # for rounding; a list too many changes nothing


def unit(vectors) -> np.ndarray:
    a = np.stack(vectors).astype("float64")
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def pivots_of(vectors: DataFrame, block: str) -> DataFrame:
    """(block, pivot, pvec): one vector in ``ONE_IN`` picked by hash, then one in two of those that are far from all of these.

    About ``MOST_PIVOTS`` of a block in each turn at most; its smallest id is always one.
    """
    sizes = cut(vectors.groupBy(block).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_least")))

    def picked(rows, one_in):
        every = F.greatest(F.lit(float(one_in)), F.ceil(F.col("_n").cast("double") / MOST_PIVOTS))
        return rows.join(sizes, block).filter((F.pmod(F.xxhash64("id", F.lit(5)), every) < 1) | (F.col("id") == F.col("_least"))) \
            .select(block, F.col("id").alias("pivot"), F.col("vec").alias("pvec"))

    first = cut(picked(vectors, ONE_IN))
    far = vectors.join(homes(vectors, first, block).filter(F.col("d") > FAR).select(block, "id"), [block, "id"])
    more = picked(far, 2).join(first.select(block, "pivot"), [block, "pivot"], "left_anti").select(block, "pivot", "pvec")
    return first.unionByName(more)


def by_pivots(vectors: DataFrame, pivots: DataFrame, block: str, columns: str, answer) -> DataFrame:
    """What ``answer(rows, pivot ids, distances, pivot rows)`` says of chunks of vectors that meet all pivots of their block."""
    kind = dict(vectors.dtypes)[block]
    sizes = vectors.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_m"))
    dealt = vectors.join(sizes, block).withColumn("_c", F.pmod(F.xxhash64("id", F.lit(9)), "_m")).drop("_m")
    copies = pivots.join(sizes, block).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m").cast("bigint") - 1))).drop("_m")

    def run(left, right):
        if not len(left) or not len(right):
            kinds = {"bigint": "int64", "double": "float64"}
            return pd.DataFrame({block: pd.Series(dtype="object"), **{n: pd.Series(dtype=kinds[k]) for n, k in (c.split() for c in columns.split(", "))}})
        right = right.sort_values("pivot")
        out = answer(left, right["pivot"].to_numpy(), chord(unit(left["vec"]), unit(right["pvec"])), right)
        return pd.DataFrame({block: pd.Series([left[block].iloc[0]] * len(out["id"]), dtype="object"), **out})

    dealt, copies = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (dealt, copies))  # both may come from one table
    return dealt.groupBy(block, "_c").cogroup(copies.groupBy(block, "_c")).applyInPandas(run, f"{block} {kind}, {columns}")


def homes(vectors: DataFrame, pivots: DataFrame, block: str) -> DataFrame:
    """(block, id, home, d): the nearest pivot of every vector, the smallest id on ties."""
    def nearest(left, ids, d, _):
        at = d.argmin(axis=1)
        return {"id": left["id"].to_numpy(), "home": ids[at], "d": d[np.arange(len(at)), at]}

    return by_pivots(vectors, pivots, block, "id bigint, home bigint, d double", nearest)


def visits(vectors: DataFrame, pivots: DataFrame, block: str, earlier: bool) -> DataFrame:
    """(block, id, list): the lists besides its own that a vector with ``home``, ``d`` and reach ``r`` has to visit.

    With ``earlier`` only lists of smaller pivots: of two vectors at home in
    different lists, the one of the larger pivot then visits the other.
    """
    def reached(left, ids, d, right):
        r = left["r"].to_numpy()[:, None]
        near = (d <= right["radius"].to_numpy()[None, :] + r + SLACK) & (d <= left["d"].to_numpy()[:, None] + 2 * r + SLACK)
        home = left["home"].to_numpy()[:, None]
        near &= ids[None, :] < home if earlier else ids[None, :] != home
        i, j = np.nonzero(near)
        return {"id": left["id"].to_numpy()[i], "list": ids[j]}

    return by_pivots(vectors, pivots, block, "id bigint, list bigint", reached)


def listed(df: DataFrame, block: str, pivot: str) -> DataFrame:
    """With ``_l``, the block and pivot of a list as one key."""
    return df.withColumn("_l", F.concat_ws(":", F.coalesce(F.col(block).cast("string"), F.lit("")), F.col(pivot).cast("string")))


def prepared(vectors: DataFrame, block: str, idc: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with their home, and pivots with the radius of their list."""
    plain = vectors.select(block, F.col(idc).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    pivots = cut(pivots_of(plain, block))
    at_home = cut(plain.join(homes(plain, pivots, block), [block, "id"]))
    radius = at_home.groupBy(block, F.col("home").alias("pivot")).agg(F.max("d").alias("radius"))
    return at_home, cut(pivots.join(radius, [block, "pivot"]))


def similar_pairs(vectors: DataFrame, block: str, idc: str, vec: str, threshold: float, log: list | None = None) -> DataFrame:
    """(block, q_id < c_id, cos) of all pairs of a block with a cosine (9 decimals) of ``threshold`` or more, each once.

    ``log`` receives the number of pairs whose product is formed.
    """
    at_home, pivots = prepared(vectors, block, idc, vec)
    reach = at_home.withColumn("r", F.lit(math.sqrt(max(2 - 2 * threshold, 0)) + SLACK))
    away = cut(visits(reach, pivots, block, True))
    own = listed(at_home, block, "home").select("_l", block, "id", "vec")
    guests = listed(away.join(at_home.select(block, "id", "vec"), [block, "id"]), block, "list").select("_l", "id", "vec")
    if log is not None:
        h = own.groupBy("_l").agg(F.count(F.lit(1)).alias("h"))
        g = guests.groupBy("_l").agg(F.count(F.lit(1)).alias("g"))
        log.append(h.join(g, "_l", "left").agg(F.sum(F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.coalesce("g", F.lit(0)))).first()[0])

    def inside(cos, q_ids, c_ids, same_chunk):
        near = cos >= threshold
        return np.nonzero(near & (q_ids[:, None] < c_ids[None, :]) if same_chunk else near)

    def across(cos, q_ids, c_ids, _):
        return np.nonzero(cos >= threshold)

    met = _meet(own, own, "_l", "id", "id", "vec", _kernel("_l", inside), half=True) \
        .unionByName(_meet(guests, own, "_l", "id", "id", "vec", _kernel("_l", across)))
    pairs = met.select(F.least("q_id", "c_id").alias("q_id"), F.greatest("q_id", "c_id").alias("c_id"), "cos")
    return pairs.join(at_home.select(block, F.col("id").alias("q_id")), "q_id").select(block, "q_id", "c_id", "cos")


def top_k_cosine(queries: DataFrame, candidates: DataFrame, block: str, qid: str, cid: str, vec: str, k: int) -> DataFrame:
    """The k nearest candidates of each query in its block: (block, q_id, c_id, cos, rank); ids are unique.

    The list of the nearest pivot is searched first; the k-th distance found
    there is the reach within which other lists are visited (all, where the
    list holds fewer than k).
    """
    at_home, pivots = prepared(candidates, block, cid, vec)
    asked = queries.select(block, F.col(qid).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    asked = cut(asked.join(homes(asked, pivots, block), [block, "id"]))
    own = listed(at_home, block, "home").select("_l", "id", "vec")

    def best(cos, q_ids, c_ids, _):
        order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        return np.repeat(np.arange(len(q_ids)), order.shape[1]), order.ravel()

    def search(who):
        return _meet(who, own, "_l", "id", "id", "vec", _kernel("_l", best)).select("q_id", "c_id", "cos")

    ranked = Window.partitionBy("q_id").orderBy(F.desc("cos"), "c_id")
    first = cut(search(listed(asked, block, "home").select("_l", "id", "vec")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k))
    kth = first.filter(F.col("rank") == k).select(F.col("q_id").alias("id"), F.sqrt(F.greatest(2 - 2 * F.col("cos"), F.lit(0.0))).alias("r"))
    reach = asked.join(kth, "id", "left").withColumn("r", F.coalesce("r", F.lit(4.0)))
    guests = listed(visits(reach, pivots, block, False).join(asked.select(block, "id", "vec"), [block, "id"]), block, "list").select("_l", "id", "vec")
    both = first.drop("rank").unionByName(search(guests))
    return both.withColumn("rank", F.row_number().over(ranked).cast("bigint")).filter(F.col("rank") <= k) \
        .join(asked.select(block, F.col("id").alias("q_id")), "q_id").select(block, "q_id", "c_id", "cos", "rank")
