"""De-duplication, greedy selection and components."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut


def dedupe_first(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """First row of every key, by an aggregate that combines before the shuffle.

    A text copied into a third of all rows reaches the reducers as one partial
    row per task.
    """
    named = [F.expr(k) if isinstance(k, str) else k for k in keys]
    rest = F.struct(*[F.col(o) for o in order], *[F.col(c) for c in df.columns if c not in order])
    first = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(F.min_by(rest, F.struct(*order)).alias("_row"))
    return first.select("_row.*").select(*df.columns)


def greedy_keep(nodes: DataFrame, edges: DataFrame, idc: str, most: int = 1 << 20, log: list | None = None) -> DataFrame:
    """Ids kept by a first-come pass in the order of the ids: a kept id drops its later neighbours.

    ``edges`` has ``before`` < ``after``.  Components do not touch each other, so
    each is settled by one pass over its edges, sorted, in a task that runs
    through many components and remembers the dropped ids of the one at hand.
    Only components above ``most`` edges are settled in rounds across tasks.
    Ids without an edge are kept; ``log`` receives one entry per round.
    """
    edges = cut(edges.select("before", "after").distinct())
    placed = edges.join(components(edges, "before", "after"), F.col("before") == F.col("id")).drop("id")
    counts = placed.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    sized = cut(placed.join(counts, "component"))
    dropped = greedy_pass(sized.filter(F.col("_n") <= most))
    large = sized.filter(F.col("_n") > most).select("before", "after")
    if not large.isEmpty():
        dropped = dropped.unionByName(greedy_rounds(large, log))
    return nodes.join(dropped.select(F.col("id").alias(idc)), idc, "left_anti")


def greedy_pass(edges: DataFrame) -> DataFrame:
    """Dropped ids of whole components (component, before, after), read once in order.

    All that comes before an id is decided when its edges are read.
    """
    kind = edges.schema["after"].dataType.simpleString()

    def run(batches):
        here, dropped, last, goes = None, set(), None, False
        for batch in batches:
            out = []
            for component, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                if component != here or after != last:
                    if goes:
                        out.append(last)
                        dropped.add(last)
                    if component != here:
                        here, dropped = component, set()
                    last, goes = after, False
                goes = goes or before not in dropped
            yield pa.RecordBatch.from_pydict({"id": pa.array(out, batch.schema.field("after").type)})
        if goes:
            yield pa.RecordBatch.from_pydict({"id": pa.array([last], batch.schema.field("after").type)})

    return edges.select("component", "before", "after").repartition("component").sortWithinPartitions("component", "after", "before").mapInArrow(run, f"id {kind}")


def greedy_rounds(edges: DataFrame, log: list | None = None) -> DataFrame:
    """Dropped ids, settled a front at a time.

    Each round keeps the undecided ids without an undecided predecessor and
    drops their successors, which gives the result of the sequential pass.
    """
    undecided = cut(edges.select(F.explode(F.array("before", "after")).alias("id")).distinct())
    dropped = None
    while True:
        live = edges.join(undecided.withColumnRenamed("id", "before"), "before", "left_semi") \
            .join(undecided.withColumnRenamed("id", "after"), "after", "left_semi")
        blocked = live.select(F.col("after").alias("id")).distinct()
        kept = undecided.join(blocked, "id", "left_anti")
        out = cut(live.join(kept.withColumnRenamed("id", "before"), "before", "left_semi").select(F.col("after").alias("id")).distinct())
        undecided = cut(undecided.join(kept, "id", "left_anti").join(out, "id", "left_anti"))
        dropped = out if dropped is None else dropped.unionByName(out)
        if log is not None:
            log.append(1)
        if undecided.isEmpty():
            return dropped


def star_round(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """One large-star and one small-star step over distinct (hi, lo) edges, hi > lo.

    Large star: every neighbour above a node is linked to the smallest id near
    that node.  Small star: a node and its smaller neighbours are linked to the
    smallest of them.  Neither step joins or separates components.
    """
    ends = F.explode(F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v"))))
    both = edges.select(ends.alias("x")).select("x.u", "x.v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = few(both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo"), tasks).distinct()
    large = few(large, tasks)
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(least, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
    return few(few(small.filter("hi > lo"), tasks).distinct(), tasks)


def few(df: DataFrame, tasks: int | None) -> DataFrame:
    """``df`` in at most ``tasks`` partitions, where a number is given."""
    return df.coalesce(tasks) if tasks else df


def components(edges: DataFrame, a: str, b: str, log: list | None = None, tasks: int | None = None) -> DataFrame:
    """(id, component): the smallest id of each connected component.

    Alternating stars until every edge points at its component's smallest id,
    about log2 of the longest path in rounds; there is no cap.  A round is done
    when no id is both the upper end of an edge and the lower end of another
    and no id has two lower ends.  Lineage is cut every round.  Nodes that only
    have an edge to themselves are their own component; edges with a NULL end
    are no edges.  ``log`` receives one entry per round.  ``tasks`` bounds the
    partitions of every step, for edges known to be few: a step of many
    partitions leaves a file on disk for each, however small.
    """
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    own = given.filter("a = b").select(F.col("a").alias("id")).distinct()
    now = cut(few(few(given.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), tasks).distinct(), tasks))
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                            F.struct(F.col("lo").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        open_ends = few(ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)"), tasks)
        if open_ends.isEmpty():
            break
        now = cut(star_round(now, tasks))
        if log is not None:
            log.append(1)
    roots = now.select(F.col("lo").alias("id")).unionByName(own).distinct()
    lows = roots.join(now.select(F.col("hi").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(lows)


def all_components(nodes: DataFrame, edges: DataFrame, idc: str, a: str, b: str) -> DataFrame:
    """Components of all nodes; a node without an edge is its own component."""
    found = components(edges, a, b)
    return nodes.select(idc).join(found.withColumnRenamed("id", idc), idc, "left") \
        .withColumn("component", F.coalesce("component", F.col(idc)))


SPAN = "struct<start:int,end:int,id:int,score:double>"


def longest_first(spans: Column) -> Column:
    """Placed spans of one text: the longest first, then the first seen; what overlaps a kept span goes.

    ``spans`` is array<struct<start,end,id,score>> of one text.  Kept spans do not
    overlap, so their starts and ends stay sorted together and one binary search
    finds the two that a new span could touch.  An empty span touches what it
    lies inside of.
    """
    @F.arrow_udf(f"array<{SPAN}>")
    def choose(column: pa.Array) -> pa.Array:
        flat = column.flatten() if not column.null_count else column.drop_null().flatten()
        start, end, number = (flat.field(n).to_numpy() for n in ("start", "end", "id"))
        lengths = column.value_lengths().fill_null(0).to_numpy()
        row = np.repeat(np.arange(len(column)), lengths)
        taken, ends = [], np.zeros(len(column) + 1, np.int32)
        firsts, lasts, now = [], [], -1
        for at in np.lexsort((number, start - end, row)).tolist():
            if row[at] != now:
                firsts, lasts, now = [], [], row[at]
            a, z = int(start[at]), int(end[at])
            i = bisect_right(lasts, a)  # the first kept span that ends behind the start
            if i < len(firsts) and firsts[i] < z:
                continue
            i = bisect_left(firsts, a)
            firsts.insert(i, a)
            lasts.insert(i, z)
            taken.append(at)
            ends[now + 1] += 1
        kept = pa.StructArray.from_arrays([flat.field(n).take(pa.array(taken, pa.int64())).cast(t) for n, t in (
            ("start", pa.int32()), ("end", pa.int32()), ("id", pa.int32()), ("score", pa.float64()))], names=["start", "end", "id", "score"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), kept)

    return choose(spans)


def higher_score(spans: Column) -> Column:
    """Left to right; an overlapping span replaces the last one if it scores higher."""
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), (-x["score"]).alias("neg"), x["id"].alias("id"), x["end"].alias("end"))))

    def step(acc, x):
        new = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["id"].alias("id"), (-x["neg"]).alias("score"))
        last = F.try_element_at(acc, F.lit(-1))
        return (F.when((F.size(acc) == 0) | (x["start"] >= last["end"]), F.array_append(acc, new))
                .when(-x["neg"] > last["score"], F.array_append(F.slice(acc, 1, F.size(acc) - 1), new)).otherwise(acc))

    return F.aggregate(ranked, F.array().cast(f"array<{SPAN}>"), step)

