"""Running values along an order, without one task per group.

A plain window puts a whole group into one task.  ``scan`` deals the rows out by
group and order instead, cut where the data say: one range shuffle, after which
every task runs through its sorted rows.  What a group has gathered in earlier
tasks comes from the last row of each, one small row per task.  A group holding
a third of all rows, a hot day or sparse ids are thus spread over many tasks.

Callers that know an order-preserving bucket of a row (histograms of scores) may
give one: a window runs per bucket and the totals of the earlier buckets are
added from a much smaller window over the buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, FractionalType, IntegerType, StructField, StructType

from ..sources.durable import cut

UP = Window.unboundedPreceding


def id_bucket(c: Column, width: int = 65536) -> Column:
    return F.floor(c / width)


def day_bucket(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("bigint")


def value_bucket(x: Column, per_octave: int = 256) -> Column:
    """Bucket of a number, mirrored below zero: equal steps of log2(|x|), and of log2(1 - |x|) between a half and one.

    Probabilities of a confident model crowd below one, where steps of log2(|x|)
    would put them into one bucket.
    """
    a = F.abs(x)
    step = F.when((a >= 0.5) & (a < 1), F.floor(-F.log2(1 - a) * per_octave) - per_octave + 400000) \
        .otherwise(F.floor(F.log2(a) * per_octave) + F.when(a >= 1, 420000).otherwise(400000))
    return F.when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0)).cast("bigint")


def differs(column: pa.Array) -> np.ndarray:
    """Whether an element differs from the one before it; NULL equals NULL, the first element never differs."""
    out = np.zeros(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        if pa.types.is_floating(column.type):
            a, b = (pc.if_else(pc.is_nan(x), pa.scalar(np.inf, x.type), x) for x in (a, b))
        same = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), True, pc.fill_null(pc.equal(a, b), False))
        out[1:] = ~same.to_numpy(zero_copy_only=False)
    return out


def forward(column: pa.Array, group: np.ndarray) -> pa.Array:
    """The latest non-NULL element up to each one inside its run of equal ``group``."""
    at = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(len(column)), -1)
    at = np.maximum.accumulate(at) if len(at) else at
    start = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0)) if len(group) else at
    return column.take(pa.array(np.where(at >= start, at, 0), pa.int64(), mask=at < start))


def scan(df: DataFrame, by: list[str], order: list, sums: dict[str, Column], last: dict[str, Column] | None = None) -> DataFrame:
    """Add inclusive running sums (NULL counts as 0) and latest non-NULL values along ``order`` within ``by``.

    Sums are whole numbers, doubles or decimals that fit 18 digits.  One range shuffle by (by, order); the result is cut, since it is read twice:
    for the edges of the tasks, two rows of each, and for the rows.  A task adds
    what its first group brings along from the tasks before.
    """
    last = last or {}
    keyed = df.select("*", *[F.coalesce(e, F.lit(0)).alias(n) for n, e in sums.items()], *[e.alias(n) for n, e in last.items()])
    kinds = {n: keyed.schema[n].dataType for n in sums}
    digits = {n: k.scale for n, k in kinds.items() if isinstance(k, DecimalType)}  # decimals are summed as whole numbers
    keyed = keyed.withColumns({n: (F.col(n) * 10 ** digits[n]).cast("bigint") if n in digits else F.col(n).cast(
        "double" if isinstance(k, FractionalType) else "bigint") for n, k in kinds.items()})
    width, n_sums, tail = len(by), len(sums), len(sums) + len(last)
    where = [keyed.columns.index(b) for b in by]

    def run(batches):
        part = TaskContext.get().partitionId()
        carry, held, at_start = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            n, cols = batch.num_rows, list(batch.columns)
            # the last row of the batch before goes ahead, so that groups and values run on
            ahead = [pa.concat_arrays([c, x]) for c, x in zip(carry[0], cols)] if carry else cols
            skip = len(ahead[0]) - n
            fresh = np.zeros(n + skip, bool)
            for i in where:
                fresh |= differs(ahead[i])
            group = np.cumsum(fresh)
            first = ((group == 0) & (carry[1] if carry else True))[skip:]
            base = len(cols) - tail
            for i in range(base, base + n_sums):
                value = ahead[i].to_numpy(zero_copy_only=False)
                run_ = np.cumsum(value)
                starts = np.flatnonzero(fresh)
                less = np.concatenate([[0], run_[starts - 1]]) if len(starts) else np.zeros(1, run_.dtype)
                ahead[i] = pa.array(run_ - less[group], cols[i].type)
            for i in range(base + n_sums, len(cols)):
                ahead[i] = forward(ahead[i], group)
            done = [a.slice(skip) for a in ahead]
            if held is not None:
                yield mark(held, part, False, at_start)
                at_start = False
            held = (done, first)
            carry = ([d.slice(n - 1) for d in done], bool(first[-1]))
        if held is not None:
            yield mark(held, part, True, at_start)

    def mark(held, part, ends, starts):
        cols, first = held
        edge = np.zeros(len(first), bool)
        edge[0], edge[-1] = edge[0] | starts, edge[-1] | ends
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(first), part, np.int32)), pa.array(first), pa.array(edge)], names=names)

    extra = [StructField("_part", IntegerType()), StructField("_first", BooleanType()), StructField("_edge", BooleanType())]
    schema = StructType([*keyed.schema.fields, *extra])
    names = schema.names
    keys = [F.col(b) for b in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    done = cut(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    added = keyed.columns[len(keyed.columns) - tail:]
    edges = done.filter("_edge").select("_part", "_first", *[F.col(b) for b in by], *added).collect()  # two rows a task
    offsets, before = [], None
    for part in sorted({r["_part"] for r in edges}):
        here = [r for r in edges if r["_part"] == part]
        key = repr(tuple(here[0])[2:2 + width])
        brought = before[1] if before and before[0] == key else None
        if brought is not None:
            offsets.append((part, *brought))
        end = here[-1]
        values = [end[n] for n in added]
        if end["_first"] and brought is not None:
            values = [v + o if i < n_sums else o if v is None else v for i, (v, o) in enumerate(zip(values, brought))]
        before = (repr(tuple(end)[2:2 + width]), values)
    back = {n: F.col(n).cast("decimal(20,0)") * F.lit(f"1e-{d}").cast(f"decimal({max(d, 1)},{d})") for n, d in digits.items() if d}
    if not offsets:
        return done.drop("_part", "_first", "_edge").withColumns(back)
    fields = StructType([StructField("_part", IntegerType()), *[StructField(f"_o_{n}", schema[n].dataType) for n in added]])
    brought = F.broadcast(df.sparkSession.createDataFrame(offsets, fields))  # a row per task at most
    out = done.join(brought, "_part", "left")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.when(F.col("_first"), F.coalesce(f"_o_{n}", F.lit(0))).otherwise(0))
    for n in last:
        out = out.withColumn(n, F.coalesce(n, F.when(F.col("_first"), F.col(f"_o_{n}"))))
    return out.select(*keyed.columns).withColumns(back)


def running_sums(df: DataFrame, by: list[str], order: list, sums: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """Add, per name, the inclusive running sum of an expression along ``order``."""
    if bucket is None:
        return scan(df, by, order, sums)
    keyed = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(UP, 0)
    local = keyed.select("*", *[F.sum(e).over(inner).alias(n) for n, e in sums.items()])
    totals = keyed.groupBy(*by, "_b").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(UP, -1)
    carried = totals.select(*by, "_b", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    out = local.join(carried, [*by, "_b"])
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
    return out.select(*df.columns, *sums)


def with_position(df: DataFrame, by: list[str], order: list, bucket: Column | None = None, name: str = "pos") -> DataFrame:
    """Add the 0-based position along ``order`` within ``by``."""
    return running_sums(df, by, order, {name: F.lit(1).cast("bigint")}, bucket) \
        .withColumn(name, F.col(name) - 1)


def carry_last(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the latest non-NULL value seen up to and including each row."""
    return scan(df, by, order, {}, {name: value})


def runs_of(df: DataFrame, by: list[str], order: list[str], flag: Column, bucket: Column | None = None) -> DataFrame:
    """Keep the flagged rows and add ``run``, equal inside each unbroken run.

    The number of unflagged rows seen so far is constant inside a run.
    """
    marked = df.withColumn("_f", flag.cast("bigint"))
    return running_sums(marked, by, order, {"run": 1 - F.col("_f")}, bucket).filter(F.col("_f") == 1).drop("_f")
