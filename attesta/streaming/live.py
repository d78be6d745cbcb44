"""Running metrics over file streams.

A state is a mergeable table: one row per key whose other columns are summed.
Every micro-batch is aggregated on its own and written as a delta under its
batch number, followed by a row in the ``done`` table; a repeated batch
overwrites itself, and a delta without its ``done`` row (a torn batch) is not
read.  The state is the sum of the done deltas.  ``compact`` folds them into one
base, so that neither the files nor the work of a reader grow with the number of
batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import moments
from ..sources.durable import shared_folder

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
FOLD_AFTER = 32
Summary = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern) \
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def mark(spark: SparkSession, folder: str, kind: str, number: int) -> None:
    """The last step of a write: the row that makes it count."""
    spark.range(1).select(F.lit(number).cast("long").alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")


def numbers(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(batch) of the finished writes of a kind; none before the first."""
    try:
        return spark.read.parquet(f"{folder}/{kind}").select(F.col("batch").cast("long").alias("batch"))
    except AnalysisException:
        return spark.createDataFrame([], "batch long")


def run_available(stream: DataFrame, summary: Summary, keys: list[str], folder: str) -> DataFrame:
    """Process what is there and return the state."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        summary(batch).write.mode("overwrite").parquet(f"{folder}/delta/batch={number}")
        mark(spark, folder, "done", number)

    q = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    base, last = newest_base(spark, folder)
    if numbers(spark, folder, "done").filter(F.col("batch") > last).count() > FOLD_AFTER:
        compact(spark, keys, folder)
    return state(spark, keys, folder)


def newest_base(spark: SparkSession, folder: str) -> tuple[str | None, int]:
    """Path of the newest finished base and the last batch that it holds; -1 without one."""
    last = numbers(spark, folder, "folded").agg(F.max("batch").alias("b")).collect()[0]["b"]
    return (None, -1) if last is None else (f"{folder}/base/upto={last}", last)


def state(spark: SparkSession, keys: list[str], folder: str) -> DataFrame:
    """The newest base and the finished deltas after it, summed by key."""
    base, last = newest_base(spark, folder)
    done = numbers(spark, folder, "done").filter(F.col("batch") > last)
    parts = [spark.read.parquet(base)] if base else []
    if base is None or not done.isEmpty():
        parts.append(spark.read.parquet(f"{folder}/delta").join(done, "batch", "left_semi").drop("batch"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def compact(spark: SparkSession, keys: list[str], folder: str) -> None:
    """Fold all finished deltas into a new base; readers switch to it when its mark is there."""
    last = numbers(spark, folder, "done").agg(F.max("batch").alias("b")).collect()[0]["b"]
    if last is not None:
        state(spark, keys, folder).write.mode("overwrite").parquet(f"{folder}/base/upto={last}")
        mark(spark, folder, "folded", last)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def moments_of(by: list[str], y: str, x) -> Summary:
    """n, sum and sum of squares per class: the state behind Cohen's d."""
    return lambda rows: moments(rows, by, y, x)


def histogram_of(by: list[str], y: str, score, digits: int | None = None) -> Summary:
    """Score histogram: the state behind AUROC and average precision.

    Exact by default: a row per distinct score, which Spark sums and ranks over
    as many tasks as it takes.  Rounding to ``digits`` decimals bounds the state
    by the range of the scores instead; scores closer than that count as equal.
    Rows without a score take no part.
    """
    value = score.cast("double") if digits is None else F.round(score, digits)
    return lambda rows: rows.filter(score.isNotNull()).groupBy(*by, value.alias("score")).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.sum((F.col(y) == 0).cast("bigint")).alias("neg"))


def cost_of(prices: DataFrame) -> Summary:
    """Tokens and cost per stage and model; prices are a static table."""
    def summary(calls: DataFrame) -> DataFrame:
        priced = calls.join(prices, "model", "left")
        cost = F.coalesce((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6, F.lit(0.0))
        return priced.groupBy("stage", "model").agg(
            F.count(F.lit(1)).alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(cost).alias("cost"))

    return summary
