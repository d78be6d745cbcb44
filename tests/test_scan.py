"""The ordered scan against plain windows: hot groups, hot days, sparse and text ids, NULLs, and its plan."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators import ordered as O
from attesta.operators import sample as X
from attesta.operators import segments as G

C = F.col


def table(spark, n=900, parts=7):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        day = 5 if rng.random() < 0.7 else rng.randrange(400)  # one day holds most rows
        rows.append((group, rng.random() < 0.5, day, rng.choice([i, i * 10**12]), f"id{rng.random()}", rng.choice([None, rng.randrange(9)]), i / 8))
    return spark.createDataFrame(rows, "g string, h boolean, day int, id long, name string, v int, w double").repartition(parts)


@pytest.mark.parametrize("by, order", [(["g"], ["day", "id"]), ([], ["name"]), (["g", "h"], ["-id", "name"]), (["day"], ["name"])])
@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_equals_windows(spark, by, order, tasks):
    order = [F.desc(o[1:]) if o[0] == "-" else o for o in order]
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = table(spark)
        sums = {"n": F.lit(1), "s": C("v"), "t": C("w"), "d": C("w").cast("decimal(10,3)")}
        got = O.scan(df, by, order, sums, {"seen": C("v"), "text": F.when(C("v") > 6, C("name"))})
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("*", F.sum(F.lit(1)).over(w).alias("n"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.sum("w").over(w).alias("t"),
                         F.sum(C("w").cast("decimal(10,3)")).over(w).alias("d"), F.last("v", True).over(w).alias("seen"),
                         F.last(F.when(C("v") > 6, C("name")), True).over(w).alias("text"))
        assert got.columns == want.columns
        same = [c for c in want.columns if c not in ("t", "d")]
        assert sorted(map(str, got.select(*same).collect())) == sorted(map(str, want.select(*same).collect()))
        a, b = ({r["name"]: (float(r["t"]), float(r["d"])) for r in x.collect()} for x in (got, want))
        assert all(a[k] == pytest.approx(b[k]) for k in b)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_scan_and_one_shuffle(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = O.scan(df, ["g"], ["id"], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 0 and plan.count("Exchange hashpartitioning") == 0  # the one scan and shuffle are behind the cut


def test_a_hot_day_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).select(F.lit("hot").alias("g"), F.lit(5).alias("day"), "id")
        got = O.scan(rows, ["g"], ["day", "id"], {"n": F.lit(1)})
        sizes = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1000 and sum(sizes) == 4000 and got.filter("n <> id + 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty(spark):
    assert O.scan(table(spark).filter("false"), ["g"], ["id"], {"n": F.lit(1)}).collect() == []


def test_last_samples_of_text_ids(spark):
    df = spark.createDataFrame([(f"s{i:03}", t) for i in range(40) for t in range(2)], "sample string, turn int")
    test = {r["sample"] for r in X.holdout_last(df, "sample", 0.15).filter("is_test").collect()}
    assert test == {f"s{i:03}" for i in range(34, 40)}


def test_as_of_over_sparse_ids(spark):
    df = spark.createDataFrame([("a", i * 10**13, "head" if i == 2 else None) for i in range(6)], "g string, id long, h string")
    got = [r["section"] for r in G.as_of(df, ["g"], ["id"], C("h"), "section", "none").orderBy("id").collect()]
    assert got == ["none", "none", "head", "head", "head", "head"]
