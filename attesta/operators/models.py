"""Probes and classifiers, evaluated by whole groups.

Logistic models are fitted for all folds at once (``logistic.py``), kept as a
table and applied by a join; boosted trees are Spark ML's.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.durable import cut
from .logistic import apply_models, as_table, fit_all, other_folds
from .metrics import auroc, average_precision, histogram, threshold_metrics, with_scalar


def quality(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_pos, auroc, auprc and the threshold metrics) of rows with y and p; one class only gives NULL for the first two."""
    hist = histogram(scored, by, "y", "p")
    at_half = threshold_metrics(scored, by, "y", "p")
    return auroc(hist, by).join(average_precision(hist, by), by).join(at_half.drop("n"), by)


def out_of_fold(df: DataFrame, models: DataFrame) -> DataFrame:
    """Every row scored by the models that were fitted without its fold."""
    return apply_models(df, models, ["fold"])


def probe_oof(df: DataFrame, k: int, standardise: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Out-of-fold probabilities, train and test AUROC per fold, the models.

    ``df`` has id, y, fold and an array column x; the folds come from
    ``sample.group_folds``, so that no group is on both sides.  The table also
    has the test AUROC of a probe on one feature, the mean of all.
    """
    spark = df.sparkSession
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size("x")
    both = cut(df.withColumn("x", F.array_append(F.col("x").cast("array<double>"), mean)))
    width = both.select(F.max(F.size("x"))).first()[0] or 1
    fits = fit_all(both, k, {"probe": (list(range(width - 1)), 1.0), "mean": ([width - 1], 1.0)}, standardise=standardise)
    models = as_table(spark, fits, width)
    oof = out_of_fold(both, models)
    test = auroc(histogram(oof, ["model", "fold"], "y", "p"), ["model", "fold"])
    train = apply_models(other_folds(both, k), models.filter("model = 'probe'"), ["fold"])
    table = auroc(histogram(train, ["fold"], "y", "p"), ["fold"]).select("fold", F.col("auroc").alias("train_auroc")) \
        .join(test.filter("model = 'probe'").select("fold", F.col("auroc").alias("test_auroc")), "fold") \
        .join(test.filter("model = 'mean'").select("fold", F.col("auroc").alias("single_feature")), "fold")
    return oof.filter("model = 'probe'").select("id", "fold", "y", "p"), table, models.filter("model = 'probe'")


def rank_coefficients(models: DataFrame) -> DataFrame:
    """Mean and mean |coefficient| of every feature across the folds."""
    coef = models.select(F.inline("weights")).filter("coef is not null")
    return coef.groupBy("feature").agg(F.avg("coef").alias("mean_coef"), F.avg(F.abs("coef")).alias("mean_abs"))


def best_dimensions(df: DataFrame, groups: dict[str, list[int]]) -> dict[str, int]:
    """The dimension of each group with the largest AUROC over all rows, the smallest on ties: one pass, a row per dimension comes back."""
    long = df.select("y", F.posexplode("x").alias("dim", "v")).filter(F.col("v").isNotNull())
    found = {r["dim"]: r["auroc"] for r in auroc(histogram(long, ["dim"], "y", "v"), ["dim"]).collect() if r["auroc"] is not None}
    return {name: max(sorted(dims), key=lambda d: found.get(d, -1.0)) for name, dims in groups.items()}


def boosted_oof(df: DataFrame, k: int, trees: int = 300, depth: int = 6) -> DataFrame:
    """Rows with the out-of-fold probability of boosted trees (learning rate 0.05, balanced classes), fold by fold.

    Missing values take the mean of the training rows.  Spark grows one tree
    level per job: ``trees`` x (``depth`` + 1) jobs and more for every fold.
    """
    width = df.select(F.max(F.size("x"))).first()[0] or 1
    names = [f"x{i}" for i in range(width)]
    flat = cut(df.select("id", "y", "fold", *[F.get(F.col("x"), F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]))
    out = None
    for fold in range(k):
        train = flat.filter(F.col("fold") != fold)
        n, pos = train.agg(F.count("y"), F.sum("y")).first()
        if not pos or pos == n:
            continue
        weighted = train.withColumn("weight", F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
        prepare = [Imputer(strategy="mean", inputCols=names, outputCols=[f"{c}_i" for c in names]),
                   VectorAssembler(inputCols=[f"{c}_i" for c in names], outputCol="features")]
        model = Pipeline(stages=[*prepare, GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth,
                                                         stepSize=0.05, seed=0)]).fit(weighted)
        done = model.transform(flat.filter(F.col("fold") == fold)).select("id", "fold", "y", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        out = done if out is None else out.unionByName(done)
    return out


def word_classifier(df: DataFrame, k: int, kinds: dict[str, list[int]], trees: int = 300, depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """(id, y, fold, model, p) out of fold for five models, and the importance of the full logistic one.

    ``full_logistic`` and ``full_boosted`` use all dimensions, a baseline per kind
    the single one with the best AUROC over all rows.  ``df`` has id, y, fold and
    x; leave-n-out folds come from ``sample.leave_n_out``.
    """
    rows = cut(df.select("id", "y", "fold", F.col("x").cast("array<double>").alias("x")))
    width = rows.select(F.max(F.size("x"))).first()[0] or 1
    specs = {"full_logistic": (list(range(width)), 1.0)} | {f"baseline_{n}": ([d], 1.0) for n, d in best_dimensions(rows, kinds).items()}
    models = as_table(df.sparkSession, fit_all(rows, k, specs), width)
    scored = out_of_fold(rows, models).select("id", "y", "fold", "model", "p")
    if trees:
        scored = scored.unionByName(boosted_oof(rows, k, trees, depth).withColumn("model", F.lit("full_boosted")).select("id", "y", "fold", "model", "p"))
    whole = fit_all(rows, k, {"full_logistic": specs["full_logistic"]}, folds=[-1])
    importance = as_table(df.sparkSession, whole, width).select(F.inline("weights")).filter("coef is not null").select("feature", "coef")
    return scored, importance


MEASURES = ["auroc", "auprc", "brier", "accuracy", "balanced", "baseline", "precision", "recall", "f1"]


def fold_table(scored: DataFrame) -> DataFrame:
    """The measures of every model and fold that holds both classes."""
    return quality(scored, ["model", "fold"]).filter("auroc is not null").select("model", "fold", "n", "n_pos", *MEASURES)


def classifier_summary(scored: DataFrame) -> DataFrame:
    """Mean and sample sd of every measure over the folds, and the measures of all out-of-fold rows together."""
    folds = fold_table(scored).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_folds"), *[f(m).alias(f"{m}_{n}") for m in MEASURES for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))])
    pooled = quality(scored, ["model"]).select("model", *[F.col(m).alias(f"pooled_{m}") for m in MEASURES if m != "baseline"])
    return folds.join(pooled, "model")


def fit_two_set(df: DataFrame, first: list[int], second: list[int]) -> DataFrame:
    """Balanced logistic on two chosen sets of layers; alpha and beta are the
    means of the positive and of the negated negative coefficients."""
    rows = df.withColumn("fold", F.lit(0))
    coefs = [float(c) for m in fit_all(rows, 1, {"two": ([*first, *second], 1.0)}, folds=[-1]) for c in m.beta[:-1]]
    alpha = sum(max(c, 0.0) for c in coefs[:len(first)]) / max(len(first), 1)
    beta = sum(max(-c, 0.0) for c in coefs[len(first):]) / max(len(second), 1)
    return df.sparkSession.createDataFrame([(alpha, beta, len(first), len(second))], "alpha double, beta double, n_first int, n_second int")


def layer_probes(df: DataFrame, layers: dict[int, list[int]], k: int, grid: list[float]) -> tuple[DataFrame, DataFrame]:
    """Cross-validated probe per layer over a grid of C: the table of layers, and the model table.

    ``df`` has id, y, fold, is_test and an array column x; a layer is a list of
    its dimensions.  (layer, best_c, cv_auroc, test_auroc, is_best): the C with
    the largest mean AUROC over the folds (the smallest on ties), the AUROC of
    the held-out rows under a refit on all others, and the layer with the
    largest cross-validated one.  The models are those refits.
    """
    spark = df.sparkSession
    rows = cut(df.select("id", "y", "fold", "is_test", F.col("x").cast("array<double>").alias("x")))
    train = rows.filter(~F.col("is_test"))
    width = rows.select(F.max(F.size("x"))).first()[0] or 1
    specs = {f"{layer}:{c}": (dims, c) for layer, dims in layers.items() for c in grid}
    oof = out_of_fold(train, as_table(spark, fit_all(train, k, specs), width))
    named = F.split("model", ":")
    cv = auroc(histogram(oof, ["model", "fold"], "y", "p"), ["model", "fold"]).groupBy("model").agg(F.avg("auroc").alias("cv_auroc")) \
        .select(named[0].cast("int").alias("layer"), named[1].cast("double").alias("c"), "cv_auroc")
    chosen = cv.groupBy("layer").agg(F.max(F.struct("cv_auroc", -F.col("c"))).alias("b")).select(
        "layer", (-F.col("b")["col2"]).alias("best_c"), F.col("b.cv_auroc").alias("cv_auroc"))
    best = {r["layer"]: r["best_c"] for r in chosen.collect()}  # a row per layer
    refits = fit_all(train, k, {str(layer): (layers[layer], c) for layer, c in best.items()}, folds=[-1])
    models = as_table(spark, refits, width)
    held = apply_models(rows.filter("is_test").withColumn("fold", F.lit(-1)), models, ["fold"])
    test = auroc(histogram(held, ["model"], "y", "p"), ["model"]).select(F.col("model").cast("int").alias("layer"), F.col("auroc").alias("test_auroc"))
    top = chosen.agg(F.max(F.struct("cv_auroc", -F.col("layer"))).alias("_t"))
    table = with_scalar(chosen.join(test, "layer", "left"), top) \
        .withColumn("is_best", F.col("layer") == -F.col("_t")["col2"]).drop("_t")
    return table, models


def apply_probes(df: DataFrame, models: DataFrame, best: int) -> DataFrame:
    """(id, p, mean_p): the best layer's probability of every row, and the mean of all layers'."""
    done = apply_models(df.withColumn("fold", F.lit(-1)), models, ["fold"])
    return done.groupBy("id").agg(F.max(F.when(F.col("model") == str(best), F.col("p"))).alias("p"), F.avg("p").alias("mean_p"))
