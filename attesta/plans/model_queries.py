"""Sampling (X), models (F) and streams (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import models as L
from ..operators import sample as X
from ..sources.tables import table
from ..streaming import live as S
from .metric_queries import LAB, _auroc_sql, labelled, long_vectors
from .registry import query
from .report_queries import calls, prices
from .score_queries import r6

C = F.col


def _flagged(spark, root):
    return table(spark, root, "events").filter(C("event_type").isin("error", "view")).select(
        "event_id", "user_id", (C("event_type") == "error").cast("int").alias("label"))


@query("sample_balanced_x1", """WITH e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('5:' || event_id), event_id) AS r FROM events WHERE event_type IN ('error', 'view')),
q AS (SELECT user_id, least(12, count(*) FILTER (event_type = 'error'), count(*) FILTER (event_type = 'view')) AS n FROM events GROUP BY 1)
SELECT event_id, e.user_id, (event_type = 'error')::INT AS label FROM e JOIN q USING (user_id) WHERE r <= n""")
def sample_balanced(spark, root):
    return X.sample_balanced(_flagged(spark, root), "user_id", "label", "event_id", 12, "5").select("event_id", "user_id", "label")


@query("sample_per_category_x2", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('5:' || event_id), event_id) <= 4")
def sample_per_category(spark, root):
    ev = table(spark, root, "events").select("event_id", "user_id", "event_type")
    return X.sample_per_category(ev, ["user_id", "event_type"], "event_id", 4, "5")


_SEL = "sel AS (SELECT p_partkey, p_brand FROM part WHERE p_size > 40)"


@query("placebo_x3", f"""WITH {_SEL}, q AS (SELECT p_brand, count(*) AS n FROM sel GROUP BY 1), r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('9:' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS have
 FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM sel)) SELECT p_partkey, p_brand FROM r JOIN q USING (p_brand) WHERE have >= n AND r <= n""")
def placebo(spark, root):
    part = table(spark, root, "part").select("p_partkey", "p_brand")
    chosen = table(spark, root, "part").filter("p_size > 40").select("p_partkey", "p_brand")
    return X.placebo(chosen, part, "p_brand", "p_partkey", "9")


@query("placebo_layers_x3", """WITH f AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 49), o AS (SELECT p_brand, row_number() OVER (ORDER BY md5('9:' || p_brand), p_brand) AS r FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT IN (SELECT p_brand FROM f))
SELECT p_brand FROM o WHERE r <= (SELECT count(*) FROM f)""")
def placebo_layers(spark, root):
    part = table(spark, root, "part")
    return X.placebo_layers(part.filter("p_size > 49").select("p_brand").distinct(), part.select("p_brand").distinct(), "p_brand", "9")


@query("sample_n_x4", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= 50")
def sample_n(spark, root):
    return X.sample_n(table(spark, root, "documents").select("doc_id", "lang"), "doc_id", 50, "42")


@query("group_folds_x5", f"""WITH {LAB}, g AS (SELECT source, max((y = 1)::INT) AS p, max((y = 0)::INT) AS n FROM lab GROUP BY 1), k AS (SELECT least(5, sum(p), sum(n)) AS k FROM g)
SELECT source, ((row_number() OVER (PARTITION BY p ORDER BY md5('3:' || source), source) - 1) % k)::BIGINT AS fold FROM g, k WHERE k >= 2""")
def group_folds(spark, root):
    return X.group_folds(labelled(spark, root), "source", "y", 5, "3")


@query("leave_n_out_x5", "SELECT source, ((row_number() OVER (ORDER BY md5('3:' || source), source) - 1) // 4)::BIGINT AS fold FROM (SELECT DISTINCT source FROM documents)")
def leave_n_out(spark, root):
    return X.leave_n_out(table(spark, root, "documents"), "source", 4, "3")


@query("holdout_last_x6", """WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, turn, r <= greatest(1, ceil(n * 0.15)) AS is_test FROM conversations JOIN r USING (conv_id)""")
def holdout_last(spark, root):
    return X.holdout_last(table(spark, root, "conversations").select("conv_id", "turn"), "conv_id", 0.15)


KINDS = {"low": list(range(21)), "mid": list(range(21, 42)), "high": list(range(42, 64))}


def _vectors(spark, root):
    """Vectors as rows of 64 values, every twentieth id from one sample; y marks four of the ten labels."""
    return table(spark, root, "embeddings").select(C("vec_id").alias("id"), (C("vec_id") % 20).alias("sample"), (C("label") < 4).cast("double").alias("y"),
                                                   C("embedding").cast("array<double>").alias("x"))


def _folded(spark, root, folds):
    rows = _vectors(spark, root)
    return rows.join(folds(rows).withColumn("fold", C("fold").cast("int")), "sample")


def _grouped(spark, root):
    return _folded(spark, root, lambda rows: X.group_folds(rows, "sample", "y", 3, "5"))


def _incomplete(spark, root):
    """Leave-five-samples-out folds; every eleventh value is missing."""
    rows = _folded(spark, root, lambda r: X.leave_n_out(r, "sample", 5, "5"))
    return rows.withColumn("x", F.transform("x", lambda v, i: F.when((C("id") + i) % 11 != 0, v)))


@query("probe_oof_f1")
def probe_oof(spark, root):
    """Test and train AUROC per grouped fold, and the test AUROC of a probe on one feature, the mean of all."""
    return L.probe_oof(_grouped(spark, root), 3)[1]


@query("probe_probabilities_f1")
def probe_probabilities(spark, root):
    return L.probe_oof(_grouped(spark, root), 3)[0]


@query("word_classifier_f2")
def word_classifier(spark, root):
    """Fold table of five models over all 64 dimensions; 5 boosted trees of depth 6 in place of 300, see the README."""
    return L.fold_table(L.word_classifier(_incomplete(spark, root), 4, KINDS, trees=5)[0])


@query("classifier_summary_f2")
def classifier_summary(spark, root):
    """Means, deviations and pooled measures of the logistic model and its three baselines."""
    return L.classifier_summary(L.word_classifier(_incomplete(spark, root), 4, KINDS, trees=0)[0])


@query("feature_importance_f2")
def feature_importance(spark, root):
    return L.word_classifier(_incomplete(spark, root), 4, KINDS, trees=0)[1]


@query("rank_coefficients_f3")
def rank_coefficients(spark, root):
    return L.rank_coefficients(L.probe_oof(_grouped(spark, root), 3)[2])


@query("fit_two_set_f4")
def fit_two_set(spark, root):
    """Layers with the strongest effects of either sign."""
    rows = long_vectors(spark, root).withColumn("y", (C("label") < 4).cast("int"))
    top = M.top_layers(M.cohens_d(rows, ["layer"], "y", "s"), "layer", "d", 3).collect()  # six rows
    first = [int(r["layer"]) for r in top if r["side"] == "positive"]
    second = [int(r["layer"]) for r in top if r["side"] == "negative"]
    return L.fit_two_set(_vectors(spark, root), first, second)


def _layers(spark, root):
    """Eight layers of eight dimensions; the last 15 % of the samples are held out."""
    rows = _folded(spark, root, lambda r: X.leave_n_out(r, "sample", 7, "5"))
    held = X.holdout_last(rows.select("sample").distinct(), "sample", 0.15)
    return L.layer_probes(rows.join(held, "sample"), {i: list(range(8 * i, 8 * i + 8)) for i in range(8)}, 3, [0.01, 0.1, 1.0, 10.0])


@query("layer_probes_f5")
def layer_probes(spark, root):
    return _layers(spark, root)[0]


@query("apply_probes_f5")
def apply_probes(spark, root):
    """Probability of every vector under the best layer's probe."""
    layers, models = _layers(spark, root)
    best = layers.filter("is_best").first()["layer"]
    return L.apply_probes(_vectors(spark, root), models, best)


def _event_stream(spark, root):
    return S.file_stream(spark, root, "events.parquet", S.EVENT_SCHEMA)


@query("stream_moments_q1", """WITH c AS (SELECT event_type AS layer, user_id % 2 AS y, value / 100 AS x FROM events)
SELECT layer, count(*) FILTER (y = 1)::BIGINT AS n1, count(*) FILTER (y = 0)::BIGINT AS n0, round((avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) / sqrt(((count(*) FILTER (y = 1) - 1) * var_samp(x) FILTER (y = 1)
 + (count(*) FILTER (y = 0) - 1) * var_samp(x) FILTER (y = 0)) / (count(*) - 2)), 6) AS d FROM c GROUP BY 1""")
def stream_moments(spark, root):
    ev = _event_stream(spark, root).select(C("event_type").alias("layer"), (C("user_id") % 2).alias("y"), (C("value") / 100).alias("x"))
    state = S.run_available(ev, S.moments_of(["layer"], "y", C("x")), ["layer"], S.new_folder(spark, "moments"))
    return M.d_from_moments(state, ["layer"]).withColumn("d", F.round("d", 6))


@query("stream_auroc_q1", f"WITH e AS (SELECT event_type AS layer, user_id % 2 AS y, value AS s FROM events), {_auroc_sql('e', 'layer')} SELECT layer, n, n_pos, round(auroc, 6) AS auroc FROM a")
def stream_auroc(spark, root):
    ev = _event_stream(spark, root).select(C("event_type").alias("layer"), (C("user_id") % 2).alias("y"), "value")
    state = S.run_available(ev, S.histogram_of(["layer"], "y", C("value")), ["layer", "score"], S.new_folder(spark, "histogram"))
    return M.auroc(state, ["layer"]).withColumn("auroc", F.round("auroc", 6))


@query("stream_cost_q2", """WITH p(model, pin, pout) AS (VALUES ('large', 0.72::DOUBLE, 0.72::DOUBLE), ('small', 0.22, 0.22), ('open', 0.07, 0.30)),
c AS (SELECT event_type AS stage, (['large', 'small', 'open', 'other'])[1 + event_id % 4] AS model, floor(value * 100)::BIGINT AS ti, floor(value * 10)::BIGINT AS tk FROM events)
SELECT stage, c.model, count(*)::BIGINT AS n_calls, sum(ti)::BIGINT AS tokens_in, sum(tk)::BIGINT AS tokens_out, round(sum(coalesce((ti * pin + tk * pout) / 1e6, 0)), 6) AS cost FROM c LEFT JOIN p ON p.model = c.model GROUP BY 1, 2""")
def stream_cost(spark, root):
    state = S.run_available(calls(_event_stream(spark, root)), S.cost_of(prices(spark)), ["stage", "model"], S.new_folder(spark, "cost"))
    return state.withColumn("cost", F.round("cost", 6))
