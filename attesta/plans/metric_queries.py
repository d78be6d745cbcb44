"""Evaluation metrics and statistics (M), wide and long layer tables (S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import table
from .registry import query
from .score_queries import r6
from .window_queries import user_events  # noqa: F401

C = F.col

LAB = "lab AS (SELECT l.doc_id, quality AS y, n_chars AS s, lang, source FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, root):
    """Quality labels with the document length as score."""
    lab = table(spark, root, "labels").select("doc_id", C("quality").alias("y"))
    docs = table(spark, root, "documents").select("doc_id", C("n_chars").alias("s"), "lang", "source")
    return lab.join(docs, "doc_id")


def _auroc_sql(src, by, least=1, y="y", s="s", extra=""):
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""h AS (SELECT {g}{s}::DOUBLE AS s, sum(({y} = 1)::INT) AS pos, sum(({y} <> 1)::INT) AS neg FROM {src} GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER ({part}ORDER BY s) - neg / 2 AS below FROM h),
a AS (SELECT {g}sum(pos + neg)::BIGINT AS n, sum(pos)::BIGINT AS n_pos, CASE WHEN sum(pos) >= {least} AND sum(neg) >= {least} THEN sum(pos * below) / sum(pos) / sum(neg) END AS auroc FROM c {grp})"""


@query("auroc_m1", f"WITH {LAB}, {_auroc_sql('lab', 'lang')} SELECT lang, n, n_pos, round(n_pos / n, 6) AS pos_rate, round(auroc, 6) AS auroc FROM a")
def auroc(spark, root):
    out = M.auroc(M.histogram(labelled(spark, root), ["lang"], "y", "s"), ["lang"])
    return out.select("lang", "n", "n_pos", r6(C("n_pos") / C("n"), "pos_rate"), r6("auroc", "auroc"))


_AP = """d AS (SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY s DESC) AS tp, sum(pos + neg) OVER (PARTITION BY {by} ORDER BY s DESC) AS k FROM h),
p AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * tp / k) / sum(pos) END AS auprc FROM d GROUP BY 1)"""


@query("auprc_m2", f"WITH {LAB}, {_auroc_sql('lab', 'lang')}, {_AP.format(by='lang')} SELECT lang, round(auprc, 6) AS auprc FROM p")
def auprc(spark, root):
    return M.average_precision(M.histogram(labelled(spark, root), ["lang"], "y", "s"), ["lang"]).select("lang", r6("auprc", "auprc"))


@query("metrics_by_dataset_m3", f"WITH {LAB}, lb AS (SELECT lang, y, s FROM lab UNION ALL SELECT 'All', y, s FROM lab), {_auroc_sql('lb', 'lang')}, {_AP.format(by='lang')} "
       "SELECT lang, n, n_pos, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM a JOIN p USING (lang)")
def metrics_by_dataset(spark, root):
    hist = M.with_combined(M.histogram(labelled(spark, root), ["lang"], "y", "s"), "lang")
    both = M.auroc(hist, ["lang"]).join(M.average_precision(hist, ["lang"]), "lang")
    return both.select("lang", "n", "n_pos", r6("auroc", "auroc"), r6("auprc", "auprc"))


LONG = "lng AS (SELECT vec_id, (i - 1)::BIGINT AS layer, embedding[i]::DOUBLE AS s, label, (label = 0)::INT AS y FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def long_vectors(spark, root):
    """S8: one row per unit and layer."""
    return table(spark, root, "embeddings").select("vec_id", "label", (C("label") == 0).cast("int").alias("y"),
                                                   F.posexplode("embedding").alias("i", "x")) \
        .select("vec_id", "label", "y", C("i").cast("bigint").alias("layer"), C("x").cast("double").alias("s"))


@query("wide_to_long_s8", f"WITH {LONG} SELECT vec_id, layer, round(s, 6) AS value, label FROM lng")
def wide_to_long(spark, root):
    return long_vectors(spark, root).select("vec_id", "layer", r6("s", "value"), "label")


@query("long_to_wide_s8", f"WITH {LONG} SELECT vec_id, " + ", ".join(f"round(max(s) FILTER (layer = {k}), 6) AS l{k}" for k in range(64)) + " FROM lng GROUP BY 1")
def long_to_wide(spark, root):
    wide = long_vectors(spark, root).groupBy("vec_id").pivot("layer", list(range(64))).agg(F.first("s"))
    return wide.select("vec_id", *[r6(C(str(k)), f"l{k}") for k in range(64)])


@query("unpivot_s8", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, column_name AS metric, value FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount AS ecs_l0, l_tax AS pks_l0 FROM lineitem) UNPIVOT (value FOR column_name IN (ecs_l0, pks_l0))")
def unpivot(spark, root):
    li = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", C("l_discount").alias("ecs_l0"), C("l_tax").alias("pks_l0"))
    return li.unpivot(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["ecs_l0", "pks_l0"], "metric", "value")


@query("auroc_by_layer_m4", f"WITH {LONG}, {_auroc_sql('lng', 'layer', 2)} SELECT layer, round(1 - auroc, 6) AS auroc_low, round(greatest(auroc, 1 - auroc), 6) AS folded FROM a")
def auroc_by_layer(spark, root):
    """Direction -1 (low is bad) and the folded form."""
    low = M.auroc(M.histogram(long_vectors(spark, root).withColumn("s", -C("s")), ["layer"], "y", "s"), ["layer"], 2)
    return low.select("layer", r6("auroc", "auroc_low"), r6(F.greatest("auroc", 1 - C("auroc")), "folded"))


_ERR = ["click", "error", "purchase", "signup"]


@query("auroc_by_type_m5", f"""WITH t AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'any']) AS target), e AS (SELECT target, value AS s, (event_type <> 'view')::INT AS y FROM events, t
 WHERE event_type = 'view' OR target = 'any' OR event_type = target), {_auroc_sql('e', 'target', 3)} SELECT target, n, n_pos, round(auroc, 6) AS auroc FROM a""")
def auroc_by_type(spark, root):
    hist = M.typed_histogram(table(spark, root, "events"), [], "event_type", "view", "value", _ERR)
    return M.auroc(hist, ["target"], 3).withColumn("auroc", F.round("auroc", 6))


_D = """SELECT {by}, count(*) FILTER (y = 1)::BIGINT AS n1, count(*) FILTER (y = 0)::BIGINT AS n0, round((avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0))
 / (sqrt(((count(*) FILTER (y = 1) - 1) * {v}(x) FILTER (y = 1) + (count(*) FILTER (y = 0) - 1) * {v}(x) FILTER (y = 0)) / (count(*) - 2)) + {eps}), 6) AS d FROM {src} GROUP BY 1"""
_LD = "(SELECT l_linenumber::BIGINT AS layer, (l_returnflag = 'R')::INT AS y, l_discount AS x FROM lineitem)"


def _layer_rows(spark, root):
    return table(spark, root, "lineitem").select(C("l_linenumber").cast("bigint").alias("layer"), (C("l_returnflag") == "R").cast("int").alias("y"), C("l_discount").alias("x"))


@query("cohens_d_m6", _D.format(by="layer", v="var_samp", eps="1e-10", src=_LD))
def cohens_d(spark, root):
    return M.cohens_d(_layer_rows(spark, root), ["layer"], "y", "x").withColumn("d", F.round("d", 6))


@query("cohens_d_population_m6", _D.format(by="layer", v="var_pop", eps="0", src=_LD))
def cohens_d_population(spark, root):
    return M.cohens_d(_layer_rows(spark, root), ["layer"], "y", "x", ddof=0, flat_is_zero=True).withColumn("d", F.round("d", 6))


@query("cohens_d_moments_m7", """WITH c AS (SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber, (l_returnflag = 'R')::INT AS y, l_discount AS x FROM lineitem)
SELECT l_suppkey, l_linenumber, count(*) FILTER (y = 1)::BIGINT AS n1, count(*) FILTER (y = 0)::BIGINT AS n0, CASE WHEN count(*) FILTER (y = 1) >= 20 AND count(*) FILTER (y = 0) >= 20 THEN
 round((avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) / sqrt(((count(*) FILTER (y = 1) - 1) * var_samp(x) FILTER (y = 1) + (count(*) FILTER (y = 0) - 1) * var_samp(x) FILTER (y = 0)) / (count(*) - 2)), 6) END AS d FROM c GROUP BY 1, 2""")
def cohens_d_moments(spark, root):
    li = table(spark, root, "lineitem").select("l_suppkey", C("l_linenumber").cast("bigint").alias("l_linenumber"), (C("l_returnflag") == "R").cast("int").alias("y"), "l_discount")
    m = M.moments(li, ["l_suppkey", "l_linenumber"], "y", C("l_discount"))
    return M.d_from_moments(m, ["l_suppkey", "l_linenumber"]).withColumn("d", F.round("d", 6))


@query("select_top_fraction_m8", "SELECT event_id, value FROM events QUALIFY row_number() OVER (ORDER BY abs(value) DESC, event_id) <= (SELECT round(0.05 * count(*)) FROM events)")
def select_top_fraction(spark, root):
    return M.select_top_fraction(table(spark, root, "events").select("event_id", "value"), "event_id", "value", 0.05)


@query("select_top_ties_m8", "SELECT p_partkey, p_size::BIGINT AS p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= (SELECT round(0.1 * count(*)) FROM part)")
def select_top_ties(spark, root):
    part = table(spark, root, "part").select("p_partkey", C("p_size").cast("bigint").alias("p_size"))
    return M.select_top_fraction(part, "p_partkey", "p_size", 0.1, keep_ties=True)


_XS, _YS = ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"]


@query("correlations_m9", " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, count(*)::BIGINT AS n, round(coalesce(corr({x}, {y}), 0), 6) AS r, round(corr({x}, {y}) * sqrt(count(*) - 2) / sqrt(1 - corr({x}, {y}) ^ 2), 4) AS t, abs(corr({x}, {y})) > 0.3 AS strong FROM lineitem"
    for x in _XS for y in _YS))
def correlations(spark, root):
    out = M.correlations(table(spark, root, "lineitem").select(*_XS, *_YS), _XS, _YS)
    return out.select("x", "y", "n", r6("r", "r"), F.round("t", 4).alias("t"), (F.abs("r") > 0.3).alias("strong"))


@query("correlation_p_values_m9")
def correlation_p_values(spark, root):
    out = M.correlations(table(spark, root, "lineitem").select(*_XS, *_YS), _XS, _YS)
    return out.withColumn("p_value", M.t_p_value(C("t"), C("n") - 2))


_DIMS = f"{LONG}, dd AS ({_D.format(by='layer', v='var_samp', eps='1e-10', src='(SELECT layer, y, s AS x FROM lng)')})"


@query("top_layers_m10", f"""WITH {_DIMS} (SELECT layer, d, 'positive' AS side FROM dd WHERE d > 0 ORDER BY d DESC, layer LIMIT 5) UNION ALL (SELECT layer, d, 'negative' FROM dd WHERE d < 0 ORDER BY d, layer LIMIT 5)""")
def top_layers(spark, root):
    d = M.cohens_d(long_vectors(spark, root), ["layer"], "y", "s").select("layer", r6("d", "d"))
    return M.top_layers(d, "layer", "d", 5)


@query("peak_layer_m10", f"WITH {_DIMS} SELECT max_by(layer, abs(d)) AS peak_layer, max(abs(d)) AS peak FROM dd")
def peak_layer(spark, root):
    d = M.cohens_d(long_vectors(spark, root), ["layer"], "y", "s").select("layer", r6("d", "d"))
    return d.agg(F.max_by("layer", F.abs("d")).alias("peak_layer"), F.max(F.abs("d")).alias("peak"))


_YOUDEN = f"""{LONG}, {_auroc_sql('lng', 'layer')}, q AS (SELECT layer, auroc, CASE WHEN auroc >= 0.5 THEN 1 ELSE -1 END AS direction FROM a),
tn AS (SELECT h.layer, h.s * direction AS s, pos, neg, direction, auroc FROM h JOIN q USING (layer)),
cv AS (SELECT *, round(sum(pos) OVER w / sum(pos) OVER (PARTITION BY layer) - sum(neg) OVER w / sum(neg) OVER (PARTITION BY layer), 12) AS j FROM tn WINDOW w AS (PARTITION BY layer ORDER BY s DESC)),
yd AS (SELECT layer, s * direction AS threshold, direction, greatest(auroc, 1 - auroc) AS auroc, j FROM cv QUALIFY row_number() OVER (PARTITION BY layer ORDER BY j DESC, s DESC) = 1 AND j >= 0.05)"""


def _thresholds(spark, root):
    return M.youden(M.histogram(long_vectors(spark, root), ["layer"], "y", "s"), "layer")


@query("youden_m11", f"WITH {_YOUDEN} SELECT layer, round(threshold, 6) AS threshold, direction::BIGINT AS direction, round(auroc, 6) AS auroc, round(j, 6) AS j FROM yd")
def youden(spark, root):
    return _thresholds(spark, root).select("layer", r6("threshold", "threshold"), C("direction").cast("bigint").alias("direction"), r6("auroc", "auroc"), r6("j", "j"))


@query("soft_vote_m11", f"""WITH {_YOUDEN}, bs AS (SELECT *, auroc - 0.5 AS w FROM yd ORDER BY j DESC, layer LIMIT 5)
SELECT vec_id, round(greatest(0, least(1, sum(CASE WHEN (direction = -1 AND s < threshold) OR (direction = 1 AND s > threshold) THEN w ELSE 0 END) / (sum(w) + 1e-8))), 6) AS vote FROM lng JOIN bs USING (layer) GROUP BY 1""")
def soft_vote(spark, root):
    return M.soft_vote(long_vectors(spark, root), _thresholds(spark, root), "vec_id", "layer", "s", 5).withColumn("vote", F.round("vote", 6))


_ANOVA = """g AS (SELECT l_returnflag || l_linestatus AS g, l_quantity AS x FROM lineitem), m AS (SELECT g, count(*) AS n, avg(x) AS m, sum(x) AS s FROM g GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) / sum(n) AS gm FROM m), b AS (SELECT sum(m.n * (m - gm) ^ 2) AS b FROM m, t), w AS (SELECT sum((x - m) ^ 2) AS w FROM g JOIN m USING (g))"""


@query("anova_m12", f"WITH {_ANOVA} SELECT k::BIGINT AS k, n::BIGINT AS n, round((b / (k - 1)) / (w / (n - k)), 6) AS f, round(b / (b + w), 9) AS eta2 FROM t, b, w")
def anova(spark, root):
    li = table(spark, root, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("g"), "l_quantity")
    out = M.anova(li, "g", C("l_quantity"))
    return out.select("k", "n", r6("f", "f"), F.round("eta2", 9).alias("eta2"))


@query("anova_p_value_m12")
def anova_p_value(spark, root):
    li = table(spark, root, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("g"), "l_quantity")
    return M.anova(li, "g", C("l_quantity")).withColumn("p_value", M.f_p_value(C("f"), C("k") - 1, C("n") - C("k")))


@query("deviations_m13", """WITH o AS (SELECT o_custkey, o_orderpriority AS section, o_totalprice / 100000 AS x FROM orders), g AS (SELECT section, avg(x) AS g FROM o GROUP BY 1),
d AS (SELECT o_custkey, section, avg(x) - any_value(g) AS dev FROM o JOIN g USING (section) GROUP BY 1, 2)
SELECT section, count(*)::BIGINT AS n, round(corr(dev, c_acctbal), 6) AS r FROM d JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) >= 5""")
def deviations(spark, root):
    o = table(spark, root, "orders").select("o_custkey", C("o_orderpriority").alias("section"), (C("o_totalprice") / 100000).alias("x"))
    dev = M.deviations(o, "o_custkey", "section", C("x"))
    cust = table(spark, root, "customer").select(C("c_custkey").alias("o_custkey"), "c_acctbal")
    return dev.join(cust, "o_custkey").groupBy("section").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("deviation", "c_acctbal"), "r")).filter("n >= 5")


@query("sign_flip_m14", f"""WITH x AS (SELECT l_returnflag AS kind, round(l_discount - 0.05, 2) AS v FROM lineitem), b AS (SELECT kind, v FROM x UNION ALL SELECT 'all', v FROM x),
e AS (SELECT kind, v AS s, 1 AS y FROM b UNION ALL SELECT kind, -v, 0 FROM b), {_auroc_sql('e', 'kind')}, m AS (SELECT kind, avg(v) AS mean, stddev_samp(v) AS sd FROM b GROUP BY 1)
SELECT kind, n, round(auroc, 6) AS auroc, round(mean, 9) AS mean, round(sd, 6) AS sd FROM a JOIN m USING (kind)""")
def sign_flip(spark, root):
    x = table(spark, root, "lineitem").select(F.explode(F.array("l_returnflag", F.lit("all"))).alias("kind"), F.round(C("l_discount") - 0.05, 2).alias("x"))
    flipped = M.auroc(M.histogram(M.sign_flip(x, "x"), ["kind"], "y", "value"), ["kind"])
    effect = x.groupBy("kind").agg(F.round(F.avg("x"), 9).alias("mean"), r6(F.stddev_samp("x"), "sd"))
    return flipped.join(effect, "kind").select("kind", "n", r6("auroc", "auroc"), "mean", "sd")


_TM = """SELECT {g} AS fold, count(*)::BIGINT AS n, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy, round(avg((p - y) ^ 2), 6) AS brier,
 round(coalesce(count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (p >= 0.5), 0), 0), 6)::DOUBLE AS precision, round(coalesce(count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 0), 6)::DOUBLE AS recall,
 round(coalesce(2 * count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (p >= 0.5) + count(*) FILTER (y = 1), 0), 0), 6)::DOUBLE AS f1,
 round((coalesce(count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 0) + coalesce(count(*) FILTER (p < 0.5 AND y = 0) / nullif(count(*) FILTER (y = 0), 0), 0)) / 2, 6) AS balanced,
 round(greatest(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) / count(*), 6) AS baseline FROM f GROUP BY 1"""
_FOLD = f"{LAB}, f AS (SELECT doc_id % 5 AS fold, y, least(s / 4000, 1)::DOUBLE AS p FROM lab)"


@query("threshold_metrics_m15", f"WITH {_FOLD} {_TM.format(g='fold::VARCHAR')} UNION ALL {_TM.format(g=chr(39) + 'pooled' + chr(39))}")
def threshold_metrics(spark, root):
    lab = labelled(spark, root).select(F.explode(F.array((C("doc_id") % 5).cast("string"), F.lit("pooled"))).alias("fold"), "y", F.least(C("s") / 4000, F.lit(1.0)).alias("p"))
    out = M.threshold_metrics(lab, ["fold"], "y", "p")
    return out.select("fold", "n", *[r6(c, c) for c in out.columns[2:]])


@query("fold_summary_m15", f"WITH {_FOLD}, t AS ({_TM.format(g='fold')}) SELECT round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS sd_accuracy, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS sd_f1 FROM t")
def fold_summary(spark, root):
    lab = labelled(spark, root).select((C("doc_id") % 5).alias("fold"), "y", F.least(C("s") / 4000, F.lit(1.0)).alias("p"))
    t = M.threshold_metrics(lab, ["fold"], "y", "p").select(r6("accuracy", "accuracy"), r6("f1", "f1"))
    return t.agg(r6(F.avg("accuracy"), "mean_accuracy"), r6(F.stddev_pop("accuracy"), "sd_accuracy"), r6(F.avg("f1"), "mean_f1"), r6(F.stddev_pop("f1"), "sd_f1"))


@query("roc_points_m16", f"WITH {LAB}, {_auroc_sql('lab', '')} SELECT s AS score, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w), 6) AS precision FROM h WINDOW w AS (ORDER BY s DESC)")
def roc_points(spark, root):
    pts = M.roc_points(M.histogram(labelled(spark, root), [], "y", "s"), [])
    return pts.select("score", r6("tpr", "tpr"), r6("fpr", "fpr"), r6("precision", "precision"))


@query("calibration_m16", f"""WITH {_FOLD}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM f)
SELECT len(list_filter(e, lambda x: x <= p))::BIGINT AS bin, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, count(*)::BIGINT AS n FROM f, e GROUP BY 1""")
def calibration(spark, root):
    lab = labelled(spark, root).select("y", F.least(C("s") / 4000, F.lit(1.0)).alias("p"))
    return M.calibration(lab, "y", "p").select("bin", r6("predicted", "predicted"), r6("observed", "observed"), "n")


@query("cluster_bootstrap_m17", f"""WITH {LAB}, g AS (SELECT source, row_number() OVER (ORDER BY md5(source), source) - 1 AS g, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM lab)),
dr AS (SELECT rep, ('0x' || substr(md5('11:' || rep || ':' || slot), 1, 15))::BIGINT % k AS g FROM (SELECT g AS slot, k, unnest(range(0, 2000)) AS rep FROM g)),
w AS (SELECT rep, source, count(*) AS w FROM dr JOIN g USING (g) GROUP BY 1, 2),
hh AS (SELECT rep, s, sum(w * (y = 1)::INT) AS pos, sum(w * (y <> 1)::INT) AS neg FROM w JOIN lab USING (source) GROUP BY 1, 2),
cc AS (SELECT *, sum(neg) OVER (PARTITION BY rep ORDER BY s) - neg / 2 AS below FROM hh), r AS (SELECT rep, sum(pos * below) / sum(pos) / sum(neg) AS au FROM cc GROUP BY 1 HAVING sum(pos) > 0 AND sum(neg) > 0),
{_auroc_sql('lab', '')} SELECT round(any_value(auroc), 6) AS auroc, round(quantile_cont(au, 0.025), 6) AS low, round(quantile_cont(au, 0.975), 6) AS high, count(*)::BIGINT AS n_reps FROM r, a""")
def cluster_bootstrap(spark, root):
    out = M.cluster_bootstrap(labelled(spark, root), "source", "y", "s", 2000, "11")
    return out.select(r6("auroc", "auroc"), r6("low", "low"), r6("high", "high"), "n_reps")


@query("rate_by_decile_m18", """WITH x AS (SELECT l_linenumber::BIGINT AS layer, l_extendedprice AS x, (l_returnflag = 'R')::INT AS y FROM lineitem), e AS (SELECT layer, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, count(*) AS n FROM x GROUP BY 1)
SELECT layer, len(list_filter(e, lambda q: q <= x))::BIGINT AS bin, round(avg(y), 6) AS rate, count(*)::BIGINT AS n FROM x JOIN e USING (layer) WHERE e.n >= 20 GROUP BY 1, 2""")
def rate_by_decile(spark, root):
    x = table(spark, root, "lineitem").select(C("l_linenumber").cast("bigint").alias("layer"), C("l_extendedprice").alias("x"), (C("l_returnflag") == "R").cast("int").alias("y"))
    return M.rates_by_bin(x, ["layer"], "x", C("y"), 10, 20).select("layer", "bin", r6("rate", "rate"), "n")


@query("ecdf_m19", "SELECT DISTINCT l_returnflag, l_linenumber::BIGINT AS layer, l_quantity AS value, round(cume_dist() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_quantity), 6) AS share FROM lineitem")
def ecdf(spark, root):
    li = table(spark, root, "lineitem").select("l_returnflag", C("l_linenumber").cast("bigint").alias("layer"), "l_quantity")
    return M.ecdf(li, ["l_returnflag", "layer"], "l_quantity").withColumn("share", F.round("share", 6))


@query("center_m20", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 9) AS centered FROM events")
def center(spark, root):
    return M.center(table(spark, root, "events").select("event_id", "user_id", "value"), ["user_id"], "value").select("event_id", F.round("centered", 9).alias("centered"))


_CT = "x AS (SELECT l_returnflag, l_linenumber::BIGINT AS layer, l_discount AS v, l_quantity AS len FROM lineitem)"


def _flag_rows(spark, root):
    return table(spark, root, "lineitem").select("l_returnflag", C("l_linenumber").cast("bigint").alias("layer"), C("l_discount").alias("v"), C("l_quantity").alias("len"))


@query("contrast_m21", f"WITH {_CT}, m AS (SELECT l_returnflag, layer, avg(v) AS m, count(*) AS n FROM x GROUP BY 1, 2) SELECT a.l_returnflag, a.layer, a.n::BIGINT AS n, round(a.m - b.m, 6) AS difference FROM m a JOIN m b ON a.layer = b.layer AND b.l_returnflag = 'N' WHERE a.l_returnflag <> 'N'")
def contrast(spark, root):
    return M.contrast(_flag_rows(spark, root), "l_returnflag", "layer", "v", "N").withColumn("difference", F.round("difference", 6))


@query("contrast_matched_m21", f"""WITH {_CT}, e AS (SELECT quantile_cont(len, [0.25, 0.5, 0.75]) AS e FROM x), m AS (SELECT l_returnflag, layer, len(list_filter(e, lambda q: q <= len)) AS bin, avg(v) AS m, count(*) AS c FROM x, e GROUP BY 1, 2, 3)
SELECT a.l_returnflag, a.layer, round(sum((a.m - b.m) * a.c) / sum(a.c), 6) AS difference, sum(a.c)::BIGINT AS n FROM m a JOIN m b ON a.layer = b.layer AND a.bin = b.bin AND b.l_returnflag = 'N' WHERE a.l_returnflag <> 'N' GROUP BY 1, 2""")
def contrast_matched(spark, root):
    return M.contrast_matched(_flag_rows(spark, root), "l_returnflag", "layer", "v", "len", "N", 4).withColumn("difference", F.round("difference", 6))


@query("mean_ci_m22", """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value)::BIGINT AS n, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem,
 round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS half_width, count(DISTINCT user_id)::BIGINT AS n_units FROM events GROUP BY 1""")
def mean_ci(spark, root):
    out = M.mean_ci(table(spark, root, "events"), ["event_type"], "value", "user_id")
    return out.select("event_type", r6("mean", "mean"), r6("sd", "sd"), "n", r6("sem", "sem"), r6("half_width", "half_width"), "n_units")


_GEN = "gn AS (SELECT layer, vec_id % 5 AS gen, s, y FROM lng)"


@query("macro_m23", f"WITH {LONG}, {_GEN}, {_auroc_sql('gn', 'layer, gen', 2)} SELECT layer, round(avg(auroc), 6) AS mean, round(stddev_pop(auroc), 6) AS sd, count(auroc)::BIGINT AS n_units FROM a GROUP BY 1")
def macro(spark, root):
    rows = long_vectors(spark, root).withColumn("gen", C("vec_id") % 5)
    per = M.auroc(M.histogram(rows, ["layer", "gen"], "y", "s"), ["layer", "gen"], 2)
    return M.macro(per, ["layer"], "auroc").select("layer", r6("mean", "mean"), r6("sd", "sd"), "n_units")


def grain_rollup(words, sentence, response, score, label, width, content):
    """The same score at token, word, content-word, sentence and response grain.

    A word counts once per token it spans; a sentence or response has the mean
    score and any label.
    """
    def summary(df, grain):
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_pos"), F.avg(score).alias("mean_score")).withColumn("grain", F.lit(grain))

    token = words.agg(F.sum(width).cast("bigint").alias("n"), F.sum(C(label) * C(width)).cast("bigint").alias("n_pos"),
                      (F.sum(C(score) * C(width)) / F.sum(width)).alias("mean_score")).withColumn("grain", F.lit("token"))
    sents = words.groupBy(sentence, response).agg(F.avg(score).alias(score), F.max(label).alias(label))
    resp = words.groupBy(response).agg(F.avg(score).alias(score), F.max(label).alias(label))
    parts = [token, summary(words, "word"), summary(words.filter(content), "content_word"), summary(sents, "sentence"), summary(resp, "response")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("grain", "n", C("n_pos").cast("bigint").alias("n_pos"), "mean_score")


@query("grain_rollup_m24", """WITH w AS (SELECT o_custkey AS r, o_orderkey AS st, l_discount AS s, (l_returnflag = 'R')::INT AS y, l_quantity::BIGINT AS k, l_linestatus = 'O' AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
se AS (SELECT avg(s) AS s, max(y) AS y FROM w GROUP BY st, r), re AS (SELECT avg(s) AS s, max(y) AS y FROM w GROUP BY r)
SELECT 'token' AS grain, sum(k)::BIGINT AS n, sum(y * k)::BIGINT AS n_pos, round(sum(s * k) / sum(k), 9) AS mean_score FROM w UNION ALL SELECT 'word', count(*), sum(y)::BIGINT, round(avg(s), 9) FROM w
UNION ALL SELECT 'content_word', count(*), sum(y)::BIGINT, round(avg(s), 9) FROM w WHERE c UNION ALL SELECT 'sentence', count(*), sum(y)::BIGINT, round(avg(s), 9) FROM se UNION ALL SELECT 'response', count(*), sum(y)::BIGINT, round(avg(s), 9) FROM re""")
def grain(spark, root):
    li = table(spark, root, "lineitem").select(C("l_orderkey").alias("st"), C("l_discount").alias("s"), (C("l_returnflag") == "R").cast("int").alias("y"),
                                               C("l_quantity").cast("bigint").alias("k"), (C("l_linestatus") == "O").alias("c"))
    words = li.join(table(spark, root, "orders").select(C("o_orderkey").alias("st"), C("o_custkey").alias("r")), "st")
    return grain_rollup(words, "st", "r", "s", "y", "k", C("c")).withColumn("mean_score", F.round("mean_score", 9))


@query("recovery_m25", """WITH x AS (SELECT l_returnflag, l_linestatus, round(CASE WHEN abs(l_extendedprice - p_retailprice) < 1e-6 THEN 0 ELSE (l_extendedprice * (1 - l_discount) - p_retailprice) / (l_extendedprice - p_retailprice) END, 6) AS rec
 FROM lineitem JOIN part ON p_partkey = l_partkey), m AS (SELECT l_returnflag, l_linestatus, avg(rec) AS m, count(*) AS n FROM x GROUP BY 1, 2)
SELECT a.l_returnflag, a.l_linestatus, a.n::BIGINT AS n, round(a.m - b.m, 4) AS delta FROM m a JOIN m b ON a.l_linestatus = b.l_linestatus AND b.l_returnflag = 'N'""")
def recovery(spark, root):
    li = table(spark, root, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount")
    part = table(spark, root, "part").select(C("p_partkey").alias("l_partkey"), "p_retailprice")
    rec = F.round(M.recovery(C("l_extendedprice"), C("p_retailprice"), C("l_extendedprice") * (1 - C("l_discount"))), 6)
    m = li.join(part, "l_partkey").groupBy("l_returnflag", "l_linestatus").agg(F.avg(rec).alias("m"), F.count(F.lit(1)).alias("n"))
    base = m.filter("l_returnflag = 'N'").select("l_linestatus", C("m").alias("b"))
    return m.join(base, "l_linestatus").select("l_returnflag", "l_linestatus", "n", F.round(C("m") - C("b"), 4).alias("delta"))
