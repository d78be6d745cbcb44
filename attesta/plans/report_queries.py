"""Reports and summaries (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import metrics as M
from ..operators import report as R
from ..sources.tables import table
from .match_queries import MATCHED_SQL, UNCERTAIN_SQL, matched_facts, turn_uncertainty
from .metric_queries import LONG, _auroc_sql, long_vectors
from .registry import query
from .score_queries import r6
from .window_queries import _rubric_sql, rubric_values

C = F.col

# every fourth sentence of a turn is read as a header line
_SEC = """coalesce(last_value(CASE WHEN idx % 4 = 2 THEN (['Subjective', 'Objective', 'Assessment', 'Plan', 'Follow-up'])[1 + (idx // 4 + turn) % 5] END IGNORE NULLS)
 OVER (PARTITION BY conv_id, turn ORDER BY idx), 'Preamble')"""
_BAND = "round(avg((uncertainty >= {a} AND uncertainty < {b})::INT), 9) AS share_q{i}"
_BANDS = ", ".join(_BAND.format(a=a, b=b, i=i) for i, (a, b) in enumerate([(0, .25), (.25, .5), (.5, .75), (.75, 1.001)], 1))


@query("section_table_g1", f"""WITH {UNCERTAIN_SQL}, t AS (SELECT {_SEC} AS section, uncertainty FROM unc), k AS (SELECT section, uncertainty FROM t WHERE section <> 'Preamble' UNION ALL SELECT 'All', uncertainty FROM t WHERE section <> 'Preamble')
SELECT list_position(['Subjective', 'Objective', 'Assessment', 'Plan', 'Follow-up', 'All'], section)::BIGINT AS position, section, count(*)::BIGINT AS n, {_BANDS}, round(avg(uncertainty), 9) AS mean_u FROM k GROUP BY section""")
def section_table(spark, root):
    """Which sections hold the least supported sentences?"""
    heads = F.array(*[F.lit(f"{s}:") for s in K.TABLE_SECTIONS])
    marked = F.transform(T.sentences(C("text")), lambda s, i: F.when(
        i % 4 == 2, F.get(heads, ((F.floor(i / 4) + C("turn")) % 5).cast("int"))).otherwise(s))
    sections = table(spark, root, "conversations").select("conv_id", "turn", F.posexplode(T.fill_sections(marked)).alias("idx", "section"))
    rows = turn_uncertainty(spark, root).join(sections.withColumn("idx", C("idx").cast("bigint")), ["conv_id", "turn", "idx"])
    out = R.section_table(rows, "section", "uncertainty")
    return out.select("position", "section", "n", *[F.round(f"share_q{i}", 9).alias(f"share_q{i}") for i in range(1, 5)], F.round("mean_u", 9).alias("mean_u"))


@query("stats_by_g2", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def stats_by(spark, root):
    out = R.stats_by(table(spark, root, "orders"), "o_orderpriority", "o_totalprice")
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd")], "n")


@query("bucket_counts_g3", """WITH x AS (SELECT l_discount * 10 AS x FROM lineitem), e AS (SELECT unnest(range(0, 10)) AS bin), c AS (SELECT len(list_filter(range(1, 10), lambda i: i * (1.0::DOUBLE / 10) < x)) AS bin, count(*) AS n FROM x WHERE x >= 0 AND x <= 1 GROUP BY 1)
SELECT e.bin::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n FROM e LEFT JOIN c USING (bin)""")
def bucket_counts(spark, root):
    return R.bucket_counts(table(spark, root, "lineitem"), C("l_discount") * 10)


@query("per_note_box_g4", """WITH n AS (SELECT o_custkey, avg(o_totalprice) / 1000 AS m FROM orders GROUP BY 1), q AS (SELECT c_nationkey, quantile_cont(m, [0, 0.25, 0.5, 0.75, 1]) AS q, avg(m) AS mean, stddev_pop(m) AS sd, count(*) AS n FROM n JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT c_nationkey, round(q[1], 4) AS low, round(q[2], 4) AS q1, round(q[3], 4) AS median, round(q[4], 4) AS q3, round(q[5], 4) AS high, round(mean, 4) AS mean, round(sd, 4) AS sd, n::BIGINT AS n FROM q""")
def per_note_box(spark, root):
    notes = table(spark, root, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg((F.avg("o_totalprice") / 1000).alias("m"))
    out = R.five_numbers(notes.join(table(spark, root, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), ["c_nationkey"], "m")
    return out.select("c_nationkey", *[F.round(c, 4).alias(c) for c in ("low", "q1", "median", "q3", "high", "mean", "sd")], "n")


@query("pivot_counts_g5", "SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A')::BIGINT AS \"A\", count(*) FILTER (l_returnflag = 'N')::BIGINT AS \"N\", count(*) FILTER (l_returnflag = 'R')::BIGINT AS \"R\", 0::BIGINT AS \"X\" FROM lineitem GROUP BY 1")
def pivot_counts(spark, root):
    return R.pivot_counts(table(spark, root, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R", "X"])


@query("auroc_pivot_g5", f"""WITH {LONG}, tg AS (SELECT label AS target, layer, s, 1 AS y FROM lng UNION ALL SELECT t.label, layer, s, 0 FROM lng, (SELECT DISTINCT label FROM embeddings) t WHERE lng.label <> t.label),
{_auroc_sql('tg', 'target, layer')} SELECT target::BIGINT AS target, """ + ", ".join(f"round(max(auroc) FILTER (layer = {k}), 6) AS f{k}" for k in range(64)) + " FROM a GROUP BY 1")
def auroc_pivot(spark, root):
    """Target by feature table: every label against the rest, all layers."""
    counts = long_vectors(spark, root).groupBy("layer", C("label").alias("target"), C("s").alias("score")).agg(F.count(F.lit(1)).alias("c"))
    wide = M.one_against_rest(counts, ["layer"], "target", "score", "c").groupBy("target").pivot("layer", list(range(64))).agg(F.first("auroc"))
    return wide.select(C("target").cast("bigint").alias("target"), *[r6(C(str(k)), f"f{k}") for k in range(64)])


_LB = "CASE event_type WHEN 'click' THEN 'Faithful' WHEN 'view' THEN 'Fabrication' WHEN 'error' THEN 'Negation' WHEN 'purchase' THEN 'PARSE_ERROR' ELSE 'Contextual' END"
_LABELS = ["Faithful", "Fabrication", "Negation", "Causality", "Contextual", "PARSE_ERROR"]


@query("judge_summary_g6", f"WITH e AS (SELECT user_id, {_LB} AS l, CASE WHEN value > 100 THEN 'x' ELSE '' END AS sp FROM events) SELECT user_id, count(*)::BIGINT AS n_rows, count(nullif(sp, ''))::BIGINT AS n_spans, round(1 - count(*) FILTER (l = 'Faithful') / count(*), 6) AS error_rate, "
       + ", ".join(f"count(*) FILTER (l = '{v}')::BIGINT AS n_{v.lower()}" for v in _LABELS) + " FROM e GROUP BY 1")
def judge_summary(spark, root):
    ev = table(spark, root, "events").select("user_id", F.expr(_LB).alias("l"), F.when(C("value") > 100, "x").otherwise("").alias("sp"))
    return R.judge_summary(ev, ["user_id"], "l", "sp", _LABELS).withColumn("error_rate", F.round("error_rate", 6))


@query("match_summary_g7", f"""WITH {MATCHED_SQL}, g AS (SELECT conv_id, matched_by FROM mt UNION ALL SELECT NULL, matched_by FROM mt)
SELECT conv_id, count(*)::BIGINT AS n_facts, count(matched_by)::BIGINT AS n_clean, """ + ", ".join(f"count(*) FILTER (matched_by = '{m}')::BIGINT AS n_{m}" for m in ("entity", "name", "number", "medical_token", "lcs"))
       + ", round(count(matched_by) / count(*), 6) AS clean_rate FROM g GROUP BY 1")
def match_summary(spark, root):
    return R.match_summary(matched_facts(spark, root), ["conv_id"], ["entity", "name", "number", "medical_token", "lcs"]).withColumn("clean_rate", F.round("clean_rate", 6))


@query("coverage_g8", """WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS r, bool_or(l_discount > 0.08) AS d FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*)::BIGINT AS n_rows, count(n)::BIGINT AS n_matched, count(*) FILTER (n >= 3)::BIGINT AS n_assigned, count(*) FILTER (n >= 3 AND r)::BIGINT AS n_evaluated, count(*) FILTER (n >= 3 AND r AND d)::BIGINT AS n_positive
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def coverage(spark, root):
    li = table(spark, root, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(C("l_returnflag") == "R").alias("r"), F.bool_or(C("l_discount") > 0.08).alias("d"))
    rows = table(spark, root, "orders").select("o_orderkey", "o_orderpriority").join(li, "o_orderkey", "left")
    return R.coverage(rows, ["o_orderpriority"], {"matched": C("n").isNotNull(), "assigned": C("n") >= 3, "evaluated": C("r"), "positive": C("d")})


@query("rubric_summary_g9", _rubric_sql().rsplit("SELECT doc_id, count(*) FILTER", 1)[0] + "SELECT item, round(avg(v), 6) AS mean, count(v)::BIGINT AS n, count(*) FILTER (NOT coalesce(na OR CASE WHEN item IN ('abstraction', 'voice_summ', 'voice_note') THEN v IN (0, 1) ELSE v BETWEEN 1 AND 5 END, FALSE))::BIGINT AS n_invalid FROM t GROUP BY 1")
def rubric_summary(spark, root):
    return R.rubric_summary(rubric_values(spark, root)).withColumn("mean", F.round("mean", 6))


@query("rank_contributions_g10", "SELECT l_suppkey, l_linenumber::BIGINT AS l_linenumber, round(avg(abs(l_discount - 0.05)), 9) AS mean_abs, count(*)::BIGINT AS appearances FROM lineitem GROUP BY 1, 2 ORDER BY mean_abs DESC, 1, 2 LIMIT 20")
def rank_contributions(spark, root):
    li = table(spark, root, "lineitem").select("l_suppkey", C("l_linenumber").cast("bigint").alias("l_linenumber"), "l_discount")
    return R.rank_contributions(li, ["l_suppkey", "l_linenumber"], C("l_discount") - 0.05, 20)


@query("contribution_matrix_g10", "SELECT l_suppkey, " + ", ".join(f"round(avg(abs(l_discount - 0.05)) FILTER (l_linenumber = {k}), 9) AS h{k}" for k in range(1, 8)) + " FROM lineitem GROUP BY 1")
def contribution_matrix(spark, root):
    wide = table(spark, root, "lineitem").groupBy("l_suppkey").pivot("l_linenumber", list(range(1, 8))).agg(F.avg(F.abs(C("l_discount") - 0.05)))
    return wide.select("l_suppkey", *[F.round(C(str(k)), 9).alias(f"h{k}") for k in range(1, 8)])


# fixed values: price per million tokens in and out, by model tier
PRICES = [("large", 0.72, 0.72), ("small", 0.22, 0.22), ("open", 0.07, 0.30)]


def calls(df):
    """Usage records: the event type as stage, one of four models."""
    model = F.get(F.array(F.lit("large"), F.lit("small"), F.lit("open"), F.lit("other")), (C("event_id") % 4).cast("int"))
    return df.select(C("event_type").alias("stage"), model.alias("model"), F.floor(C("value") * 100).alias("tokens_in"), F.floor(C("value") * 10).alias("tokens_out"))


def prices(spark):
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


@query("cost_rollup_g11", """WITH p(model, pin, pout) AS (VALUES ('large', 0.72::DOUBLE, 0.72::DOUBLE), ('small', 0.22, 0.22), ('open', 0.07, 0.30)),
c AS (SELECT event_type AS stage, (['large', 'small', 'open', 'other'])[1 + event_id % 4] AS model, floor(value * 100)::BIGINT AS ti, floor(value * 10)::BIGINT AS tk FROM events),
g AS (SELECT stage, c.model, ti, tk, pin, coalesce((ti * pin + tk * pout) / 1e6, 0) AS cost FROM c LEFT JOIN p ON p.model = c.model)
SELECT stage, model, count(*)::BIGINT AS n_calls, sum(ti)::BIGINT AS tokens_in, sum(tk)::BIGINT AS tokens_out, round(sum(cost), 6) AS cost, count(*) FILTER (pin IS NULL)::BIGINT AS n_unpriced FROM g GROUP BY ROLLUP (stage, model)""")
def cost_rollup(spark, root):
    return R.cost_rollup(calls(table(spark, root, "events")), prices(spark)).withColumn("cost", F.round("cost", 6))


@query("workload_g12", """SELECT count(*)::BIGINT AS n_samples, count(*) FILTER (n IS NULL)::BIGINT AS n_default, (sum(coalesce(n, 24)) * 4)::BIGINT AS n_calls, (sum(coalesce(n, 24)) * 4 * 300)::BIGINT AS tokens, round((sum(coalesce(n, 24)) * 4 * 300)::DOUBLE * 0.22 / 1e6, 6) AS cost
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def workload(spark, root):
    counts = table(spark, root, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return R.workload(table(spark, root, "orders").select("o_orderkey"), counts, "o_orderkey", "n", 5, 24, 300, 0.22).withColumn("cost", F.round("cost", 6))


@query("centroids_g13", """WITH m AS (SELECT quantile_cont(l_discount, 0.5) AS a, quantile_cont(l_tax, 0.5) AS b FROM lineitem WHERE l_returnflag = 'N')
SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(l_discount), 6) AS mean_l_discount, round(avg(l_tax), 6) AS mean_l_tax, any_value(a) AS line_l_discount, any_value(b) AS line_l_tax FROM lineitem, m GROUP BY 1""")
def centroids(spark, root):
    out = R.centroids(table(spark, root, "lineitem").select("l_returnflag", "l_discount", "l_tax"), "l_returnflag", ["l_discount", "l_tax"], "N")
    return out.select("l_returnflag", "n", r6("mean_l_discount", "mean_l_discount"), r6("mean_l_tax", "mean_l_tax"), "line_l_discount", "line_l_tax")


@query("select_cases_g14", """WITH e AS (SELECT o_custkey AS id, avg(o_totalprice) / 500000 AS mlp, avg((o_orderstatus = 'O')::INT) AS back, coalesce(avg(o_totalprice / 500000) FILTER (o_orderpriority = '1-URGENT'), 0) AS am,
 coalesce(avg((o_orderstatus = 'O')::INT) FILTER (o_orderpriority = '1-URGENT'), 0) AS ab, count(*) FILTER (o_totalprice > 400000) AS hi, any_value(1 + c_custkey % 5) AS acc FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
b AS (SELECT id FROM e WHERE am > 0.3 AND ab > 0.2 AND ab < 0.6 AND acc <= 2 ORDER BY id LIMIT 7), c AS (SELECT id FROM e WHERE acc >= 3.5 AND hi >= 3 ORDER BY id LIMIT 7), bc AS (SELECT id, 'B' AS category FROM b UNION ALL SELECT id, 'C' FROM c),
a AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM e WHERE mlp > 0.5 AND back < 0.4 AND acc >= 4)
SELECT id, 'A' AS category FROM a WHERE r + (SELECT count(*) FROM bc WHERE bc.id < a.id) < 7 UNION ALL SELECT id, category FROM bc""")
def select_cases(spark, root):
    """Encounters from customers: three rules with their caps."""
    o = table(spark, root, "orders").select(C("o_custkey").alias("id"), (C("o_totalprice") / 500000).alias("mlp"), (C("o_orderstatus") == "O").cast("int").alias("back"),
                                            (C("o_orderpriority") == "1-URGENT").alias("assess"), (C("o_totalprice") > 400000).alias("big"))
    cust = table(spark, root, "customer").select(C("c_custkey").alias("id"), (1 + C("c_custkey") % 5).alias("acc"))
    zero = F.lit(0.0)
    e = o.groupBy("id").agg(F.avg("mlp").alias("mlp"), F.avg("back").alias("back"), F.coalesce(F.avg(F.when(C("assess"), C("mlp"))), zero).alias("am"),
                            F.coalesce(F.avg(F.when(C("assess"), C("back"))), zero).alias("ab"), F.count_if("big").alias("hi")).join(cust, "id")
    return R.select_cases(e, "id", (C("mlp") > 0.5) & (C("back") < 0.4) & (C("acc") >= 4),
                          (C("am") > 0.3) & (C("ab") > 0.2) & (C("ab") < 0.6) & (C("acc") <= 2), (C("acc") >= 3.5) & (C("hi") >= 3), 7)


@query("case_report_g14", """WITH e AS (SELECT vec_id, (['A', 'B', 'C'])[1 + vec_id % 3] AS category, embedding[1:32] AS a, embedding[33:64] AS m FROM embeddings),
g AS (SELECT vec_id, category, CASE WHEN list_max(a) > 0.3 AND list_max(m) <= 0.3 THEN 'retrieval' WHEN list_max(m) > 0.3 AND list_max(a) <= 0.3 THEN 'parametric' WHEN list_max(a) > 0.3 AND list_max(m) > 0.3 THEN 'mixed' ELSE 'neither' END AS grounding,
 list_position(a, list_max(a)) - 1 AS pa, list_position(m, list_max(m)) - 1 AS pm FROM e)
SELECT vec_id, category, grounding, CASE WHEN category = 'B' THEN grounding = 'retrieval' ELSE grounding = 'parametric' END AS blind_spot, pa::BIGINT AS peak_attention, pm::BIGINT AS peak_mlp FROM g""")
def case_report(spark, root):
    vec = table(spark, root, "embeddings").select(
        "vec_id", F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (C("vec_id") % 3).cast("int")).alias("category"),
        F.slice("embedding", 1, 32).cast("array<double>").alias("a"), F.slice("embedding", 33, 32).cast("array<double>").alias("m"))
    return R.case_report(vec, "category", "a", "m").drop("a", "m")
