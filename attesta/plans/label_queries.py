"""Labels and votes (J), agreement (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import sql as S
from ..functions import text as T
from ..operators import labels as L
from ..operators.ordered import day_bucket, with_position
from ..sources.tables import table
from .match_queries import SENT, VOTES_SQL, votes
from .registry import query
from .score_queries import r6
from .stand_ins import document_sentences
from .window_queries import POS_SQL, user_events

C = F.col

_MAP = "CASE event_type WHEN 'click' THEN 'Faithful' WHEN 'view' THEN 'Fabrication' WHEN 'error' THEN 'Negation' WHEN 'purchase' THEN 'PARSE_ERROR' ELSE 'Contextual' END"


@query("label_maps_j1", f"""WITH l AS (SELECT event_id, {_MAP} AS l FROM events)
SELECT event_id, CASE WHEN l = 'Faithful' THEN 0 WHEN l = 'PARSE_ERROR' THEN NULL ELSE 1 END::BIGINT AS bin, CASE WHEN l = 'PARSE_ERROR' THEN 'Not Faithful' ELSE l END AS five,
 CASE WHEN l = 'Faithful' THEN l ELSE 'Not Faithful' END AS two FROM l""")
def label_maps(spark, root):
    lab = F.expr(_MAP)
    return table(spark, root, "events").select("event_id", L.binary_label(lab).alias("bin"), L.five_class(lab).alias("five"), L.two_class(lab).alias("two"))


@query("collapse_j2", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem)
SELECT l_orderkey, max(l_returnflag) FILTER (rn = 1) AS flag, max((l_linestatus <> 'F')::INT)::BIGINT AS label FROM r GROUP BY 1""")
def collapse(spark, root):
    li = table(spark, root, "lineitem").select(
        "l_orderkey", C("l_returnflag").alias("flag"), F.when(C("l_linestatus") == "F", " Faithful").otherwise("Negation").alias("kind"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"))
    return L.collapse(li, ["l_orderkey"], C("pos"), "flag", "kind")


_JUDGED = f"""jd AS (SELECT doc_id, idx, s, (['Faithful', 'Fabrication', 'Negation', 'PARSE_ERROR'])[1 + (idx + doc_id) % 4] AS label,
 substr(s, 1, length(s) // 2) AS flagged, substr(s, CASE WHEN idx % 2 = 0 THEN length(s) // 3 ELSE length(s) // 2 END + 1) AS fact FROM sent)"""


def judged(spark, root):
    kinds = F.array(*[F.lit(x) for x in ("Faithful", "Fabrication", "Negation", "PARSE_ERROR")])
    return document_sentences(spark, root).select(
        "doc_id", "idx", "s", F.get(kinds, ((C("idx") + C("doc_id")) % 4).cast("int")).alias("label"), F.left("s", F.floor(F.length("s") / 2).cast("int")).alias("flagged"),
        F.substr(C("s"), F.floor(F.length("s") / F.when(C("idx") % 2 == 0, 3).otherwise(2)).cast("int") + 1).alias("fact"))


@query("strict_labels_j3", f"""WITH {SENT}, {_JUDGED}, y AS (SELECT *, CASE WHEN label = 'Faithful' THEN 0 WHEN label <> 'PARSE_ERROR' THEN 1 END AS y FROM jd)
SELECT doc_id, idx, CASE WHEN y = 0 THEN 0 WHEN y = 1 AND list_has_any({S.long_words('fact')}, {S.long_words('flagged')}) THEN 1 END::BIGINT AS strict, y::BIGINT AS loose FROM y WHERE y IS NOT NULL""")
def strict_labels(spark, root):
    j = judged(spark, root).withColumn("loose", L.binary_label(C("label"))).filter("loose is not null")
    return j.select("doc_id", "idx", L.strict_label(C("label"), C("fact"), C("flagged")).alias("strict"), "loose")


@query("span_labels_j4", f"""WITH {SENT}, {_JUDGED}, p AS (SELECT *, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS n, trim(regexp_replace(fact, '\\s+', ' ', 'g')) AS f, trim(regexp_replace(flagged, '\\s+', ' ', 'g')) AS g FROM jd),
o AS (SELECT *, CASE WHEN f = '' THEN NULL ELSE CASE WHEN strpos(n, f) > 0 THEN strpos(n, f) ELSE strpos(lower(n), lower(f)) END END AS a, strpos(n, g) AS b FROM p),
y AS (SELECT doc_id, idx, CASE WHEN label = 'Faithful' THEN 'faithful' WHEN label = 'PARSE_ERROR' THEN NULL WHEN a IS NOT NULL AND b > 0 THEN CASE WHEN a < b + length(g) AND b < a + length(f) THEN 'chars' END
 WHEN list_has_any({S.long_words('fact')}, {S.long_words('flagged')}) THEN 'words' END AS method FROM o)
SELECT doc_id, idx, (method <> 'faithful')::INT::BIGINT AS y, method FROM y WHERE method IS NOT NULL""")
def span_labels(spark, root):
    j = judged(spark, root).withColumn("r", L.span_label(C("s"), C("label"), C("fact"), C("flagged"))).filter("r is not null")
    return j.select("doc_id", "idx", C("r.y").alias("y"), C("r.method").alias("method"))


@query("outer_clean_spans_j5", f"""WITH p AS (SELECT user_id, {POS_SQL} AS pos, value > 150 AS bad FROM events), g AS (SELECT user_id, count(*) AS n, min(pos) FILTER (bad) AS a, max(pos + 1) FILTER (bad) AS z FROM p GROUP BY 1),
s AS (SELECT user_id, 0 AS st, coalesce(a, n) AS en FROM g UNION ALL SELECT user_id, z, n FROM g WHERE a IS NOT NULL)
SELECT user_id, st::BIGINT AS start_at, en::BIGINT AS end_at FROM s WHERE en > st""")
def outer_clean_spans(spark, root):
    pos = with_position(user_events(spark, root, "value"), ["user_id"], ["ts", "event_id"])
    units = pos.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    flagged = pos.filter("value > 150").select("user_id", C("pos").alias("start"), (C("pos") + 1).alias("end"))
    return L.outer_clean_spans(units, flagged, ["user_id"], "n").select("user_id", C("start").alias("start_at"), C("end").alias("end_at"))


@query("clean_groups_j5", """SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS day, count(*)::BIGINT AS n_rows FROM events GROUP BY 1, 2 HAVING bool_and(event_type <> 'error')""")
def clean_groups(spark, root):
    ev = table(spark, root, "events").select("user_id", day_bucket(C("ts")).alias("day"), "event_type")
    return L.clean_groups(ev, ["user_id", "day"], C("event_type") != "error")


@query("threshold_label_j6", "SELECT event_id, (value > 50)::INT::BIGINT AS y FROM events WHERE value IS NOT NULL")
def threshold_label(spark, root):
    return table(spark, root, "events").select("event_id", L.threshold_label(C("value"), 50).alias("y")).filter("y is not null")


def _consensus(spark, root):
    return table(spark, root, "labels").filter("doc_id % 2 = 0").select(
        "doc_id", F.when(C("toxic") == 1, "Not Faithful").otherwise("Faithful").alias("agreed"))


@query("majority_j7", f"""WITH {VOTES_SQL}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (verdict <> 'Faithful') AS bad FROM votes GROUP BY 1),
k AS (SELECT doc_id, type FROM (SELECT doc_id, type, count(*) AS c, min(rater) AS f FROM votes WHERE type IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) = 1),
g AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Not Faithful' ELSE 'Faithful' END AS agreed FROM labels WHERE doc_id % 2 = 0),
r AS (SELECT c.*, type, CASE WHEN n = 1 THEN 'single_annotator' WHEN bad = 0 OR bad = n THEN 'unanimous' WHEN bad * 2 <> n THEN 'majority' WHEN agreed IS NOT NULL THEN 'consensus_file' ELSE 'unresolved_tie' END AS resolution,
 CASE WHEN bad * 2 > n THEN 'Not Faithful' WHEN bad * 2 < n THEN 'Faithful' ELSE agreed END AS verdict FROM c LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n, bad::BIGINT AS bad, resolution, verdict, CASE WHEN verdict = 'Not Faithful' THEN type END AS error_type FROM r""")
def majority(spark, root):
    return L.majority(votes(spark, root), _consensus(spark, root), "doc_id")


@query("disagreements_j8", f"""WITH {VOTES_SQL} SELECT doc_id, count(*)::BIGINT AS n_raters, count(DISTINCT verdict)::BIGINT AS n_verdicts,
 count(DISTINCT CASE WHEN verdict <> 'Faithful' THEN coalesce(type, '') END)::BIGINT AS n_types FROM votes GROUP BY 1 HAVING count(*) >= 2 AND (count(DISTINCT verdict) > 1
 OR count(DISTINCT CASE WHEN verdict <> 'Faithful' THEN coalesce(type, '') END) > 1)""")
def disagreements(spark, root):
    return L.disagreements(votes(spark, root), "doc_id")


def _five(spark, root):
    return votes(spark, root).withColumn("five", L.vote_class(C("verdict"), C("type")))


_FIVE_SQL = f"{VOTES_SQL}, v5 AS (SELECT doc_id, rater, verdict, CASE WHEN verdict = 'Faithful' THEN verdict ELSE coalesce(type, 'Not Faithful') END AS five FROM votes)"


def _kappa_sql(col):
    return f"""WITH {_FIVE_SQL}, p AS (SELECT a.rater AS rater_a, b.rater AS rater_b, a.{col} AS la, b.{col} AS lb FROM v5 a JOIN v5 b ON a.doc_id = b.doc_id AND a.rater < b.rater),
n AS (SELECT rater_a, rater_b, count(*) AS n, avg((la = lb)::INT) AS po FROM p GROUP BY 1, 2), x AS (SELECT rater_a, rater_b, la AS l, count(*) AS c FROM p GROUP BY 1, 2, 3), y AS (SELECT rater_a, rater_b, lb AS l, count(*) AS c FROM p GROUP BY 1, 2, 3),
e AS (SELECT rater_a, rater_b, sum(x.c * y.c) AS e FROM x JOIN y USING (rater_a, rater_b, l) GROUP BY 1, 2)
SELECT rater_a, rater_b, n::BIGINT AS n_items, round(po, 6) AS agreement, round((po - e / n / n) / (1 - e / n / n), 6) AS kappa FROM n JOIN e USING (rater_a, rater_b)"""


def _kappa(spark, root, col):
    pairs = L.rater_pairs(_five(spark, root), "doc_id", col)
    out = L.cohen_kappa(pairs, ["rater_a", "rater_b"])
    return out.withColumn("agreement", F.round("agreement", 6)).withColumn("kappa", F.round("kappa", 6))


@query("cohen_kappa_five_a1", _kappa_sql("five"))
def cohen_kappa_five(spark, root):
    return _kappa(spark, root, "five")


@query("cohen_kappa_two_a1", _kappa_sql("verdict"))
def cohen_kappa_two(spark, root):
    return _kappa(spark, root, "verdict")


@query("fleiss_kappa_a2", f"""WITH {_FIVE_SQL}, c AS (SELECT doc_id, five, count(*) AS c FROM v5 GROUP BY 1, 2), i AS (SELECT doc_id, sum(c) AS m, sum(c * c) AS sq FROM c GROUP BY 1),
p AS (SELECT avg((sq - 3) / 6) AS p, count(*) AS n FROM i WHERE m = 3), e AS (SELECT sum(t * t) / (sum(t) * sum(t)) AS e FROM (SELECT five, sum(c) AS t FROM c JOIN i USING (doc_id) WHERE m = 3 GROUP BY 1))
SELECT n::BIGINT AS n_used, (SELECT count(*) FROM i)::BIGINT AS n_total, round((p - e) / (1 - e), 6) AS kappa FROM p, e""")
def fleiss_kappa(spark, root):
    return L.fleiss_kappa(_five(spark, root), "doc_id", "five", 3).withColumn("kappa", F.round("kappa", 6))


@query("krippendorff_alpha_a3", f"""WITH {_FIVE_SQL}, i AS (SELECT doc_id, count(*) AS m FROM v5 GROUP BY 1 HAVING count(*) >= 2),
u AS (SELECT a.five AS c, b.five AS k, 1 / (m - 1) AS w FROM v5 a JOIN v5 b ON a.doc_id = b.doc_id AND a.rater <> b.rater JOIN i ON i.doc_id = a.doc_id),
o AS (SELECT sum(w) AS n, sum(CASE WHEN c <> k THEN w ELSE 0 END) AS d FROM u), t AS (SELECT c, sum(w) AS t FROM u GROUP BY 1)
SELECT round(any_value(n), 0)::BIGINT AS n_ratings, round(1 - any_value(d) / ((any_value(n) * any_value(n) - sum(t * t)) / (any_value(n) - 1)), 6) AS alpha FROM o, t""")
def krippendorff_alpha(spark, root):
    return L.krippendorff_alpha(_five(spark, root), "doc_id", "five").withColumn("alpha", F.round("alpha", 6))


@query("class_report_a4", """WITH c AS (SELECT quality::VARCHAR AS t, toxic::VARCHAR AS g, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT t AS label FROM c UNION SELECT g FROM c),
s AS (SELECT label, coalesce((SELECT sum(n) FROM c WHERE t = label), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE g = label), 0) AS guessed, coalesce((SELECT sum(n) FROM c WHERE t = label AND g = label), 0) AS hits FROM k)
SELECT label, round(coalesce(hits / nullif(guessed, 0), 0), 6)::DOUBLE AS precision, round(coalesce(hits / nullif(support, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * hits / nullif(guessed + support, 0), 0), 6)::DOUBLE AS f1, support::BIGINT AS support FROM s""")
def class_report(spark, root):
    lab = table(spark, root, "labels").select(C("quality").cast("string").alias("t"), C("toxic").cast("string").alias("g"))
    out = L.class_report(L.confusion(lab, "t", "g"), "t", "g")
    return out.select("label", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"), "support")


@query("confusion_a4", "SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*)::BIGINT AS n FROM labels GROUP BY 1, 2")
def confusion(spark, root):
    lab = table(spark, root, "labels").select(C("quality").cast("bigint").alias("quality"), C("toxic").cast("bigint").alias("toxic"))
    return L.confusion(lab, "quality", "toxic")
