"""Scores (U) and de-duplication (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as S
from ..functions import stem as M
from ..functions import text as T
from ..operators import dedupe as D
from ..operators import score as U
from ..operators import vectors as V
from ..operators.ordered import day_bucket
from ..sources.durable import written
from ..sources.tables import spread, table
from .match_queries import NEAR_SQL, nearest
from .registry import query
from .stand_ins import DOCUMENT_VECTORS_SQL, document_vectors, documents
from .window_queries import big, user_events

C = F.col


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("logit_support_u1", """WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount * 20 AS e, l_tax * 20 AS n, l_quantity / 10 AS c FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(1 / (1 + exp(c - e)), 6) AS support, round(1 / (1 + exp(n - e) + exp(c - e)), 6) AS entail,
 CASE WHEN e >= n AND e >= c THEN 'entailment' WHEN n >= c THEN 'neutral' ELSE 'contradiction' END AS label FROM l""")
def logit_support(spark, root):
    li = table(spark, root, "lineitem")
    e, n, c = C("l_discount") * 20, C("l_tax") * 20, C("l_quantity") / 10
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r6(U.two_way_support(e, c), "support"),
                     r6(U.three_way_entail(e, n, c), "entail"), U.argmax_label(e, n, c).alias("label"))


@query("vote_uncertainty_u3", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, event_type, round(1 - coalesce(avg(CASE WHEN value >= 5 THEN (value > 50)::INT END), 0.5), 6) AS uncertainty,
 count(CASE WHEN value >= 5 THEN 1 END)::BIGINT AS n_votes FROM p WHERE rn <= 9 GROUP BY 1, 2""")
def vote_uncertainty(spark, root):
    ev = user_events(spark, root, "event_type", "value").withColumn("vote", F.when(C("value") >= 5, (C("value") > 50).cast("int")))
    scored = U.first_notes(ev, ["user_id", "event_type"], ["ts", "event_id"], 9)
    return U.vote_uncertainty(scored, ["user_id", "event_type"], "vote", 0.5).withColumn("uncertainty", F.round("uncertainty", 6))


@query("self_check_u6", """SELECT user_id, event_type, count(*) FILTER (value >= 50)::BIGINT AS n_yes, count(*) FILTER (NOT coalesce(value >= 50, FALSE))::BIGINT AS n_no,
 round(count(*) FILTER (NOT coalesce(value >= 50, FALSE)) / count(*), 6) AS uncertainty FROM events GROUP BY 1, 2""")
def self_check(spark, root):
    ev = table(spark, root, "events").select("user_id", "event_type", F.when(C("value") >= 5, C("value") >= 50).alias("yes"))
    return U.self_check(ev, ["user_id", "event_type"], "yes").withColumn("uncertainty", F.round("uncertainty", 6))


@query("atom_faithfulness_u7", """WITH a AS (SELECT l_orderkey, avg((l_discount > 0.04)::INT) AS m FROM lineitem GROUP BY 1),
s AS (SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE coalesce(m, (o_totalprice > 200000)::INT) END::DOUBLE AS f FROM orders LEFT JOIN a ON l_orderkey = o_orderkey),
n AS (SELECT o_custkey, avg(f) AS m FROM s GROUP BY 1)
SELECT c_nationkey, round(avg(m), 6) AS mean_faithfulness, round(min(m), 6) AS min_faithfulness, count(*)::BIGINT AS n_notes FROM n JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def atom_faithfulness(spark, root):
    orders = table(spark, root, "orders").select(
        "o_orderkey", "o_custkey", (C("o_orderpriority") == "5-LOW").alias("header"),
        (C("o_totalprice") > 200000).cast("double").alias("support"))
    atoms = table(spark, root, "lineitem").select(C("l_orderkey").alias("o_orderkey"), (C("l_discount") > 0.04).cast("int").alias("ok"))
    sents = U.atom_faithfulness(orders, atoms, "o_orderkey", "header", "support", "ok")
    notes = sents.groupBy("o_custkey").agg(F.avg("faithfulness").alias("m"))
    cust = table(spark, root, "customer").select(C("c_custkey").alias("o_custkey"), "c_nationkey")
    return notes.join(cust, "o_custkey").groupBy("c_nationkey").agg(
        r6(F.avg("m"), "mean_faithfulness"), r6(F.min("m"), "min_faithfulness"), F.count(F.lit(1)).alias("n_notes"))


@query("classify_support_u8", f"""WITH {NEAR_SQL}, a AS (SELECT label, q_id, round(max(cos) FILTER (rank = 1), 4) AS top_cos, bool_or(c_id % 5 = 0) FILTER (rank = 1) AS contra,
 min_by(c_id, rank) FILTER (c_id % 3 = 0) AS ent, max(c_id) FILTER (rank = 1) AS top_id FROM near GROUP BY 1, 2)
SELECT label, q_id, top_cos, (top_cos >= 0.95 OR (top_cos >= 0.3 AND ent IS NOT NULL))::BIGINT AS supported,
 CASE WHEN top_cos >= 0.95 OR (top_cos >= 0.3 AND ent IS NOT NULL) THEN '' WHEN top_cos >= 0.93 AND contra THEN 'negation' ELSE 'fabrication' END AS error_type,
 CASE WHEN top_cos >= 0.3 AND top_cos < 0.95 AND ent IS NOT NULL THEN ent ELSE top_id END AS match_id FROM a""")
def classify_support(spark, root):
    ranked = nearest(spark, root, 5).withColumn("entailed", C("c_id") % 3 == 0).withColumn("contra", C("c_id") % 5 == 0)
    return U.classify_support(ranked, ["label", "q_id"], "entailed", "contra")


EDGE_SQL = """ed AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
 WHERE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) >= {t})"""
CLOSURE_SQL = """und AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), cl AS (SELECT a, b FROM und UNION SELECT cl.a, und.b FROM cl JOIN und ON cl.b = und.a),
mn AS (SELECT a AS id, least(a, min(b)) AS component FROM cl GROUP BY a)"""


def vector_components(spark, root, threshold):
    vec = table(spark, root, "embeddings")
    firsts = V.first_copies(vec, "label", "vec_id", "embedding")
    near = V.similar_pairs(firsts, "label", "vec_id", "embedding", threshold).select(C("q_id").alias("first"), C("c_id").alias("copy"))
    edges = near.unionByName(V.copy_edges(vec, firsts, "label", "vec_id", "embedding"))
    return vec, D.all_components(vec, edges, "vec_id", "first", "copy")


_BE = "CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE -({p}) * ln({p}) - (1 - ({p})) * ln(1 - ({p})) END"


@query("semantic_entropy_u9", f"""WITH RECURSIVE {EDGE_SQL.format(t=0.25)}, {CLOSURE_SQL},
m AS (SELECT label, vec_id % 10 AS gen, coalesce(component, vec_id) AS component FROM embeddings LEFT JOIN mn ON id = vec_id),
pc AS (SELECT label, component, count(DISTINCT gen) / 10 AS p FROM m GROUP BY 1, 2), hv AS (SELECT label, 10 - count(DISTINCT gen) AS absent FROM m GROUP BY 1)
SELECT label, (count(*) + any_value(absent))::BIGINT AS n_clusters,
 round((sum({_BE.format(p='p')}) + any_value(absent) * ({_BE.format(p='0.1::DOUBLE')})) / (count(*) + any_value(absent)), 6) AS entropy FROM pc JOIN hv USING (label) GROUP BY 1""")
def semantic_entropy(spark, root):
    vec, comp = vector_components(spark, root, 0.25)
    claims = vec.select("vec_id", "label", (C("vec_id") % 10).alias("gen"))
    out = U.semantic_entropy(claims, comp, [], "label", "gen", "vec_id", 10)
    return out.withColumn("entropy", F.round("entropy", 6))


@query("position_entropy_u10", """WITH c AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS hour, event_type, count(*) AS n FROM events WHERE value >= 5 GROUP BY 1, 2)
SELECT hour, round(CASE WHEN sum(n) < 2 THEN 0 ELSE ln(sum(n)) - sum(n * ln(n)) / sum(n) END, 6)::DOUBLE AS entropy, sum(n)::BIGINT AS total FROM c GROUP BY 1""")
def position_entropy(spark, root):
    ev = table(spark, root, "events").select(
        F.floor(F.unix_seconds(C("ts").cast("timestamp")) / 3600).alias("hour"), F.when(C("value") >= 5, C("event_type")).alias("kind"))
    return U.position_entropy(ev, ["hour"], "kind").select("hour", r6("entropy", "entropy"), "total")


@query("summarise_uncertainty_u11", """WITH n AS (SELECT user_id, event_type, avg(least(value / 100, 1)) AS m, max(least(value / 100, 1)) AS hi, count(*) AS n, count(*) FILTER (value > 50) AS big FROM events GROUP BY 1, 2)
SELECT user_id, round(avg(m), 6) AS mean_u, round(max(hi), 6) AS max_u, round(sum(big) / sum(n), 6) AS high_share, count(*)::BIGINT AS n_notes, sum(n)::BIGINT AS n_rows FROM n GROUP BY 1""")
def summarise_uncertainty(spark, root):
    u = F.least(C("value") / 100, F.lit(1.0))
    notes = table(spark, root, "events").groupBy("user_id", "event_type").agg(
        F.avg(u).alias("m"), F.max(u).alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(C("value") > 50).alias("big"))
    return notes.groupBy("user_id").agg(r6(F.avg("m"), "mean_u"), r6(F.max("hi"), "max_u"), r6(F.sum("big") / F.sum("n"), "high_share"),
                                        F.count(F.lit(1)).alias("n_notes"), F.sum("n").alias("n_rows"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def absent_claims(claims, sample, gen, kind, kinds):
    """Claim types a generation lacks, with how many others have them."""
    have = claims.groupBy(sample, gen, kind).agg(F.count(F.lit(1)).alias("n_values"))
    gens = have.select(sample, gen).distinct()
    grid = gens.select(sample, gen, F.explode(F.array(*[F.lit(k) for k in kinds])).alias(kind))
    elsewhere = have.groupBy(sample, kind).agg(F.count(F.lit(1)).alias("n_elsewhere"), F.sum("n_values").alias("n_values"))
    return grid.join(have, [sample, gen, kind], "left_anti").join(elsewhere, [sample, kind])


@query("absent_claims_u12", """WITH h AS (SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT user_id, day FROM h), k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type),
e AS (SELECT user_id, event_type, count(*) AS c, sum(n) AS v FROM h GROUP BY 1, 2)
SELECT user_id, day, event_type, c::BIGINT AS n_elsewhere, v::BIGINT AS n_values FROM g CROSS JOIN k ANTI JOIN h USING (user_id, day, event_type) JOIN e USING (user_id, event_type)""")
def absent(spark, root):
    ev = table(spark, root, "events").select("user_id", day_bucket(C("ts")).alias("day"), "event_type")
    return absent_claims(ev, "user_id", "day", "event_type", _TYPES)


@query("mass_entropy_u13", """WITH m AS (SELECT user_id, event_type, sum(value::DECIMAL(18, 2))::DOUBLE AS n FROM events GROUP BY 1, 2)
SELECT user_id, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(5), 6) AS entropy FROM m WHERE n > 0 GROUP BY 1""")
def mass_entropy(spark, root):
    mass = table(spark, root, "events").groupBy("user_id", "event_type").agg(F.sum(C("value").cast("decimal(18,2)")).cast("double").alias("n"))
    return U.share_entropy(mass, ["user_id"], "n", 5).select("user_id", r6("entropy", "entropy"))


@query("js_divergence_u14", """WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value < 60 GROUP BY 1, 2), g AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS q FROM events GROUP BY 1),
gr AS (SELECT u.user_id, g.event_type, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY u.user_id) + 1e-10 AS x, q + 1e-10 AS y
 FROM (SELECT DISTINCT user_id FROM p) u CROSS JOIN g LEFT JOIN p USING (user_id, event_type))
SELECT user_id, round(greatest(0, least(1, 0.5 * sum(x * ln(x / ((x + y) / 2)) + y * ln(y / ((x + y) / 2))))), 6) AS js FROM gr GROUP BY 1""")
def js_divergence(spark, root):
    ev = table(spark, root, "events")
    mine = ev.filter("value < 60").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = ev.agg(F.count(F.lit(1)).alias("t")).withColumn("one", F.lit(1))
    shares = kinds.withColumn("one", F.lit(1)).join(total, "one").select("event_type", (C("n") / C("t")).alias("share"))
    return U.js_divergence(mine, shares, ["user_id"], "event_type", "n", "share").withColumn("js", F.round("js", 6))


@query("centroid_cosine_u15", """WITH t AS (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY abs(embedding[1]::DOUBLE) DESC, vec_id) <= 5),
d AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM t) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c FROM d GROUP BY 1)
SELECT e.label, vec_id, round(list_dot_product(embedding::DOUBLE[], c) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(c, c)), 6) AS cosine FROM embeddings e JOIN c USING (label)""")
def centroid_cosine(spark, root):
    vec = table(spark, root, "embeddings")
    out = U.centroid_cosine(vec, "label", "vec_id", "embedding", F.abs(F.get("embedding", F.lit(0)).cast("double")), 5)
    return out.select("label", "vec_id", r6("cosine", "cosine"))


@query("context_ratio_u16", """WITH p AS (SELECT event_id, user_id, ts, event_type IN ('click', 'view') AS ctx, value FROM events),
s AS (SELECT event_id, coalesce(avg(CASE WHEN ctx THEN value END) OVER w, 0) AS c, coalesce(avg(CASE WHEN NOT ctx THEN value END) OVER w, 0) AS n,
 count(CASE WHEN NOT ctx THEN 1 END) OVER w AS k FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, round(CASE WHEN k = 0 THEN 1 ELSE c / nullif(c + n, 0) END, 6)::DOUBLE AS ratio FROM s""")
def context_ratio(spark, root):
    ev = user_events(spark, root, "event_type", "value")
    out = U.context_ratio(ev, ["user_id"], ["ts", "event_id"], C("event_type").isin("click", "view"),
                          C("value").cast("decimal(18,2)"))
    return out.select("event_id", r6("ratio", "ratio"))


@query("quadrants_u17", """WITH m AS (SELECT l_returnflag, quantile_cont(l_discount, 0.5) AS a, quantile_cont(l_tax, 0.5) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, CASE WHEN l_discount >= a AND l_tax < b THEN 'extractive' WHEN l_discount < a AND l_tax >= b THEN 'parametric' WHEN l_discount >= a THEN 'synthesized' ELSE 'hallucinatory' END AS quadrant,
 count(*)::BIGINT AS n, round(avg(greatest(0, least(1, 1 - (l_discount * 10 + l_tax * 10) / 2))), 6) AS mean_risk, count(*) FILTER (l_linestatus = 'O')::BIGINT AS n_injected FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1, 2""")
def quadrants(spark, root):
    li = table(spark, root, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax")
    return U.quadrants(li, ["l_returnflag"], "l_discount", "l_tax").groupBy("l_returnflag", "quadrant").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(U.risk(C("l_discount") * 10, C("l_tax") * 10)), "mean_risk"),
        F.count_if(C("l_linestatus") == "O").alias("n_injected"))


@query("overlap_metrics_u18", f"""WITH p AS (SELECT a.conv_id, a.turn, {S.words('lower(b.text)')} AS h, {S.words('lower(a.text)')} AS r,
 regexp_extract_all(lower(b.text), '[a-z0-9]+') AS ht, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS rt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
k AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(h), lambda w: least(len(list_filter(h, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))), 0) AS hits,
 {S.lcs('ht', 'rt')} AS n FROM p)
SELECT conv_id, turn, round(CASE WHEN len(h) = 0 THEN 0 ELSE CASE WHEN len(h) > len(r) THEN 1 ELSE exp(1 - len(r) / len(h)) END * hits / len(h) END, 6)::DOUBLE AS bleu1,
 round(CASE WHEN n > 0 THEN 2.0::DOUBLE * n / (len(ht) + len(rt)) ELSE 0 END, 6)::DOUBLE AS rouge_l FROM k""")
def overlap_metrics(spark, root):
    conv = table(spark, root, "conversations").select("conv_id", "turn", C("text").alias("ref"))
    hyp = table(spark, root, "conversations").select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("hyp"))
    pairs = spread(conv).join(hyp, ["conv_id", "turn"])

    def tok(c):
        return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)

    return pairs.select("conv_id", "turn", r6(U.bleu1(T.words(F.lower("hyp")), T.words(F.lower("ref"))), "bleu1"),
                        r6(U.rouge_l(tok("hyp"), tok("ref")), "rouge_l"))


ROUGE_TOKENS = "list_transform(list_zip({0}, {1}), lambda p: CASE WHEN length(p[1]) > 3 THEN p[2] ELSE p[1] END)"


def rouge_tokens_sql(text):
    tokens = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    return ROUGE_TOKENS.format(tokens, M.stems_sql(tokens))


@query("stemmed_overlap_u18", f"""WITH p AS (SELECT a.conv_id, a.turn, {S.words('lower(b.text)')} AS h, {S.words('lower(a.text)')} AS r,
 {rouge_tokens_sql('b.text')} AS ht, {rouge_tokens_sql('a.text')} AS rt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w AS (SELECT conv_id, turn, 0 AS side, unnest(range(len(h))) AS i, unnest(h) AS w, unnest({M.stems_sql('h')}) AS s FROM p
 UNION ALL SELECT conv_id, turn, 1, unnest(range(len(r))), unnest(r), unnest({M.stems_sql('r')}) FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, side, w ORDER BY i DESC) AS k FROM w),
e AS (SELECT a.conv_id, a.turn, a.i, b.i AS j FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.side = 0 AND b.side = 1 AND a.w = b.w AND a.k = b.k),
o AS (SELECT conv_id, turn, side, i, s, row_number() OVER (PARTITION BY conv_id, turn, side, s ORDER BY i DESC) AS k FROM w WHERE NOT EXISTS (
 SELECT 1 FROM e WHERE e.conv_id = w.conv_id AND e.turn = w.turn AND w.i = CASE w.side WHEN 0 THEN e.i ELSE e.j END)),
m AS (SELECT * FROM e UNION ALL SELECT a.conv_id, a.turn, a.i, b.i FROM o a JOIN o b
 ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.side = 0 AND b.side = 1 AND a.s = b.s AND a.k = b.k),
l AS (SELECT *, lag(i) OVER x AS pi, lag(j) OVER x AS pj FROM m WINDOW x AS (PARTITION BY conv_id, turn ORDER BY i)),
c AS (SELECT conv_id, turn, count(*)::DOUBLE AS n, count(*) FILTER (pi IS NULL OR i <> pi + 1 OR j <> pj + 1) AS runs FROM l GROUP BY ALL),
k AS (SELECT *, {S.lcs('ht', 'rt')} AS n FROM p)
SELECT k.conv_id, k.turn, round(CASE WHEN k.n > 0 THEN 2.0::DOUBLE * k.n / (len(ht) + len(rt)) ELSE 0 END, 6)::DOUBLE AS rouge_l,
 round(coalesce((1 - 0.5::DOUBLE * pow(c.runs / c.n, 3)) * ((c.n / len(h)) * (c.n / len(r)) / (0.9::DOUBLE * (c.n / len(h)) + (1 - 0.9::DOUBLE) * (c.n / len(r)))), 0), 6) AS meteor
FROM k LEFT JOIN c ON c.conv_id = k.conv_id AND c.turn = k.turn""")
def stemmed_overlap(spark, root):
    conv = table(spark, root, "conversations").select("conv_id", "turn", C("text").alias("ref"))
    hyp = table(spark, root, "conversations").select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("hyp"))
    return spread(conv).join(hyp, ["conv_id", "turn"]).select(
        "conv_id", "turn", r6(U.rouge_l(M.rouge_tokens(C("hyp")), M.rouge_tokens(C("ref"))), "rouge_l"),
        r6(M.meteor(T.words(F.lower("hyp")), T.words(F.lower("ref"))), "meteor"))


@query("most_uncertain_u19", """SELECT user_id, round(avg(value), 6) AS mean_u FROM events GROUP BY 1 ORDER BY avg(value::DECIMAL(18, 2)) DESC, user_id LIMIT 10""")
def most_uncertain(spark, root):
    means = table(spark, root, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    return means.orderBy(F.desc(F.round("m", 9)), "user_id").limit(10).select("user_id", r6("m", "mean_u"))


_BANDS = {"early": (1, 2), "mid": (3, 5), "late": (6, 7)}


@query("band_features_u20", "SELECT l_suppkey, " + ", ".join(
    f"round(avg(abs(l_discount - l_tax)) FILTER (l_linenumber BETWEEN {a} AND {b}), 6) AS {n}_abs, round(avg(greatest(l_discount - l_tax, 0)) FILTER (l_linenumber BETWEEN {a} AND {b}), 6) AS {n}_pos"
    for n, (a, b) in _BANDS.items()) + " FROM lineitem GROUP BY 1")
def band_features(spark, root):
    out = U.band_features(table(spark, root, "lineitem"), ["l_suppkey"], C("l_linenumber"), C("l_discount") - C("l_tax"), _BANDS)
    return out.select("l_suppkey", *[r6(c, c) for c in out.columns[1:]])


@query("top_components_u20", """SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(l_extendedprice) DESC, l_orderkey, l_linenumber, l_partkey) AS rank
FROM lineitem QUALIFY rank <= 3""")
def top_components(spark, root):
    li = table(spark, root, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return U.top_components(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "l_extendedprice", 3)


@query("dedupe_first_d1", "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first(spark, root):
    return D.dedupe_first(table(spark, root, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query("dedupe_facts_d2", f"""WITH l AS (SELECT doc_id, (i - 1)::BIGINT AS idx, {S.strip('l[i]')} AS fact FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
SELECT doc_id, idx, fact FROM l WHERE fact <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, fact ORDER BY idx % 4, idx) = 1""")
def dedupe_facts(spark, root):
    lines = documents(spark, root).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s")) \
        .select("doc_id", big("i").alias("idx"), T.strip(C("s")).alias("fact")).filter("fact <> ''").withColumn("sec", C("idx") % 4)
    return D.dedupe_first(lines, ["doc_id", "fact"], ["sec", "idx"]).select("doc_id", "idx", "fact")


@query("dedupe_greedy_d3", f"""WITH RECURSIVE {EDGE_SQL.format(t=0.25)}, adj AS (SELECT vec_id, coalesce((SELECT list(a) FROM ed WHERE b = vec_id), []) AS prev FROM embeddings),
o AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM adj),
w AS (SELECT 1 AS rn, [vec_id] AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.rn, CASE WHEN list_has_any(kept, prev) THEN kept ELSE list_append(kept, vec_id) END FROM w JOIN o ON o.rn = w.rn + 1)
SELECT unnest(kept) AS vec_id FROM w WHERE rn = (SELECT count(*) FROM embeddings)""")
def dedupe_greedy(spark, root):
    return V.first_come(table(spark, root, "embeddings"), "label", "vec_id", "embedding", 0.25)


@query("similar_documents_p13", f"WITH {DOCUMENT_VECTORS_SQL} SELECT lang, a AS q_id, b AS c_id, round(cos, 6) AS cos FROM dc WHERE cos >= 0.92")
def similar_documents(spark, root):
    """Pairs of texts of one language whose vectors reach 0.92, by blocked products."""
    pairs = V.similar_pairs(written(document_vectors(spark, root)), "lang", "doc_id", "v", 0.92)
    return pairs.select("lang", "q_id", "c_id", F.round("cos", 6).alias("cos"))


@query("nearest_documents_p13", f"""WITH {DOCUMENT_VECTORS_SQL}, bo AS (SELECT lang, a AS q, b AS c, cos FROM dc UNION ALL SELECT lang, b, a, cos FROM dc)
SELECT lang, q AS q_id, c AS c_id, round(cos, 6) AS cos, row_number() OVER (PARTITION BY q ORDER BY cos DESC, c)::BIGINT AS rank FROM bo
WHERE q % 4 = 0 AND c % 4 <> 0 QUALIFY rank <= 3""")
def nearest_documents(spark, root):
    """The three nearest of the other texts of its language for every fourth text."""
    vectors = written(document_vectors(spark, root))
    near = V.top_k_cosine(vectors.filter("doc_id % 4 = 0"), vectors.filter("doc_id % 4 <> 0"), "lang", "doc_id", "doc_id", "v", 3)
    return near.withColumn("cos", F.round("cos", 6))


@query("dedupe_documents_d3", f"""WITH RECURSIVE {DOCUMENT_VECTORS_SQL}, ed AS (SELECT a, b FROM dc WHERE cos >= 0.92),
o AS (SELECT doc_id, coalesce((SELECT list(a) FROM ed WHERE b = doc_id), []) AS prev, row_number() OVER (ORDER BY doc_id) AS rn FROM dn),
w AS (SELECT 1 AS rn, [doc_id] AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.rn, CASE WHEN list_has_any(kept, prev) THEN kept ELSE list_append(kept, doc_id) END FROM w JOIN o ON o.rn = w.rn + 1)
SELECT unnest(kept) AS doc_id FROM w WHERE rn = (SELECT count(*) FROM dn)""")
def dedupe_documents(spark, root):
    """First-come pass over the texts of a language at 0.92."""
    return V.first_come(written(document_vectors(spark, root)), "lang", "doc_id", "v", 0.92)


@query("document_entropy_u9", f"""WITH RECURSIVE {DOCUMENT_VECTORS_SQL}, ed AS (SELECT a, b FROM dc WHERE cos >= 0.9), {CLOSURE_SQL},
m AS (SELECT lang, doc_id % 10 AS gen, coalesce(component, doc_id) AS component FROM dn LEFT JOIN mn ON id = doc_id),
pc AS (SELECT lang, component, count(DISTINCT gen) / 10 AS p FROM m GROUP BY 1, 2), hv AS (SELECT lang, 10 - count(DISTINCT gen) AS absent FROM m GROUP BY 1)
SELECT lang, (count(*) + any_value(absent))::BIGINT AS n_clusters,
 round((sum({_BE.format(p='p')}) + any_value(absent) * ({_BE.format(p='0.1::DOUBLE')})) / (count(*) + any_value(absent)), 6) AS entropy FROM pc JOIN hv USING (lang) GROUP BY 1""")
def document_entropy(spark, root):
    """Entropy of the presence of clusters at 0.90 in ten generations, by language."""
    vectors = written(document_vectors(spark, root))
    firsts = written(V.first_copies(vectors, "lang", "doc_id", "v"))
    near = V.similar_pairs(firsts, "lang", "doc_id", "v", 0.9).select(C("q_id").alias("first"), C("c_id").alias("copy"))
    comp = D.all_components(vectors, near.unionByName(V.copy_edges(vectors, firsts, "lang", "doc_id", "v")), "doc_id", "first", "copy")
    claims = vectors.select("doc_id", "lang", (C("doc_id") % 10).alias("gen"))
    return U.semantic_entropy(claims, comp, [], "lang", "gen", "doc_id", 10).withColumn("entropy", F.round("entropy", 6))


def _spans():
    """Overlapping spans laid over each text, with a score."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 60).cast("int")), lambda k: F.struct(
        (k * 60 + (k * 7) % 23).alias("start"), (k * 60 + (k * 7) % 23 + 20 + (k * 53 + C("doc_id").cast("int")) % 90).alias("end"),
        k.alias("id"), (((k * 31 + C("doc_id").cast("int")) % 17) / 10).alias("score")))


_SPANS_SQL = """sp AS (SELECT doc_id, k AS id, k * 60 + (k * 7) % 23 AS st, k * 60 + (k * 7) % 23 + 20 + (k * 53 + doc_id) % 90 AS en, ((k * 31 + doc_id) % 17) / 10 AS score
 FROM (SELECT doc_id, unnest(range(0, length(text) // 60 + 1)) AS k FROM documents))"""


@query("longest_first_d4", f"""WITH RECURSIVE {_SPANS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st - en, id) AS rn FROM sp),
w AS (SELECT doc_id, rn, [{{'s': st, 'e': en}}] AS kept, TRUE AS ok FROM o WHERE rn = 1
 UNION ALL SELECT o.doc_id, o.rn, CASE WHEN len(list_filter(kept, lambda p: o.st < p.e AND o.en > p.s)) > 0 THEN kept ELSE list_append(kept, {{'s': st, 'e': en}}) END,
  len(list_filter(kept, lambda p: o.st < p.e AND o.en > p.s)) = 0 FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
SELECT o.doc_id, o.id, st::BIGINT AS start_at, en::BIGINT AS end_at FROM o JOIN w USING (doc_id, rn) WHERE ok""")
def longest_first(spark, root):
    placed = documents(spark, root).select("doc_id", F.inline(D.longest_first(_spans())))
    return placed.select("doc_id", big("id").alias("id"), big("start").alias("start_at"), big("end").alias("end_at"))


@query("higher_score_d6", f"""WITH RECURSIVE {_SPANS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, score DESC, id) AS rn FROM sp),
w AS (SELECT doc_id, rn, id, en, score, NULL::BIGINT AS done FROM o WHERE rn = 1
 UNION ALL SELECT o.doc_id, o.rn, CASE WHEN o.st >= w.en OR o.score > w.score THEN o.id ELSE w.id END, CASE WHEN o.st >= w.en OR o.score > w.score THEN o.en ELSE w.en END,
  CASE WHEN o.st >= w.en OR o.score > w.score THEN o.score ELSE w.score END, CASE WHEN o.st >= w.en THEN w.id END FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
SELECT doc_id, done::BIGINT AS id FROM w WHERE done IS NOT NULL UNION ALL SELECT doc_id, max_by(id, rn)::BIGINT FROM w GROUP BY 1""")
def higher_score(spark, root):
    return documents(spark, root).select("doc_id", F.inline(D.higher_score(_spans()))).select("doc_id", big("id").alias("id"))


_DOC_EDGES = f"""k AS (SELECT doc_id, 'a' || md5({S.norm('text')}) AS k FROM documents UNION ALL SELECT doc_id, 'b' || {S.norm('string_split(text, chr(10))[1]')} FROM documents
 UNION ALL SELECT doc_id, 'c' || {S.norm('string_split(text, chr(10))[-1]')} FROM documents),
ed AS (SELECT DISTINCT first AS a, doc_id AS b FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first FROM k) WHERE first < doc_id)"""


@query("components_d5", f"""WITH RECURSIVE {_DOC_EDGES}, {CLOSURE_SQL} SELECT doc_id, coalesce(component, doc_id) AS component FROM documents LEFT JOIN mn ON id = doc_id""")
def components(spark, root):
    """Documents sharing the text, the first or the last line.

    A group of copies is a star around its first document, never all pairs.
    """
    docs = documents(spark, root)
    lines = F.split("text", "\n")
    keyed = docs.select("doc_id", F.explode(F.array(
        F.concat(F.lit("a"), F.md5(T.normalise(C("text")))), F.concat(F.lit("b"), T.normalise(F.get(lines, F.lit(0)))),
        F.concat(F.lit("c"), T.normalise(F.element_at(lines, -1))))).alias("k"))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("first"))
    edges = keyed.join(first, "k").filter("first < doc_id").select("first", "doc_id")
    return D.all_components(docs, edges, "doc_id", "first", "doc_id")
