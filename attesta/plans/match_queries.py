"""Locating spans, joins and alignment (P), support scores on top (U2, U4, U5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import sql as S
from ..functions import text as T
from ..functions import windows as W
from ..operators import match as M
from ..operators import pools as P
from ..operators import vectors as V
from ..sources.tables import spread, table
from .registry import query
from .stand_ins import document_sentences, documents, turn_sentences
from .text_queries import _NAMES
from .window_queries import POS_SQL, big, user_events

C = F.col
SENT = S.sentence_rows('documents', 'doc_id', 'text')


def _pattern(e):
    return ("regexp_replace(regexp_replace(" + S.strip(e) + ", '([\\\\.^$|?*+()\\[\\]{}])', '\\\\\\1', 'g'), '\\s+', '\\\\s+', 'g')")


@query("find_span_p1", f"""WITH {SENT},
sp AS (SELECT sent.doc_id, idx, text, CASE WHEN idx % 2 = 0 THEN replace(s, ' ', '  ') ELSE lower(s) END AS span FROM sent JOIN documents USING (doc_id)),
m AS (SELECT *, regexp_extract(text, {_pattern('span')}) AS e, regexp_extract(text, '(?i)' || {_pattern('span')}) AS f FROM sp)
SELECT doc_id, idx, (strpos(text, CASE WHEN e <> '' THEN e ELSE f END) - 1)::BIGINT AS start_at,
 (strpos(text, CASE WHEN e <> '' THEN e ELSE f END) - 1 + length(CASE WHEN e <> '' THEN e ELSE f END))::BIGINT AS end_at FROM m WHERE e <> '' OR f <> ''""")
def find_span(spark, root):
    spans = F.transform(T.sentences(C("text")), lambda s, i: F.when(
        i % 2 == 0, F.replace(s, F.lit(" "), F.lit("  "))).otherwise(F.lower(s)))
    docs = documents(spark, root).withColumn("spans", spans)
    return docs.select("doc_id", F.posexplode(T.find_spans(C("text"), C("spans"))).alias("i", "r")).filter(C("r").isNotNull()) \
        .select("doc_id", big("i").alias("idx"), big("r.start").alias("start_at"), big("r.end").alias("end_at"))


_RUN = f"""t AS (SELECT *, regexp_extract_all(s, '[a-zA-Z0-9'']+') AS h, regexp_split_to_array(s, '[a-zA-Z0-9'']+') AS g FROM miss),
e AS (SELECT doc_id, idx, s, q, i, h[i] AS w, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0))::BIGINT AS st
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM t)),
k AS (SELECT *, st + length(w) AS en FROM e WHERE list_contains(q, lower(w))),
l AS (SELECT *, lag(i) OVER o AS pi, lag(en) OVER o AS pe FROM k WINDOW o AS (PARTITION BY doc_id, idx ORDER BY i)),
r AS (SELECT *, sum((pi IS NULL OR i - pi > 3 OR regexp_matches(substr(s, pe + 1, st - pe), '[;.:]'))::INT) OVER (PARTITION BY doc_id, idx ORDER BY i) AS run FROM l),
a AS (SELECT doc_id, idx, run, min(st) AS st, max(en) AS en, count(*) AS n, any_value(len(q)) AS nq FROM r GROUP BY 1, 2, 3),
best AS (SELECT doc_id, idx, st, en FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY n DESC, st) = 1 AND n >= least(2, nq))"""


@query("locate_tiers_p2", f"""WITH {SENT},
sp AS (SELECT doc_id, idx, s, CASE idx % 3 WHEN 0 THEN lower(substr(s, 3)) WHEN 1 THEN array_to_string(list_reverse({S.words('s')}), ' ')
  ELSE 'zq ' || s || ' qz' END AS span FROM sent),
x AS (SELECT *, strpos(lower({S.norm('s')}), {S.norm('span')}) > 0 AND {S.strip('span')} <> '' AS hit,
  regexp_extract(s, {_pattern('span')}) AS m1, regexp_extract(s, '(?i)' || {_pattern('span')}) AS m2 FROM sp),
ex AS (SELECT *, CASE WHEN m1 <> '' THEN m1 ELSE m2 END AS m FROM x),
miss AS (SELECT doc_id, idx, s, list_distinct({S.content_words('span')}) AS q FROM ex WHERE m = ''), {_RUN}
SELECT ex.doc_id, ex.idx, CASE WHEN m <> '' THEN strpos(s, m) - 1 ELSE st END::BIGINT AS start_at,
 CASE WHEN m <> '' THEN strpos(s, m) - 1 + length(m) ELSE en END::BIGINT AS end_at,
 CASE WHEN m <> '' THEN 'exact' WHEN st IS NOT NULL THEN 'word' ELSE 'unmatched' END AS method FROM ex LEFT JOIN best USING (doc_id, idx)""")
def locate_tiers(spark, root):
    span = (F.when(C("idx") % 3 == 0, F.lower(F.substr(C("s"), F.lit(3))))
            .when(C("idx") % 3 == 1, F.array_join(F.reverse(T.words(C("s"))), " "))
            .otherwise(F.concat(F.lit("zq "), "s", F.lit(" qz"))))
    rows = document_sentences(spark, root).withColumn("span", span)
    return M.locate_tiers(rows, "s", "span").select("doc_id", "idx", big("start").alias("start_at"), big("end").alias("end_at"), "method")


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9)"


def nearest(spark, root, k):
    """Even vectors as queries, odd ones as candidates, label as block."""
    vec = table(spark, root, "embeddings")
    return V.top_k_cosine(vec.filter("vec_id % 2 = 0"), vec.filter("vec_id % 2 = 1"), "label", "vec_id", "vec_id", "embedding", k)


NEAR_SQL = f"""near AS (SELECT a.label, a.vec_id AS q_id, b.vec_id AS c_id, {_COS} AS cos,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 QUALIFY rank <= 5)"""


@query("semantic_tier_p2", f"""WITH {NEAR_SQL} SELECT label, q_id, c_id, round(cos, 6) AS cos FROM near WHERE rank = 1 AND cos >= 0.3
 AND label IN (SELECT label FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1 HAVING count(*) > 1)""")
def semantic_tier(spark, root):
    clauses = table(spark, root, "embeddings").filter("vec_id % 2 = 1").select("label")
    return M.semantic_tier(nearest(spark, root, 1), clauses, "label", 0.3).select("label", "q_id", "c_id", F.round("cos", 6).alias("cos"))


def _bag(c):
    return F.array_distinct(T.word_tokens(c))


def claim_rows(spark, root):
    """Claims of every turn: section 'list' when the sentence has a comma."""
    sents = turn_sentences(spark, root)
    section = F.when(F.contains("s", F.lit(",")), "list").otherwise("plain")
    return sents.select("conv_id", "turn", "idx", section.alias("section"), F.posexplode(T.subclaims(C("s"))).alias("p", "claim")) \
        .select("conv_id", "turn", "idx", big("p").alias("claim_idx"), "section", _bag(C("claim")).alias("words"))


def note_windows(spark, root, whole: bool):
    sents = T.sentences(C("text"))

    def entry(name, keep):
        return T.let(F.filter(sents, keep), lambda x: F.struct(F.lit(name).alias("key"), F.when(F.size(x) > 0, F.transform(
            W.sentence_windows(x), _bag)).alias("value")))

    parts = [entry("list", lambda s: F.contains(s, F.lit(","))), entry("plain", lambda s: ~F.contains(s, F.lit(",")))]
    if whole:
        parts.append(F.struct(F.lit("all").alias("key"), F.transform(W.sentence_windows(sents), _bag).alias("value")))
    return spread(table(spark, root, "conversations")).select("conv_id", "turn", F.map_from_entries(F.filter(
        F.array(*parts), lambda e: e["value"].isNotNull())).alias("sections"))


CLAIMS_SQL = f"""base AS (SELECT conv_id, turn, role, {S.sentences('text')} AS l FROM conversations),
sent AS (SELECT conv_id, turn, role, (i - 1)::BIGINT AS idx, l[i] AS s FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM base)),
cl AS (SELECT conv_id, turn, idx, CASE WHEN contains(s, ',') THEN 'list' ELSE 'plain' END AS section, {S.subclaims('s')} AS cs FROM sent),
claims AS (SELECT conv_id, turn, idx, section, (i - 1)::BIGINT AS claim_idx, list_distinct({S.word_tokens('cs[i]')}) AS w
  FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM cl)),
sec AS (SELECT conv_id, turn, 'list' AS section, list_filter(l, lambda x: contains(x, ',')) AS l FROM base
  UNION ALL SELECT conv_id, turn, 'plain', list_filter(l, lambda x: NOT contains(x, ',')) FROM base),
win AS (SELECT conv_id, turn, section, list_distinct({S.word_tokens("array_to_string(l[i:i + 1], ' ')")}) AS w FROM (
  SELECT *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i FROM (SELECT * FROM sec WHERE len(l) > 0 UNION ALL SELECT conv_id, turn, 'all', l FROM base)))"""
_COV = "coalesce(len(list_intersect(c.w, n.w)) / nullif(len(c.w), 0), 0)"
PAIR_SQL = f"""{CLAIMS_SQL},
has AS (SELECT DISTINCT conv_id, turn, section FROM win),
tgt AS (SELECT c.*, o.turn AS other, CASE WHEN h.section IS NULL THEN 'all' ELSE c.section END AS want FROM claims c
  JOIN base o ON o.conv_id = c.conv_id AND o.turn <> c.turn
  LEFT JOIN has h ON h.conv_id = o.conv_id AND h.turn = o.turn AND h.section = c.section),
best AS (SELECT c.conv_id, c.turn, c.idx, c.claim_idx, c.other, max({_COV}) AS s FROM tgt c
  JOIN win n ON n.conv_id = c.conv_id AND n.turn = c.other AND n.section = c.want GROUP BY ALL),
per_claim AS (SELECT conv_id, turn, idx, claim_idx, sum(s) AS support_sum, count(*) AS n_compared FROM best GROUP BY ALL)"""


def pair_supports(spark, root):
    return P.pair_support(claim_rows(spark, root), note_windows(spark, root, True), "conv_id", "turn", "section")


@query("pair_support_p3", f"WITH {PAIR_SQL} SELECT conv_id, turn, idx, claim_idx, round(support_sum, 6) AS support_sum, n_compared::BIGINT AS n_compared FROM per_claim")
def pair_support(spark, root):
    return pair_supports(spark, root).filter("n_compared > 0") \
        .select("conv_id", "turn", "idx", "claim_idx", F.round("support_sum", 6).alias("support_sum"), "n_compared")


def sentence_uncertainty(sents, supports, sizes, keys, sample):
    """1 minus the mean support of a sentence over the other notes.

    Claims are averaged inside each note first; because every note sees all
    claims, the mean of the per-claim sums is the same number.  A note that had
    nothing to compare with half supports the claim, and a sentence without a
    claim counts as half supported everywhere.
    """
    others = sizes.withColumn("_others", C("_k") - 1).filter("_others > 0")
    half = (C("_others") - C("n_compared")) * 0.5
    per = supports.join(others, sample).groupBy(*keys).agg(F.avg(C("support_sum") + half).alias("_s"))
    return sents.join(others, sample).join(per, keys, "left").withColumn(
        "uncertainty", F.round(1 - F.coalesce(C("_s"), C("_others") * 0.5) / C("_others"), 4)).select(*sents.columns, "uncertainty")


def turn_uncertainty(spark, root):
    sents = turn_sentences(spark, root)
    sizes = table(spark, root, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("_k"))
    return sentence_uncertainty(sents, pair_supports(spark, root), sizes, ["conv_id", "turn", "idx"], "conv_id")


UNCERTAIN_SQL = f"""{PAIR_SQL}, sizes AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY 1 HAVING count(*) > 1),
per_sent AS (SELECT c.conv_id, c.turn, c.idx, avg(coalesce(support_sum, 0) + (k - 1 - coalesce(n_compared, 0)) * 0.5) AS s
  FROM claims c JOIN sizes USING (conv_id) LEFT JOIN per_claim USING (conv_id, turn, idx, claim_idx) GROUP BY ALL),
unc AS (SELECT sent.conv_id, sent.turn, sent.role, sent.idx, sent.s AS sentence, round(1 - coalesce(p.s, (k - 1) * 0.5) / (k - 1), 4) AS uncertainty
  FROM sent JOIN sizes USING (conv_id) LEFT JOIN per_sent p USING (conv_id, turn, idx))"""


@query("sentence_uncertainty_u2", f"WITH {UNCERTAIN_SQL} SELECT conv_id, turn, idx, uncertainty FROM unc")
def uncertainty(spark, root):
    return turn_uncertainty(spark, root).select("conv_id", "turn", "idx", "uncertainty")


FALLBACK_SQL = f"""{CLAIMS_SQL},
sc AS (SELECT c.conv_id, c.turn, c.idx, c.claim_idx, n.turn AS other, max(CASE WHEN n.section = c.section THEN {_COV} END) AS own,
  max(CASE WHEN n.section <> c.section THEN {_COV} END) AS rest FROM claims c JOIN win n ON n.conv_id = c.conv_id AND n.turn <> c.turn
  WHERE n.section <> 'all' GROUP BY ALL),
pt AS (SELECT *, CASE WHEN own >= 0.5 THEN own ELSE greatest(own, rest) END AS s FROM sc),
fb AS (SELECT c.conv_id, c.turn, c.idx, c.claim_idx, sum(s) AS support_sum, count(s) AS n_compared
  FROM claims c LEFT JOIN pt USING (conv_id, turn, idx, claim_idx) GROUP BY ALL)"""


def fallback_supports(spark, root):
    return P.fallback_support(claim_rows(spark, root), note_windows(spark, root, False), "conv_id", "turn", "section", K.SECTION_FALLBACK)


@query("fallback_support_p4", f"WITH {FALLBACK_SQL} SELECT conv_id, turn, idx, claim_idx, round(coalesce(support_sum, 0), 6) AS support_sum, n_compared::BIGINT AS n_compared FROM fb")
def fallback_support(spark, root):
    return fallback_supports(spark, root).select("conv_id", "turn", "idx", "claim_idx", F.round("support_sum", 6).alias("support_sum"), "n_compared")


@query("fact_uncertainty_u4", f"WITH {FALLBACK_SQL} SELECT conv_id, turn, idx, claim_idx, round(coalesce(1 - support_sum / nullif(n_compared, 0), 1.0), 4) AS uncertainty FROM fb")
def fact_uncertainty(spark, root):
    return fallback_supports(spark, root).select("conv_id", "turn", "idx", "claim_idx", F.round(F.coalesce(
        1 - F.try_divide(C("support_sum"), C("n_compared")), F.lit(1.0)), 4).alias("uncertainty"))


_MAXPOOL = f"""base AS (SELECT conv_id, turn, role, {S.sentences('text')} AS l FROM conversations),
sent AS (SELECT conv_id, turn, role, (i - 1)::BIGINT AS idx, list_distinct({S.word_tokens('l[i]')}) AS w FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM base)),
mp AS (SELECT c.conv_id, c.turn, c.idx, max({_COV}) AS support FROM sent c LEFT JOIN sent n ON n.conv_id = c.conv_id AND n.role <> 'assistant'
  WHERE c.role = 'assistant' GROUP BY ALL)"""


def source_supports(spark, root):
    sents = turn_sentences(spark, root).withColumn("words", _bag(C("s"))).drop("s")
    targets = sents.filter("role = 'assistant'").drop("role")
    sources = sents.filter("role <> 'assistant'").select("conv_id", "words")
    return P.max_support(targets, sources, "conv_id")


@query("max_support_p5", f"""WITH {_MAXPOOL} SELECT c.conv_id, c.turn, c.idx, round(CASE WHEN EXISTS (SELECT 1 FROM sent n WHERE n.conv_id = c.conv_id AND n.role <> 'assistant') THEN support END, 6) AS support FROM mp c""")
def max_support(spark, root):
    return source_supports(spark, root).withColumn("support", F.round("support", 6))


@query("source_support_u5", f"""WITH {_MAXPOOL}, t AS (SELECT conv_id, turn, avg(support) AS m, min(support) AS lo, count(*) AS n, count(*) FILTER (support < 0.5) AS weak FROM mp
 WHERE conv_id IN (SELECT conv_id FROM sent WHERE role <> 'assistant') GROUP BY ALL)
SELECT conv_id, round(avg(m), 4) AS mean_of_means, round(min(m), 4) AS min_of_means, round(1 - sum(m * n) / sum(n), 4) AS mean_uncertainty,
 round(sum(weak) / sum(n), 4) AS weak_share FROM t GROUP BY 1""")
def source_support(spark, root):
    per_note = source_supports(spark, root).filter("support is not null").groupBy("conv_id", "turn").agg(
        F.avg("support").alias("m"), F.sum("support").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(C("support") < 0.5).alias("weak"))
    return per_note.groupBy("conv_id").agg(
        F.round(F.avg("m"), 4).alias("mean_of_means"), F.round(F.min("m"), 4).alias("min_of_means"),
        F.round(1 - F.sum("s") / F.sum("n"), 4).alias("mean_uncertainty"), F.round(F.sum("weak") / F.sum("n"), 4).alias("weak_share"))


JUDGE_SQL = "(['Faithful', 'Fabrication', 'Negation', 'PARSE_ERROR'])[1 + (idx + doc_id) % 4]"


@query("match_by_text_p6", f"""WITH {SENT}, j AS (SELECT doc_id, idx, {S.norm('s')} AS n, {JUDGE_SQL} AS label FROM sent),
lk AS (SELECT doc_id, n, max_by((label <> 'Faithful')::BIGINT, idx) AS label FROM j WHERE label <> 'PARSE_ERROR' GROUP BY 1, 2)
SELECT sent.doc_id, sent.idx, length(s)::BIGINT AS score, lk.label FROM sent JOIN lk ON lk.doc_id = sent.doc_id AND lk.n = {S.norm('s')}""")
def match_by_text(spark, root):
    sents = document_sentences(spark, root)
    label = F.get(F.array(F.lit(0), F.lit(1), F.lit(1), F.lit(None)), ((C("idx") + C("doc_id")) % 4).cast("int")).cast("bigint")
    judged = sents.select("doc_id", "idx", F.replace("s", F.lit(" "), F.lit("  ")).alias("s"), label.alias("label"))
    return M.match_by_text(sents, judged, ["doc_id"], "s", "label", "idx").select(
        "doc_id", "idx", F.length("s").cast("bigint").alias("score"), "label")


RATERS = ["r1", "r2", "r3"]


def votes(spark, root):
    """Three derived raters of each labelled document; some votes are missing."""
    base = table(spark, root, "labels").select("doc_id", "toxic")
    rated = base.select("doc_id", "toxic", F.explode(F.array(*[F.lit(r) for r in RATERS])).alias("rater")) \
        .withColumn("h", F.md5(F.concat("rater", C("doc_id").cast("string"))))
    kind = F.when(F.substring("h", 1, 1).isin(*"0123456789ab"), "Faithful").when(F.substring("h", 2, 1).isin(*"01234567"), "Fabrication") \
        .when(F.substring("h", 2, 1).isin(*"89ab"), "Negation").when(F.substring("h", 2, 1).isin("c", "d"), "Causality")
    return rated.filter(~F.substring("h", 3, 1).isin("0", "1")).select(
        "doc_id", "rater", F.when(kind == "Faithful", "Faithful").otherwise("Not Faithful").alias("verdict"),
        F.when(kind != "Faithful", kind).alias("type"))


VOTES_SQL = """rated AS (SELECT doc_id, toxic, rater, md5(rater || doc_id) AS h FROM labels, (SELECT unnest(['r1', 'r2', 'r3']) AS rater)),
kinds AS (SELECT doc_id, rater, CASE WHEN substr(h, 1, 1) <= 'b' THEN 'Faithful' WHEN substr(h, 2, 1) <= '7' THEN 'Fabrication' WHEN substr(h, 2, 1) <= 'b' THEN 'Negation'
  WHEN substr(h, 2, 1) IN ('c', 'd') THEN 'Causality' END AS kind FROM rated WHERE substr(h, 3, 1) NOT IN ('0', '1')),
votes AS (SELECT doc_id, rater, CASE WHEN kind = 'Faithful' THEN 'Faithful' ELSE 'Not Faithful' END AS verdict, CASE WHEN kind <> 'Faithful' THEN kind END AS type FROM kinds)"""


@query("three_way_match_p7", f"""WITH {VOTES_SQL}, maj AS (SELECT doc_id, count(*) FILTER (verdict <> 'Faithful') * 2 > count(*) AS human FROM votes GROUP BY 1)
SELECT l.doc_id, human::BIGINT AS human, toxic::BIGINT AS judge, n_chars AS score FROM maj JOIN labels l USING (doc_id) JOIN documents d USING (doc_id)""")
def three_way_match(spark, root):
    majority = votes(spark, root).groupBy("doc_id").agg(
        (F.count_if(C("verdict") != "Faithful") * 2 > F.count(F.lit(1))).cast("bigint").alias("human"))
    judge = table(spark, root, "labels").select("doc_id", C("toxic").cast("bigint").alias("judge"))
    score = table(spark, root, "documents").select("doc_id", C("n_chars").alias("score"))
    return majority.join(judge, "doc_id").join(score, "doc_id")


@query("align_by_position_p8", f"""WITH k AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT a.user_id, a.pos::BIGINT AS pos, a.event_id AS a_event_id, b.event_id AS b_event_id FROM k a JOIN k b ON a.user_id = b.user_id AND a.pos = b.pos
WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def align_by_position(spark, root):
    ev = user_events(spark, root, "event_type")
    return M.align_by_position(ev.filter("event_type = 'click'"), ev.filter("event_type = 'view'"), ["user_id"], ["ts", "event_id"], ["event_id"])


@query("position_groups_p9", f"""WITH {CLAIMS_SQL}, mx AS (SELECT conv_id, max(idx) AS last FROM sent GROUP BY 1),
grid AS (SELECT c.conv_id, c.turn, unnest(range(0, last + 1)) AS idx FROM conversations c JOIN mx USING (conv_id))
SELECT g.conv_id, g.turn, g.idx, coalesce(s, '') AS s FROM grid g LEFT JOIN sent USING (conv_id, turn, idx)""")
def position_groups(spark, root):
    sents = turn_sentences(spark, root).drop("role")
    return M.position_groups(sents, table(spark, root, "conversations"), "conv_id", "turn", "idx", "s")


@query("assign_sentence_p10", f"""WITH {SENT},
f AS (SELECT doc_id, idx, s AS fact, CASE idx % 3 WHEN 0 THEN lower(substr(s, 4, 20)) WHEN 1 THEN array_to_string(list_reverse({S.words('s')}), ' ') ELSE '' END AS span FROM sent),
fn AS MATERIALIZED (SELECT doc_id, idx, {S.norm('span')} AS span, CASE WHEN len({S.long_words('span')}) > 0 THEN {S.long_words('span')} ELSE {S.long_words('fact')} END AS w FROM f),
sn AS MATERIALIZED (SELECT doc_id, idx, {S.norm('s')} AS n, {S.long_words('s')} AS w FROM sent),
p AS (SELECT f.doc_id, f.idx, s.idx AS i, span <> '' AND contains(s.n, span) AS inside, len(list_intersect(s.w, f.w)) AS n FROM fn f JOIN sn s USING (doc_id))
SELECT doc_id, idx, i::BIGINT AS sent_idx, CASE WHEN inside THEN 'contains' ELSE 'overlap' END AS method FROM p WHERE inside OR n > 0
QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE -n END, i) = 1""")
def assign_sentence(spark, root):
    span = lambda s, i: F.struct(F.when(i % 3 == 0, F.lower(F.substring(s, 4, 20))).when(
        i % 3 == 1, F.array_join(F.reverse(T.words(s)), " ")).otherwise("").alias("span"), s.alias("fact"))
    docs = documents(spark, root).withColumn("l", T.sentences(C("text")))
    return docs.select("doc_id", F.posexplode(M.assign_sentence(C("l"), F.transform("l", span))).alias("idx", "r")).filter("r is not null") \
        .select("doc_id", big("idx").alias("idx"), big("r.i").alias("sent_idx"), C("r.method").alias("method"))


def fact_and_sentences(spark, root):
    """Assistant sentences as facts, the other sentences as candidates."""
    sents = turn_sentences(spark, root)
    section = F.get(F.array(F.lit("a"), F.lit("b"), F.lit("_any")), (F.length("s") % 3).cast("int"))
    sid = (C("turn") * 100000 + C("idx"))
    facts = sents.filter("role = 'assistant'").select("conv_id", sid.alias("fact_idx"), C("s").alias("fact"), section.alias("section"))
    rest = sents.filter("role <> 'assistant'").select("conv_id", sid.alias("sent_idx"), C("s").alias("sentence"), section.alias("section"))
    return facts, rest


def matched_facts(spark, root):
    facts, rest = fact_and_sentences(spark, root)
    return M.best_fact_match(facts, rest, ["conv_id"], "fact", "sentence", "section")


_FSTOP = S.sql_list([x for x in K.FUNCTION_WORDS + K.FACT_STOP if x not in K.TIMING_WORDS])
_TRIM = "regexp_replace(w, '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g')"
_SIG = f"""toks, CASE WHEN len(content) > 0 THEN content ELSE toks END AS seq, content, names, nums, ents, neg, salient FROM (SELECT *,
 list_filter(toks, lambda w: NOT list_contains({_FSTOP}, w)) AS content FROM (SELECT conv_id, sid, section, s, {S.word_tokens('s')} AS toks,
 {_NAMES.replace('(text,', '(s,')} AS names, list_distinct(list_transform(regexp_extract_all(s, {S.q(K.NUMBER)}), lambda w: lower(w))) AS nums,
 list_distinct(regexp_extract_all(lower(s), {S.q('\\b(' + T.literal_alternatives(K.CONDITION_TERMS + K.MEDICATION_TERMS) + ')\\b')})) AS ents,
 regexp_matches(s, {S.q(K.NEGATION)}) AS neg,
 list_distinct(list_transform(list_filter(list_transform({S.words('s')}, lambda w: {_TRIM}), lambda w: list_contains({S.sql_list(K.CUE_WORDS)}, lower(w))
   OR regexp_matches(w, {S.q(K.DOSE)}) OR regexp_matches(w, {S.q(K.ALNUM_CODE)})), lambda w: lower(w))) AS salient"""
MATCHED_SQL = f"""base AS (SELECT conv_id, turn, role, {S.sentences('text')} AS l FROM conversations),
st AS (SELECT conv_id, role, turn * 100000 + i - 1 AS sid, l[i] AS s, (['a', 'b', '_any'])[1 + length(l[i]) % 3] AS section FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM base)),
f AS (SELECT conv_id, sid, section, {_SIG} FROM st WHERE role = 'assistant'))), c AS (SELECT conv_id, sid, section, s, {_SIG} FROM st WHERE role <> 'assistant'))),
ok AS (SELECT f.conv_id, f.sid, bool_or(c.sid IS NOT NULL) AS placed FROM f LEFT JOIN c ON c.conv_id = f.conv_id AND NOT regexp_matches(c.s, {S.q(K.BARE_HEADER)})
  AND (c.section = f.section OR c.section = '_any' OR f.section = '_any') GROUP BY ALL),
pr AS (SELECT f.conv_id, f.sid AS fid, c.sid AS cid, f.seq AS fq, c.seq AS sq, f.content AS fc, f.salient AS fs, f.neg = c.neg AS same,
  list_intersect(f.ents, c.ents) AS se, len(list_intersect(f.names, c.names)) > 0 AS nm, len(list_intersect(f.nums, c.nums)) > 0 AS nu,
  len(list_intersect(f.salient, c.salient)) AS nsal, len(list_intersect(list_distinct(f.content), list_distinct(c.content))) AS nlem
  FROM f JOIN ok ON ok.conv_id = f.conv_id AND ok.sid = f.sid JOIN c ON c.conv_id = f.conv_id AND (NOT placed OR (NOT regexp_matches(c.s, {S.q(K.BARE_HEADER)})
  AND (c.section = f.section OR c.section = '_any' OR f.section = '_any')))),
sg AS (SELECT *, CASE WHEN len(se) = 0 THEN 0.0 ELSE list_max(list_transform(se, lambda e: CASE WHEN contains(e, ' ') OR contains(e, '-') THEN 1.0
   WHEN list_contains({S.sql_list(K.GENERIC_ENTITIES)}, e) THEN 0.45 ELSE 0.85 END)) END::DOUBLE AS ent,
  nsal / greatest(len(fs), 1) AS sal, nlem / greatest(len(list_distinct(fc)), 1) AS lem, ({S.lcs('fq', 'sq')}) / greatest(len(fq), 1) AS lcs FROM pr),
sc AS (SELECT *, greatest(0.32::DOUBLE * CASE WHEN len(fc) <= 3 THEN ent ELSE ent * greatest(0.3::DOUBLE, sal, lem, lcs) END + 0.18::DOUBLE * nm::INT + 0.16::DOUBLE * nu::INT + 0.16::DOUBLE * sal
   + 0.09::DOUBLE * lem + 0.09::DOUBLE * lcs + CASE WHEN greatest(ent, nm::INT, nu::INT, sal, lem, lcs) > 0 THEN CASE WHEN same THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END ELSE 0 END,
  CASE WHEN ent >= 0.85 AND (sal > 0 OR lem > 0) THEN 0.93 WHEN nu AND (sal > 0 OR lcs > 0) THEN 0.88 WHEN nm AND lcs > 0 THEN 0.9
   WHEN sal > 0 AND len(fs) <= 2 AND nsal >= 1 AND (lem >= 0.4 OR lcs >= 0.4 OR same) THEN 0.68 ELSE 0 END::DOUBLE) AS score FROM sg),
bst AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, fid ORDER BY round(score, 9) DESC, cid) = 1),
rd AS (SELECT conv_id, fid, cid, score, nm, nu, same, round(ent, 3) AS ent, round(sal, 3) AS sal, round(lem, 3) AS lem, round(lcs, 3) AS lcs FROM bst),
mt AS (SELECT f.conv_id, f.sid AS fact_idx, cid AS match_idx, round(score, 6) AS score, CASE WHEN ent >= 0.85 AND (sal > 0 OR lem >= 0.5 OR lcs >= 0.5) THEN 'entity'
  WHEN nm AND lcs >= 0.25 THEN 'name' WHEN nu AND (lcs >= 0.25 OR sal > 0) THEN 'number' WHEN sal >= 0.5 AND (lem >= 0.3 OR lcs >= 0.3 OR same) THEN 'medical_token'
  WHEN lcs >= 0.6 OR lem >= 0.75 OR (lem >= 0.5 AND lcs >= 0.5) THEN 'lcs' END AS matched_by FROM f LEFT JOIN rd ON rd.conv_id = f.conv_id AND rd.fid = f.sid)"""


@query("best_fact_match_p11", f"WITH {MATCHED_SQL} SELECT conv_id, fact_idx, match_idx, score, matched_by, matched_by IS NOT NULL AS clean_match FROM mt")
def best_fact_match(spark, root):
    return matched_facts(spark, root).select("conv_id", "fact_idx", "match_idx", "score", "matched_by", "clean_match")


@query("label_words_p12", f"""WITH w0 AS (SELECT doc_id, text, regexp_extract_all(text, '\\S+') AS h, regexp_split_to_array(text, '\\S+') AS g FROM documents),
wd AS (SELECT doc_id, i, length(h[i]) AS n, h, g FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM w0)),
ws AS (SELECT doc_id, i, sum(length(g[i])) OVER o + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, n FROM wd WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sp AS (SELECT doc_id, k, k * 90 AS b, k * 90 + 40 + (k * 37) % 80 AS e, (['Fabrication', 'Negation', 'Causality'])[1 + (k + doc_id) % 3] AS category
  FROM (SELECT doc_id, unnest(range(0, length(text) // 90 + 1)) AS k FROM documents)),
lb AS (SELECT ws.doc_id, ws.i, coalesce(max_by(category, k), 'Faithful') AS category FROM ws LEFT JOIN sp ON sp.doc_id = ws.doc_id AND a < e AND a + n > b GROUP BY 1, 2)
SELECT doc_id, category, count(*)::BIGINT AS n_words FROM lb GROUP BY 1, 2""")
def label_words(spark, root):
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 90).cast("int")), lambda k: F.struct(
        (k * 90).alias("start"), (k * 90 + 40 + (k * 37) % 80).alias("end"),
        F.get(F.array(*[F.lit(x) for x in ("Fabrication", "Negation", "Causality")]), ((k + C("doc_id")) % 3).cast("int")).alias("category")))
    docs = documents(spark, root)
    labelled = T.let(spans, lambda sp: M.label_words(T.match_spans(C("text"), "\\S+"), sp, "Faithful"))
    return docs.select("doc_id", F.explode(labelled).alias("w")).groupBy("doc_id", C("w.category").alias("category")) \
        .agg(F.count(F.lit(1)).alias("n_words"))


@query("top_k_cosine_p13", f"WITH {NEAR_SQL} SELECT label, q_id, c_id, round(cos, 6) AS cos, rank::BIGINT AS rank FROM near")
def top_k_cosine(spark, root):
    return nearest(spark, root, 5).withColumn("cos", F.round("cos", 6))


@query("pair_within_p14", """WITH k AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5('7:' || event_id), event_id) - 1 AS pos FROM events WHERE event_type IN ('error', 'view'))
SELECT a.user_id, a.pos::BIGINT AS pos, a.event_id AS pos_id, b.event_id AS neg_id FROM k a JOIN k b ON a.user_id = b.user_id AND a.pos = b.pos AND a.event_type = 'error' AND b.event_type = 'view'""")
def pair_within(spark, root):
    ev = table(spark, root, "events").filter(C("event_type").isin("error", "view")).select(
        "event_id", "user_id", (C("event_type") == "error").cast("int").alias("label"))
    return M.pair_within(ev, "user_id", "label", "event_id", "7")


@query("population_delta_p15", f"""SELECT source, round(avg(n_chars) FILTER (lang = 'en') - avg(n_chars) FILTER (lang <> 'en'), 4) AS delta_chars,
 round(avg(len({S.words('text')})) FILTER (lang = 'en') - avg(len({S.words('text')})) FILTER (lang <> 'en'), 4) AS delta_words FROM documents GROUP BY 1""")
def population_delta(spark, root):
    docs = documents(spark, root, "lang", "source", "n_chars")
    out = M.population_delta(docs, "source", C("lang") == "en", {"chars": C("n_chars"), "words": F.size(T.words(C("text")))})
    return out.select("source", F.round("delta_chars", 4).alias("delta_chars"), F.round("delta_words", 4).alias("delta_words"))
