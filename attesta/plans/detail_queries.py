"""Further forms of operators: paired, per group, with offsets, with shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import sql as S
from ..functions import text as T
from ..functions import windows as W
from ..operators import labels as L
from ..operators import match as M
from ..operators import score as U
from ..operators import segments as G
from ..sources.tables import table
from .label_queries import _FIVE_SQL, _JUDGED, SENT, _five, judged
from .match_queries import _RUN, _pattern
from .registry import query
from .stand_ins import document_sentences, documents, notes

C = F.col


def turn_pairs(spark, root):
    """Every turn as a note and the turn before it as its source."""
    conv = table(spark, root, "conversations").select("conv_id", "turn", C("text").alias("note"))
    before = table(spark, root, "conversations").select("conv_id", (C("turn") + 1).alias("turn"), C("text").alias("source"))
    return conv.join(before, ["conv_id", "turn"])


def _gram_list(e, n):
    return f"list_transform(range(1, len({e}) - {n - 2}), lambda i: array_to_string({e}[i:i + {n - 1}], ' '))"


_PAIRS = f"p AS (SELECT a.conv_id, a.turn, {S.words('lower(a.text)')} AS w, {S.words('lower(b.text)')} AS v FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)"


@query("extractive_pairs_t21", f"""WITH {_PAIRS}, g AS (SELECT conv_id, turn, list_distinct({_gram_list('w', 4)}) AS a, list_distinct({_gram_list('v', 4)}) AS b FROM p)
SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b)) / nullif(len(a), 0), 0) + 1e-9, 4)::DOUBLE AS share FROM g""")
def extractive_pairs(spark, root):
    return turn_pairs(spark, root).select("conv_id", "turn", G.paired_share(C("note"), C("source"), 4).alias("share"))


@query("coverage_pairs_t21", f"""WITH {_PAIRS}, g AS (SELECT conv_id, turn, w, {_gram_list('w', 3)} AS a, {_gram_list('v', 3)} AS b FROM p),
h AS (SELECT conv_id, turn, w, list_transform(a, lambda x: list_contains(b, x)) AS hit FROM g)
SELECT conv_id, turn, len(w)::BIGINT AS n_tokens, len(list_filter(range(1, len(w) + 1), lambda i: NOT (coalesce(hit[i], false) OR (i > 1 AND coalesce(hit[i - 1], false)) OR (i > 2 AND coalesce(hit[i - 2], false)))))::BIGINT AS n_uncovered FROM h""")
def coverage_pairs(spark, root):
    return turn_pairs(spark, root).select("conv_id", "turn", F.size(T.words(F.lower("note"))).cast("bigint").alias("n_tokens"),
                                          G.paired_uncovered(C("note"), C("source")).cast("bigint").alias("n_uncovered"))


def _kappas(by):
    keys = ", ".join(f"{k}" for k in by)
    return f"""p AS (SELECT {', '.join('a.' + k for k in by if k == 'doc_group')}{', ' if 'doc_group' in by else ''}a.rater AS rater_a, b.rater AS rater_b, a.five AS la, b.five AS lb FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.rater < b.rater),
n AS (SELECT {keys}, count(*) AS n, avg((la = lb)::INT) AS po FROM p GROUP BY {keys}), x AS (SELECT {keys}, la AS l, count(*) AS c FROM p GROUP BY {keys}, la), y AS (SELECT {keys}, lb AS l, count(*) AS c FROM p GROUP BY {keys}, lb),
e AS (SELECT {keys}, sum(x.c * y.c) AS e FROM x JOIN y USING ({keys}, l) GROUP BY {keys}),
k AS (SELECT {keys}, n, CASE WHEN n >= 2 THEN (po - coalesce(e, 0) / n / n) / nullif(1 - coalesce(e, 0) / n / n, 0) END AS kappa FROM n LEFT JOIN e USING ({keys}))"""


@query("mean_kappa_a1", f"WITH {_FIVE_SQL}, v AS (SELECT * FROM v5), {_kappas(['rater_a', 'rater_b'])} SELECT count(*)::BIGINT AS n_pairs, round(avg(kappa), 6) AS mean_kappa, round(stddev_pop(kappa), 6) AS sd_kappa FROM k")
def mean_kappa(spark, root):
    """Mean of the pairwise kappas over all items."""
    pairs = L.cohen_kappa(L.rater_pairs(_five(spark, root), "doc_id", "five"), ["rater_a", "rater_b"])
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("kappa"), 6).alias("mean_kappa"), F.round(F.stddev_pop("kappa"), 6).alias("sd_kappa"))


@query("kappa_by_sample_a1", f"WITH {_FIVE_SQL}, v AS (SELECT *, doc_id % 20 AS doc_group FROM v5), {_kappas(['doc_group', 'rater_a', 'rater_b'])} SELECT doc_group, count(kappa)::BIGINT AS n_pairs, round(avg(kappa), 6) AS mean_kappa FROM k GROUP BY 1")
def kappa_by_sample(spark, root):
    """Mean of the pairwise kappas inside every sample."""
    v = _five(spark, root).withColumn("doc_group", C("doc_id") % 20)
    a, b = (v.select("doc_group", "doc_id", C("rater").alias(f"rater_{x}"), C("five").alias(f"l{x}")) for x in "ab")
    counts = a.join(b, ["doc_group", "doc_id"]).filter("rater_a < rater_b").groupBy("doc_group", "rater_a", "rater_b", "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    each = L.cohen_kappa(counts, ["doc_group", "rater_a", "rater_b"])
    return each.groupBy("doc_group").agg(F.count("kappa").alias("n_pairs"), F.round(F.avg("kappa"), 6).alias("mean_kappa"))


@query("quadrant_shares_u17", """WITH m AS (SELECT l_returnflag, quantile_cont(l_discount, 0.5) AS a, quantile_cont(l_tax, 0.5) AS b FROM lineitem GROUP BY 1),
q AS (SELECT l_returnflag, l_discount, l_tax, CASE WHEN l_discount >= a AND l_tax < b THEN 'extractive' WHEN l_discount < a AND l_tax >= b THEN 'parametric' WHEN l_discount >= a THEN 'synthesized' ELSE 'hallucinatory' END AS quadrant FROM lineitem JOIN m USING (l_returnflag)),
c AS (SELECT l_returnflag, quadrant, count(*) AS n FROM q GROUP BY 1, 2), d AS (SELECT l_returnflag, quadrant AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, quadrant) = 1)
SELECT l_returnflag, round(avg((quadrant = 'extractive')::INT), 6) AS extractive, round(avg((quadrant = 'parametric')::INT), 6) AS parametric, round(avg((quadrant = 'synthesized')::INT), 6) AS synthesized,
 round(avg((quadrant = 'hallucinatory')::INT), 6) AS hallucinatory, round(avg(l_tax - l_discount), 6) AS net, any_value(dominant) AS dominant FROM q JOIN d USING (l_returnflag) GROUP BY 1""")
def quadrant_shares(spark, root):
    li = table(spark, root, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return U.quadrant_shares(U.quadrants(li, ["l_returnflag"], "l_discount", "l_tax"), ["l_returnflag"], "l_discount", "l_tax")


@query("slash_facts_t26", f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', ' // '), '//'), lambda s: {S.strip('s')}), lambda s: s <> '') AS l FROM documents)
SELECT doc_id, (i - 1)::BIGINT AS idx, l[i] AS fact FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)""")
def slash_facts(spark, root):
    reply = F.replace(C("text"), F.lit(". "), F.lit(" // "))
    return documents(spark, root).select("doc_id", F.posexplode(T.slash_facts(reply)).alias("idx", "fact")).withColumn("idx", C("idx").cast("bigint"))


_LABELS = ["Faithful", *K.ERROR_TYPES]
_SAID = "CASE event_id % 4 WHEN 0 THEN concat('I think it is faithful because ', event_type) WHEN 1 THEN 'a case of NEGATION, or causality' WHEN 2 THEN concat('{label: ', event_type) ELSE '' END"


@query("label_fallback_t23", f"SELECT event_id, coalesce(list_filter({S.sql_list(_LABELS)}, lambda x: contains(lower({_SAID}), lower(x)))[1], 'PARSE_ERROR') AS label FROM events")
def label_fallback(spark, root):
    said = table(spark, root, "events").select("event_id", F.expr(_SAID).alias("reply"))
    return said.select("event_id", T.label_in(C("reply"), _LABELS, "PARSE_ERROR").alias("label"))


def _numbered(pattern, src, keep):
    return f"""SELECT doc_id, idx, string_agg(concat(pos, ':', w), ' ' ORDER BY i) AS found FROM (SELECT doc_id, idx, i, h[i] AS w,
 (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0))::BIGINT AS pos
 FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, idx, regexp_extract_all(s, {S.q(pattern)}) AS h, regexp_split_to_array(s, {S.q(pattern)}) AS g FROM {src}))) WHERE {keep} GROUP BY 1, 2"""


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["text"])), " ")


@query("name_offsets_t16", f"WITH {SENT} {_numbered(K.CAP_WORD, 'sent', f'NOT list_contains({S.sql_list(K.NAME_STOP)}, lower(w))')}")
def name_offsets(spark, root):
    return document_sentences(spark, root).select("doc_id", "idx", _listed(T.name_spans(C("s"))).alias("found")).filter("found <> ''")


@query("cue_offsets_t16", f"""WITH {SENT}, c AS (SELECT doc_id, idx, {S.q(sorted(K.CUE_WORDS)[0].upper() + ' and ')} || s || {S.q(' ' + sorted(K.CUE_WORDS)[-1])} AS s FROM sent)
{_numbered('[A-Za-z]+', 'c', f'list_contains({S.sql_list(K.CUE_WORDS)}, lower(w))')}""")
def cue_offsets(spark, root):
    cues = sorted(K.CUE_WORDS)
    marked = F.concat(F.lit(cues[0].upper() + " and "), C("s"), F.lit(" " + cues[-1]))
    return document_sentences(spark, root).select("doc_id", "idx", _listed(T.cue_spans(marked)).alias("found")).filter("found <> ''")


_W = S.words("text")


@query("swap_dose_t28", f"""WITH x AS (SELECT doc_id, text, coalesce(({_W})[4], '') AS old FROM documents)
SELECT doc_id, CASE WHEN old <> '' THEN left(text, strpos(text, old) - 1) || '1000mg' || substr(text, strpos(text, old) + length(old)) ELSE text END AS corrupted FROM x""")
def swap_dose(spark, root):
    """The fourth word stands for the dose; its first occurrence is replaced."""
    old = F.coalesce(F.get(T.words(C("text")), F.lit(3)), F.lit(""))
    return documents(spark, root).select("doc_id", W.swap_once(C("text"), old, F.lit("1000mg")).alias("corrupted"))


@query("flip_negation_t28", f"""WITH x AS (SELECT doc_id, text, lower(coalesce(({_W})[3], '')) AS old FROM documents)
SELECT doc_id, CASE WHEN old <> '' AND strpos(lower(text), lower(old)) > 0 THEN left(text, strpos(lower(text), lower(old)) - 1) || 'reports' || substr(text, strpos(lower(text), lower(old)) + length(old)) ELSE text END AS corrupted FROM x""")
def flip_negation(spark, root):
    phrase = F.lower(F.coalesce(F.get(T.words(C("text")), F.lit(2)), F.lit("")))
    return documents(spark, root).select("doc_id", W.flip_phrase(C("text"), phrase, F.lit("reports")).alias("corrupted"))


@query("position_mismatch_p8", """SELECT user_id, count(*) FILTER (event_type = 'click')::BIGINT AS n_a, count(*) FILTER (event_type = 'view')::BIGINT AS n_b FROM events
WHERE event_type IN ('click', 'view') GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') <> count(*) FILTER (event_type = 'view')""")
def position_mismatch(spark, root):
    """Users whose two lists differ in length, so that alignment by position leaves some out."""
    ev = table(spark, root, "events")
    return M.position_mismatch(ev.filter("event_type = 'click'"), ev.filter("event_type = 'view'"), ["user_id"])


_LISTS = f"""{S.NOTES}, a AS (SELECT doc_id, i AS idx, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(note, chr(10)) AS l FROM notes))),
b AS (SELECT doc_id, i AS idx, CASE WHEN i % 4 = 0 THEN l[i] || ' :' ELSE l[i] END AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
ca AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pos FROM a WHERE NOT ends_with({S.strip('s')}, ':')),
cb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pos FROM b WHERE NOT ends_with({S.strip('s')}, ':'))"""


def two_lists(spark, root):
    """Lines of a note with headers, and of its document with other headers."""
    with_heads = notes(spark, root).select("doc_id", F.posexplode(F.split("note", "\n")).alias("idx", "s"))
    plain = documents(spark, root).select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "s")) \
        .withColumn("s", F.when((C("idx") + 1) % 4 == 0, F.concat("s", F.lit(" :"))).otherwise(C("s")))
    return with_heads, plain


@query("align_content_p8", f"""WITH {_LISTS} SELECT doc_id, pos::BIGINT AS pos, (ca.idx - 1)::BIGINT AS a_idx, (cb.idx - 1)::BIGINT AS b_idx, ca.s = cb.s AS same FROM ca JOIN cb USING (doc_id, pos)""")
def align_content(spark, root):
    a, b = two_lists(spark, root)
    out = M.align_content(a, b, ["doc_id"], ["idx"], "s", ["idx", "s"])
    return out.select("doc_id", "pos", C("a_idx").cast("bigint").alias("a_idx"), C("b_idx").cast("bigint").alias("b_idx"), (C("a_s") == C("b_s")).alias("same"))


@query("content_mismatch_p8", f"""WITH {_LISTS}, na AS (SELECT doc_id, count(*) AS n FROM ca GROUP BY 1), nb AS (SELECT doc_id, count(*) AS n FROM cb GROUP BY 1)
SELECT doc_id, coalesce(na.n, 0)::BIGINT AS n_a, coalesce(nb.n, 0)::BIGINT AS n_b FROM na FULL JOIN nb USING (doc_id) WHERE coalesce(na.n, 0) <> coalesce(nb.n, 0)""")
def content_mismatch(spark, root):
    """Documents whose lists differ in length once headers are stripped."""
    a, b = (x.filter(~T.ends_with_colon(C("s"))) for x in two_lists(spark, root))
    return M.position_mismatch(a, b, ["doc_id"])


_FLAGGED = "(doc_id * 7 + idx * 13) % 10 / 10.0::DOUBLE AS u, (idx + doc_id) % 5 <> 0 AS clean, CASE WHEN idx % 3 = 0 THEN '' ELSE flagged END AS given"


@query("loose_labels_j3", f"""WITH {SENT}, {_JUDGED}, x AS (SELECT *, {_FLAGGED} FROM jd),
y AS (SELECT doc_id, idx, u, given, CASE WHEN label = 'Faithful' THEN 0 ELSE 1 END AS loose, len(list_filter({S.words('fact')}, lambda w: length(w) > 3 AND contains(lower(given), lower(w)))) > 0 AS touches
 FROM x WHERE clean AND label <> 'PARSE_ERROR')
SELECT source, (count(*))::BIGINT AS n_facts, sum(loose)::BIGINT AS n_loose, count(*) FILTER (u > 0.5 AND loose = 1 AND given <> '')::BIGINT AS n,
 round(avg(touches::INT) FILTER (u > 0.5 AND loose = 1 AND given <> ''), 6) AS rate FROM y JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1""")
def loose_labels(spark, root):
    """Loose labels by source, and how often an uncertain fact of a bad sentence touches the flagged span."""
    rows = judged(spark, root).withColumn("u", (C("doc_id") * 7 + C("idx") * 13) % 10 / 10.0).withColumn("clean", (C("idx") + C("doc_id")) % 5 != 0) \
        .withColumn("given", F.when(C("idx") % 3 == 0, "").otherwise(C("flagged")))
    facts = L.loose_facts(rows, "fact", "label", "given", "clean").join(table(spark, root, "documents").select("doc_id", "source"), "doc_id")
    counts = facts.groupBy("source").agg(F.count(F.lit(1)).alias("n_facts"), F.sum("loose").alias("n_loose"))
    return counts.join(L.overlap_rate(facts, ["source"], "u", "given"), "source", "left") \
        .select("source", "n_facts", "n_loose", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.round("rate", 6).alias("rate"))


_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _single(text):
    return f"regexp_replace({text}, '\\s+', ' ', 'g')"


_TRIES = f"""CASE k % 5 WHEN 0 THEN substr(text, k * 50 + 1, 30) WHEN 1 THEN translate(substr(text, k * 50 + 1, 30), '{_SMALL}', '{_LARGE}') WHEN 2 THEN replace(substr(text, k * 50 + 1, 30), ' ', '  ')
 WHEN 3 THEN 'zq ' || substr(text, k * 50 + 1, 30) ELSE '  ' END"""


@query("spans_located_p12", f"""WITH d AS (SELECT doc_id, text, {S.strip(_single('text'))} AS hay FROM documents),
k AS (SELECT doc_id, hay, lower(hay) AS low, list_transform(range(0, length(text) // 50 + 1), lambda k: {S.strip(_single(_TRIES))}) AS spans FROM d)
SELECT doc_id, len(list_filter(spans, lambda x: x <> ''))::BIGINT AS n_spans, len(list_filter(spans, lambda x: x <> '' AND (contains(hay, x) OR contains(low, lower(x)))))::BIGINT AS n_located FROM k""")
def spans_located(spark, root):
    """Spans tried and located in each text: exact, in other case, with wider blanks, absent, blank."""
    def piece(k):
        return F.substr(C("text"), k * 50 + 1, F.lit(30))

    spans = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 50).cast("int")), lambda k: F.struct(
        F.when(k % 5 == 0, piece(k)).when(k % 5 == 1, F.translate(piece(k), _SMALL, _LARGE)).when(k % 5 == 2, F.replace(piece(k), F.lit(" "), F.lit("  ")))
        .when(k % 5 == 3, F.concat(F.lit("zq "), piece(k))).otherwise("  ").alias("span"), F.lit("Fabrication").alias("category")))
    return documents(spark, root).select("doc_id", M.located_spans(C("text"), spans).alias("r")) \
        .select("doc_id", C("r.n_spans").cast("bigint").alias("n_spans"), C("r.n_located").cast("bigint").alias("n_located"))


@query("contribution_fractions_u20", """SELECT l_suppkey, round(sum(abs(l_discount)) / nullif(sum(abs(l_discount)) + sum(abs(l_tax)), 0), 6) AS first_fraction,
 round(avg(l_discount) FILTER (l_linestatus = 'O'), 6) AS flagged_mean, round(avg(l_discount) FILTER (l_linestatus <> 'O'), 6) AS clean_mean FROM lineitem GROUP BY 1""")
def contribution_fractions(spark, root):
    """Share of one kind of contribution in both, and its mean on flagged and on clean rows."""
    out = U.contribution_fractions(table(spark, root, "lineitem"), ["l_suppkey"], C("l_discount"), C("l_tax"), C("l_linestatus") == "O")
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("first_fraction", "flagged_mean", "clean_mean")])


@query("verdict_crosstab_j4", f"""WITH {SENT}, {_JUDGED}, v AS (SELECT CASE WHEN label = 'Faithful' THEN 'faithful' WHEN label = 'PARSE_ERROR' THEN 'none' ELSE 'error' END AS old_verdict,
 CASE WHEN label NOT IN ('Faithful', 'PARSE_ERROR') AND list_has_any({S.long_words('fact')}, {S.long_words('flagged')}) THEN 'error' WHEN label = 'Faithful' THEN 'faithful' ELSE 'none' END AS new_verdict FROM jd)
SELECT old_verdict, new_verdict, count(*)::BIGINT AS n FROM v GROUP BY 1, 2""")
def verdict_crosstab(spark, root):
    """How often the sentence verdict and the verdict on the fact agree."""
    j = judged(spark, root)
    old = F.when(C("label") == "Faithful", "faithful").when(C("label") == "PARSE_ERROR", "none").otherwise("error")
    strict = L.strict_label(C("label"), C("fact"), C("flagged"))
    new = F.when(C("label") == "Faithful", "faithful").when((C("label") != "PARSE_ERROR") & (strict == 1), "error").otherwise("none")
    return L.confusion(j.select(old.alias("old_verdict"), new.alias("new_verdict")), "old_verdict", "new_verdict")


@query("absent_values_u12", """WITH h AS (SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS day, event_type, floor(value / 50)::BIGINT AS v FROM events WHERE value IS NOT NULL),
g AS (SELECT DISTINCT user_id, day FROM h), k AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type),
c AS (SELECT user_id, event_type, v, count(*) AS n FROM h GROUP BY 1, 2, 3), t AS (SELECT user_id, event_type, sum(n) AS total FROM c GROUP BY 1, 2),
s AS (SELECT user_id, event_type, round(-sum(n / total * ln(n / total)), 6) + 0.0 AS entropy, string_agg(concat(v, ':', n), ' ' ORDER BY n DESC, v) AS found FROM c JOIN t USING (user_id, event_type) GROUP BY 1, 2),
a AS (SELECT user_id, day, event_type FROM g CROSS JOIN k ANTI JOIN h USING (user_id, day, event_type))
SELECT user_id, day, event_type, entropy, found, row_number() OVER (PARTITION BY user_id, day ORDER BY entropy DESC, event_type) AS position FROM a JOIN s USING (user_id, event_type)""")
def absent_values(spark, root):
    """What the other generations say about a claim type that one of them leaves out, the least settled type first."""
    ev = table(spark, root, "events").filter("value is not null").select(
        "user_id", F.unix_date(F.to_date("ts")).cast("bigint").alias("day"), "event_type", F.floor(C("value") / 50).alias("v"))
    return U.absent_values(ev, "user_id", "day", "event_type", "v", ["click", "error", "purchase", "signup", "view"])


_LETTERS = "etaoin"


def letter_counts(c):
    """Stand-in for a sentence vector: how often six letters occur."""
    low = F.lower(c)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in _LETTERS])


def _letters_sql(e):
    return "[" + ", ".join(f"(length(lower({e})) - length(replace(lower({e}), '{x}', '')))::DOUBLE" for x in _LETTERS) + "]"


_CHAIN_COS = "round(list_dot_product(sv, cv) / nullif(sqrt(list_dot_product(sv, sv)) * sqrt(list_dot_product(cv, cv)), 0), 9)"


@query("locate_chain_p2", f"""WITH {SENT}, two AS (SELECT doc_id, idx, s, 0 AS k, CASE idx % 3 WHEN 0 THEN lower(substr(s, 3)) WHEN 1 THEN array_to_string(list_reverse({S.words('s')}), ' ') ELSE replace(replace(lower(s), 'e', 'ee'), 'h', 'q') END AS span FROM sent
 UNION ALL SELECT doc_id, idx, s, 1, replace(lower(s), 'h', 'xx') FROM sent WHERE idx % 4 = 0),
sp AS (SELECT doc_id, idx * 2 + k AS idx, s, span FROM two),
x AS (SELECT *, regexp_extract(s, {_pattern('span')}) AS m1, regexp_extract(s, '(?i)' || {_pattern('span')}) AS m2 FROM sp),
ex AS (SELECT *, CASE WHEN m1 <> '' THEN m1 ELSE m2 END AS m FROM x),
miss AS (SELECT doc_id, idx, s, list_distinct({S.content_words('span')}) AS q FROM ex WHERE m = ''), {_RUN},
lost AS (SELECT ex.doc_id, ex.idx, ex.s, {_letters_sql('span')} AS sv, regexp_extract_all(s, '[^,;]+') AS h, regexp_split_to_array(s, '[^,;]+') AS g FROM ex LEFT JOIN best USING (doc_id, idx) WHERE m = '' AND st IS NULL),
cl AS (SELECT doc_id, idx, sv, i, len(h) AS nh, h[i] AS c, {_letters_sql('h[i]')} AS cv, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0))::BIGINT AS cs
 FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM lost)),
near AS (SELECT doc_id, idx, cs, cs + length(c) AS ce FROM (SELECT *, {_CHAIN_COS} AS cos FROM cl) WHERE nh > 1 AND cos >= 0.9 QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY cos DESC, i) = 1),
pl AS (SELECT ex.doc_id, ex.idx // 2 AS idx, ex.idx % 2 AS k, CASE WHEN m <> '' THEN strpos(s, m) - 1 WHEN st IS NOT NULL THEN st ELSE cs END AS a, CASE WHEN m <> '' THEN strpos(s, m) - 1 + length(m) WHEN st IS NOT NULL THEN en ELSE ce END AS z,
 CASE WHEN m <> '' THEN 'exact' WHEN st IS NOT NULL THEN 'word' WHEN cs IS NOT NULL THEN 'semantic' ELSE 'unmatched' END AS method FROM ex LEFT JOIN best USING (doc_id, idx) LEFT JOIN near USING (doc_id, idx))
SELECT doc_id, idx::BIGINT AS idx, string_agg(concat(method, ':', coalesce(a, -1)::BIGINT, ':', coalesce(z, -1)::BIGINT), ' ' ORDER BY k) AS placed, bool_and(method <> 'unmatched') AS verified, count(*) > 1 AS synthesised FROM pl GROUP BY 1, 2""")
def locate_chain(spark, root):
    """Exact, word and nearest-clause tiers in one chain, with clause vectors from the caller."""
    s = C("s")
    first = (F.when(C("idx") % 3 == 0, F.lower(F.substr(s, F.lit(3)))).when(C("idx") % 3 == 1, F.array_join(F.reverse(T.words(s)), " "))
             .otherwise(F.replace(F.replace(F.lower(s), F.lit("e"), F.lit("ee")), F.lit("h"), F.lit("q"))))
    spans = F.when(C("idx") % 4 == 0, F.array(first, F.replace(F.lower(s), F.lit("h"), F.lit("xx")))).otherwise(F.array(first))
    clauses = F.transform(T.match_spans(s, "[^,;]+"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), letter_counts(x["text"]).alias("vec")))
    rows = document_sentences(spark, root).withColumn("spans", spans)
    done = rows.select("doc_id", "idx", M.locate_chain(s, C("spans"), F.transform("spans", letter_counts), clauses, 0.9).alias("r"))
    text = F.array_join(F.transform("r.spans", lambda x: F.concat_ws(":", x["method"], F.coalesce(x["start"], F.lit(-1)), F.coalesce(x["end"], F.lit(-1)))), " ")
    return done.select("doc_id", "idx", text.alias("placed"), C("r.verified").alias("verified"), C("r.synthesised").alias("synthesised"))
