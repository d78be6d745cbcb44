"""Positions, parsing, edits (rest of T) and windows, chunks, runs (W)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import sql as S
from ..functions import text as T
from ..functions import windows as W
from ..operators import segments as G
from ..operators.ordered import with_position
from ..sources.tables import spread, table
from .registry import query
from .stand_ins import documents, notes
from .text_queries import BLOCKS_SQL

C = F.col


def big(c):
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


@query("sections_by_position_t10", f"""WITH RECURSIVE {BLOCKS_SQL}, {S.sentence_rows('notes', 'doc_id', 'note')},
sn AS (SELECT sent.*, note FROM sent JOIN notes USING (doc_id)),
walk AS (SELECT doc_id, idx, strpos(note, s) - 1 AS pos, CASE WHEN strpos(note, s) > 0 THEN strpos(note, s) - 1 + length(s) ELSE 0 END AS cur
  FROM sn WHERE idx = 0
 UNION ALL SELECT n.doc_id, n.idx,
  CASE WHEN strpos(substr(note, cur + 1), s) > 0 THEN cur + strpos(substr(note, cur + 1), s) - 1 ELSE -1 END,
  CASE WHEN strpos(substr(note, cur + 1), s) > 0 THEN cur + strpos(substr(note, cur + 1), s) - 1 + length(s) ELSE cur END
  FROM walk w JOIN sn n ON n.doc_id = w.doc_id AND n.idx = w.idx + 1)
SELECT w.doc_id, w.idx, coalesce(n.section, 'all') AS section FROM walk w
LEFT JOIN named n ON n.doc_id = w.doc_id AND w.pos >= b0 AND w.pos < b1""")
def sections_by_position(spark, root):
    pairs = notes(spark, root).withColumn("sents", T.sentences(C("note")))
    return pairs.select("doc_id", F.posexplode(W.sections_by_position(C("note"), C("sents"))).alias("i", "section")) \
        .select("doc_id", big("i").alias("idx"), "section")


FILLED_SQL = f"""{S.NOTES}, {S.sentence_rows('notes', 'doc_id', 'note')},
hd AS (SELECT *, lower(regexp_extract({S.strip("regexp_replace(" + S.strip('s') + ", " + S.q(K.BULLETS) + ", '')")}, {S.q(K.TABLE_HEADER)}, 1)) AS h FROM sent),
hs AS (SELECT doc_id, idx, s, CASE WHEN h = '' THEN NULL WHEN h = 'subjective' THEN 'Subjective' WHEN h = 'objective' THEN 'Objective'
  WHEN h = 'assessment' THEN 'Assessment' WHEN h = 'plan' THEN 'Plan' ELSE 'Follow-up' END AS h FROM hd),
filled AS (SELECT doc_id, idx, s, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx), 'Preamble') AS section FROM hs)"""


def filled_sections(spark, root):
    """A note is one row, so its sections are filled without a shuffle."""
    docs = notes(spark, root).select("doc_id", T.sentences(C("note")).alias("sents"))
    both = F.arrays_zip(C("sents").alias("s"), T.fill_sections(C("sents")).alias("section"))
    return docs.select("doc_id", F.posexplode(both).alias("i", "x")) \
        .select("doc_id", big("i").alias("idx"), C("x.s").alias("s"), C("x.section").alias("section"))


@query("fill_sections_t11", f"WITH {FILLED_SQL} SELECT doc_id, idx, section FROM filled")
def fill_sections(spark, root):
    return filled_sections(spark, root).select("doc_id", "idx", "section")


@query("as_of_section_t12", """SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'error')
  THEN event_type || ':' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'preamble') AS section FROM events""")
def as_of_section(spark, root):
    ev = table(spark, root, "events").select("event_id", "user_id", "ts", "event_type")
    head = F.when(C("event_type").isin("signup", "error"), F.concat("event_type", F.lit(":"), "event_id"))
    return G.as_of(ev, ["user_id"], ["ts", "event_id"], head, "section", "preamble") \
        .select("event_id", "user_id", "section")


_PATTERNS = [("dose", K.DOSE_ENTITY), ("lab", K.LAB_ENTITY), ("name", K.CAP_WORD), ("number", K.NUMBER)]


def _span_union(alias):
    parts = [f"SELECT conv_id, turn, src, tgt, '{k}' AS kind, regexp_extract_all(src, {S.q(p)}) AS h, "
             f"regexp_split_to_array(src, {S.q(p)}) AS g FROM pr" for k, p in _PATTERNS]
    return " UNION ALL ".join(parts)


@query("entities_t19", f"""WITH RECURSIVE pr AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS tgt
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS ({_span_union('pr')}), e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
sp0 AS (SELECT conv_id, turn, src, tgt, kind, h[i] AS txt, (list_sum(list_transform(g[1:i], lambda y: length(y)))
  + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0))::BIGINT AS st FROM e),
sp AS (SELECT * FROM sp0 WHERE kind IN ('name', 'number') OR st = 0 OR NOT regexp_matches(substr(src, st, 1), '[\\p{{L}}\\p{{N}}_]')),
o AS (SELECT *, st + length(txt) AS en, row_number() OVER (PARTITION BY conv_id, turn ORDER BY st, length(txt) DESC, txt, kind) AS rn FROM sp),
w AS (SELECT conv_id, turn, rn, en AS stop, TRUE AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.conv_id, o.turn, o.rn, CASE WHEN o.st >= w.stop THEN o.en ELSE w.stop END, o.st >= w.stop
  FROM w JOIN o ON o.conv_id = w.conv_id AND o.turn = w.turn AND o.rn = w.rn + 1)
SELECT o.conv_id, o.turn, st AS start_at, txt AS entity, kind, (strpos(lower(tgt), lower(txt)) - 1)::BIGINT AS found_at
FROM o JOIN w USING (conv_id, turn, rn) WHERE kept AND strpos(lower(tgt), lower(txt)) > 0""")
def entities(spark, root):
    conv = table(spark, root, "conversations").select("conv_id", "turn", "text")
    nxt = conv.select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("target"))
    pairs = spread(conv).join(nxt, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.inline(W.entities(C("text"), C("target"), _PATTERNS))).select(
        "conv_id", "turn", big("start").alias("start_at"), C("text").alias("entity"), "kind",
        big("target_start").alias("found_at"))


def _grams(src, n):
    return (f"SELECT DISTINCT {src.split(':')[1]} AS k, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS i "
            f"FROM (SELECT {src.split(':')[1]}, {S.words('lower(text)')} AS w FROM {src.split(':')[0]}))")


@query("ngram_share_t21", f"""WITH d AS ({_grams('documents:doc_id', 4)}), b AS (SELECT DISTINCT gram FROM ({_grams('benchmark:item_id', 4)}))
SELECT x.doc_id, count(d.gram)::BIGINT AS n_grams, count(b.gram)::BIGINT AS n_found,
 round(coalesce(count(b.gram) / nullif(count(d.gram), 0), 0), 6)::DOUBLE AS share
FROM documents x LEFT JOIN d ON d.k = x.doc_id LEFT JOIN b ON b.gram = d.gram GROUP BY 1""")
def ngram_share(spark, root):
    out = G.ngram_share(documents(spark, root), table(spark, root, "benchmark"), "doc_id", "text", 4)
    return out.withColumn("share", F.round("share", 6))


@query("uncovered_tokens_t21", f"""WITH t AS (SELECT doc_id, {S.words('lower(text)')} AS w FROM documents),
b AS (SELECT DISTINCT gram FROM ({_grams('benchmark:item_id', 3)})),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
c AS (SELECT doc_id, count(DISTINCT tok) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS tok FROM g SEMI JOIN b USING (gram)) GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_tokens, (len(w) - coalesce(n, 0))::BIGINT AS n_uncovered FROM t LEFT JOIN c USING (doc_id)""")
def uncovered_tokens(spark, root):
    return G.uncovered_tokens(documents(spark, root), table(spark, root, "benchmark"), "doc_id", "text")


_LABEL = ("CASE event_type WHEN 'click' THEN 'Faithful' WHEN 'view' THEN 'Fabrication' WHEN 'error' THEN 'Negation' "
          "WHEN 'purchase' THEN 'Weird' ELSE 'Contextual' END")
_REPLY = f"""CASE event_id % 5
 WHEN 0 THEN concat('Here: ```json [{{"sentence_idx": 4, "sentence": " a', event_id, '", "label": "', {_LABEL}, ' ", "span": "p"}}, {{"sentence": "b", "label": "Faithful", "note_span": "q", "spans": ["x", " ", "y"]}}] ``` done')
 WHEN 1 THEN concat('[{{"sentence": "c", "label": "', {_LABEL}, '", "note_span": ""}}]')
 WHEN 2 THEN '[{{"sentence": "c", "label": ]' WHEN 3 THEN 'nothing to parse' ELSE '' END""".replace("{{", "{").replace("}}", "}")
_ITEM = "sentence_idx bigint, sentence string, label string, note_span string, span string, spans array<string>"


@query("parse_reply_t23", f"""WITH r AS (SELECT event_id, regexp_extract(regexp_replace({_REPLY}, '```(?:json)?', '', 'g'), '(?s)\\[.*\\]') AS j FROM events),
p AS (SELECT event_id, from_json(j, '[{{"sentence_idx":"BIGINT","sentence":"VARCHAR","label":"VARCHAR","note_span":"VARCHAR","span":"VARCHAR","spans":["VARCHAR"]}}]') AS l
  FROM r WHERE json_valid(j)), e AS (SELECT event_id, i, l[i] AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p))
SELECT event_id, coalesce(x.sentence_idx, i - 1)::BIGINT AS sentence_idx, trim(x.sentence) AS sentence,
 CASE WHEN trim(x.label) IN ('Faithful', 'Fabrication', 'Negation', 'Causality', 'Contextual') THEN trim(x.label) ELSE 'PARSE_ERROR' END AS label,
 nullif(x.note_span, '') AS note_span,
 len(list_filter(coalesce(x.spans, [x.span]), lambda y: trim(coalesce(y, '')) <> ''))::BIGINT AS n_spans FROM e""")
def parse_reply(spark, root):
    ev = table(spark, root, "events").select("event_id", F.expr(_REPLY).alias("reply"))
    items = F.from_json(T.json_array_in(C("reply")), f"array<struct<{_ITEM.replace(' bigint', ':bigint').replace(' string', ':string').replace(' array', ':array')}>>")
    label = F.trim(C("x.label"))
    return ev.select("event_id", F.posexplode(items).alias("i", "x")).select(
        "event_id", F.coalesce(C("x.sentence_idx"), C("i").cast("bigint")).alias("sentence_idx"),
        F.trim(C("x.sentence")).alias("sentence"),
        F.when(label.isin("Faithful", *K.ERROR_TYPES), label).otherwise("PARSE_ERROR").alias("label"),
        F.nullif(C("x.note_span"), F.lit("")).alias("note_span"),
        big(F.size(F.filter(F.coalesce(C("x.spans"), F.array("x.span")),
                            lambda y: F.trim(F.coalesce(y, F.lit(""))) != ""))).alias("n_spans"))


@query("echo_guard_t24", f"""WITH {S.sentence_rows('documents', 'doc_id', 'text')},
items AS (SELECT doc_id, idx, s FROM sent UNION ALL SELECT doc_id + 1, idx, s FROM sent)
SELECT i.doc_id, i.idx, i.s FROM items i JOIN documents d USING (doc_id)
WHERE {S.norm('i.s')} <> '' AND contains({S.norm('d.text')}, {S.norm('i.s')})""")
def echo_guard(spark, root):
    docs = documents(spark, root)
    own = docs.select("doc_id", F.posexplode(T.sentences(C("text"))).alias("i", "s"))
    both = F.explode(F.array(C("doc_id"), C("doc_id") + 1))
    items = own.select(both.alias("doc_id"), big("i").alias("idx"), "s")
    return G.echo_guard(items, docs, "doc_id", "s", "text").select("doc_id", "idx", "s")


_VALUES = ["1", "2", "3", "4", "5", "3/5", "NA", "7", None]


def _rubric_sql():
    cells = []
    for k, item in enumerate(K.RUBRIC_ITEMS):
        v = f"(['1', '2', '3', '4', '5', '3/5', 'NA', '7', NULL])[1 + (doc_id + {k}) % 9]"
        cells.append(f"SELECT doc_id, '{item}' AS item, {v} AS raw FROM labels")
    rng = ("CASE WHEN item IN ('abstraction', 'voice_summ', 'voice_note') THEN v IN (0, 1) "
           "ELSE v BETWEEN 1 AND 5 END")
    return f"""WITH c AS ({' UNION ALL '.join(cells)}), t AS (SELECT *, (item = 'synthesized' AND raw = 'NA') AS na,
 TRY_CAST(nullif(regexp_extract(raw, '-?\\d+'), '') AS INTEGER) AS v FROM c)
SELECT doc_id, count(*) FILTER (NOT coalesce(na OR {rng}, FALSE))::BIGINT AS n_invalid,
 round(avg(v) FILTER (item IN ({', '.join(S.q(x) for x in K.LIKERT_ITEMS)})), 6) AS likert_mean,
 bool_or(coalesce(na, FALSE)) AS synthesized_na, max(v) FILTER (item = 'accurate') AS accurate FROM t GROUP BY 1"""


def rubric_values(spark, root):
    """(doc_id, scores): scores is array<struct<item,value,na>> parsed from a reply."""
    raw = F.array(*[F.lit(v) for v in _VALUES])
    fields = []
    for k, item in enumerate(K.RUBRIC_ITEMS):
        v = F.get(raw, ((C("doc_id") + k) % 9).cast("int"))
        fields.append(F.concat(F.lit(f'"{item}": '), F.coalesce(F.concat(F.lit('"'), v, F.lit('"')), F.lit("null"))))
    reply = F.concat(F.lit('<think>{"accurate": 1}</think> Grades: {'), F.concat_ws(", ", *fields), F.lit("}"))
    parsed = table(spark, root, "labels").select(
        "doc_id", F.from_json(T.last_json_object_in(reply), "map<string,string>").alias("m"))
    return parsed.select("doc_id", F.array(*[coerce_item(C("m"), item) for item in K.RUBRIC_ITEMS]).alias("scores"))


def coerce_item(m, item):
    raw = F.try_element_at(m, F.lit(item))
    na = F.lit(item == "synthesized") & (F.upper(F.trim(raw)) == "NA")
    value = F.coalesce(F.expr("cast(null as int)"), F.nullif(F.regexp_extract(raw, "(-?\\d+)", 1), F.lit("")).try_cast("int"))
    low, high = (0, 1) if item in ("abstraction", "voice_summ", "voice_note") else (1, 5)
    return F.struct(F.lit(item).alias("item"), value.alias("value"), F.coalesce(na, F.lit(False)).alias("na"),
                    F.coalesce(na | value.between(low, high), F.lit(False)).alias("valid"))


@query("rubric_t25", _rubric_sql())
def rubric(spark, root):
    sc = rubric_values(spark, root)
    likert = F.filter(C("scores"), lambda x: x["item"].isin(K.LIKERT_ITEMS) & x["value"].isNotNull())
    total = F.aggregate(likert, F.lit(0), lambda a, x: a + x["value"])
    return sc.select(
        "doc_id", big(F.size(F.filter("scores", lambda x: ~x["valid"]))).alias("n_invalid"),
        F.round(F.try_divide(total, F.size(likert)), 6).alias("likert_mean"),
        F.exists("scores", lambda x: x["na"]).alias("synthesized_na"),
        F.get(F.filter("scores", lambda x: x["item"] == "accurate"), F.lit(0))["value"].alias("accurate"))


@query("labelled_blocks_t27", f"""WITH b AS (SELECT conv_id, turn, text, string_split(text, chr(10))[1] AS f FROM conversations),
s AS (SELECT *, trim(lower(left(f, 12))) AS span FROM b)
SELECT conv_id, turn, 'first of ' || turn AS claim_text,
 CASE WHEN strpos(text, span) > 0 THEN substr(text, strpos(text, span), length(span))
  ELSE substr(text, strpos(lower(text), span), length(span)) END AS note_span, trim(f) AS supporting_line,
 'changed ' || turn || chr(10) || '---' AS modified FROM s WHERE span <> ''""")
def labelled_blocks(spark, root):
    nl = F.lit("\n")
    conv = spread(table(spark, root, "conversations")).select("conv_id", "turn", "text").withColumn(
        "first", F.get(F.split("text", "\n"), F.lit(0)))
    span = F.lower(F.left("first", F.lit(12)))
    raw = conv.withColumn("raw", F.concat(
        F.lit("Blocks follow.\nCLAIM: first of "), C("turn"), F.lit("\nNOTE_SPAN: "), span, F.lit("\nSUPPORTING_LINE: "), C("first"),
        F.lit("\nMODIFIED_TRANSCRIPT:\nchanged "), C("turn"), F.lit("\n---\nCLAIM: no span\nSUPPORTING_LINE: x\nMODIFIED_TRANSCRIPT:\nzzz\n"),
        F.lit("CLAIM: unchanged\nNOTE_SPAN: "), span, F.lit("\nMODIFIED_TRANSCRIPT:\n"), C("text"), nl,
        F.lit("CLAIM: not there\nNOTE_SPAN: 0q0q0q0q\nMODIFIED_TRANSCRIPT:\nother\n")))
    block = raw.select("conv_id", "turn", "text", F.explode(F.split("raw", "(?md)(?=^CLAIM:)")).alias("block")) \
        .filter(C("block").startswith("CLAIM:"))
    fields = block.select(
        "conv_id", "turn", "text", T.labelled_field(C("block"), "CLAIM").alias("claim_text"),
        T.labelled_field(C("block"), "NOTE_SPAN").alias("span"),
        T.labelled_field(C("block"), "SUPPORTING_LINE").alias("supporting_line"),
        T.strip(F.regexp_extract(T.strip(C("block")), "(?s)\nMODIFIED_TRANSCRIPT:\\s*\n(.+?)(?=\n[A-Z_]+:|$(?![\\s\\S]))", 1)).alias("modified"))
    low = F.lower("text")
    at = F.coalesce(*[F.nullif(x, F.lit(0)) for x in (
        F.position(C("span"), C("text")), F.position(F.lower("span"), low),
        F.position(F.trim(F.left(F.lower("span"), F.lit(20))), low))])
    return fields.filter((C("span") != "") & (C("modified") != "") & (C("modified") != T.strip(C("text")))).withColumn("at", at) \
        .filter(C("at").isNotNull()).select("conv_id", "turn", "claim_text",
                                            F.substring(C("text"), C("at"), F.length("span")).alias("note_span"),
                                            "supporting_line", "modified")


def _edit_sql():
    step, src = [], f"e0 AS (SELECT doc_id, text, {S.words('text')} AS w, 0 AS n, '' AS log FROM documents)"
    edits = [("w[1]", "'EDIT1'"), ("lower(w[3])", "'EDIT2'"), ("'zzzzqq'", "'x'"), ("w[5]", "w[5]"), ("lower(w[7])", "'EDIT3'"), ("w[9]", "'EDIT4'")]
    ctes = [src]
    for k, (o, r) in enumerate(edits, 1):
        at = f"CASE WHEN strpos(text, {o}) > 0 THEN strpos(text, {o}) ELSE strpos(lower(text), lower({o})) END"
        ok = f"(n < 3 AND {o} <> {r} AND {at} > 0)"
        ctes.append(f"e{k} AS (SELECT doc_id, CASE WHEN {ok} THEN left(text, {at} - 1) || {r} || substr(text, {at} + length({o})) ELSE text END AS text, w, "
                    f"CASE WHEN {ok} THEN n + 1 ELSE n END AS n, CASE WHEN {ok} THEN log || ({at} - 1)::BIGINT || ':' || substr(text, {at}, length({o})) || ' ' ELSE log END AS log FROM e{k - 1})")
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, text AS corrupted, n::BIGINT AS n_edits, log FROM e{len(edits)}"


@query("apply_edits_t28", _edit_sql())
def apply_edits(spark, root):
    w = T.words(C("text"))

    def edit(old, new):
        return F.struct(old.alias("original"), new.alias("replacement"), F.lit("swap").alias("category"))

    edits = F.array(edit(F.get(w, F.lit(0)), F.lit("EDIT1")), edit(F.lower(F.get(w, F.lit(2))), F.lit("EDIT2")),
                    edit(F.lit("zzzzqq"), F.lit("x")), edit(F.get(w, F.lit(4)), F.get(w, F.lit(4))),
                    edit(F.lower(F.get(w, F.lit(6))), F.lit("EDIT3")), edit(F.get(w, F.lit(8)), F.lit("EDIT4")))
    done = documents(spark, root).withColumn("d", W.apply_edits(C("text"), edits, 3))
    return done.select("doc_id", C("d.text").alias("corrupted"), big(F.size("d.spans")).alias("n_edits"), F.array_join(F.transform(
        "d.spans", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["original"], F.lit(" "))), "").alias("log"))


_SEED = 42
_RULES = sorted(K.CORRUPTION_RULES, key=lambda r: hashlib.md5(f"{_SEED}{r[0]}".encode()).hexdigest())


def _rules_sql():
    tail = S.q(K.CORRUPTION_FALLBACK)
    ctes = ["r0 AS (SELECT doc_id, text, 0 AS n FROM documents)"]
    for k, (p, r, _) in enumerate(_RULES, 1):
        pat = S.q(f"(?i)\\b{p}\\b")
        ctes.append(f"r{k} AS (SELECT doc_id, CASE WHEN n < 3 AND regexp_matches(text, {pat}) THEN regexp_replace(text, {pat}, {S.q(r)}) ELSE text END AS text, "
                    f"CASE WHEN n < 3 AND regexp_matches(text, {pat}) THEN n + 1 ELSE n END AS n FROM r{k - 1})")
    return "WITH " + ", ".join(ctes) + (f" SELECT doc_id, CASE WHEN n = 0 THEN text || {tail} ELSE text END AS corrupted, "
                                        f"greatest(n, 1)::BIGINT AS n_edits FROM r{len(_RULES)}")


@query("apply_rules_t28", _rules_sql())
def apply_rules(spark, root):
    done = documents(spark, root).withColumn("d", W.apply_rules(C("text"), _RULES, 3))
    return done.select("doc_id", C("d.text").alias("corrupted"), big(F.size("d.spans")).alias("n_edits"))


@query("sentence_windows_w1", f"""WITH l AS (SELECT doc_id, {S.sentences('text')} AS l FROM documents),
k AS (SELECT *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) AS i FROM l)
SELECT doc_id, (i - 1)::BIGINT AS win, array_to_string(l[i:i + 1], ' ') AS body FROM k""")
def sentence_windows(spark, root):
    return documents(spark, root).select("doc_id", F.posexplode(W.sentence_windows(T.sentences(C("text")))).alias("i", "body")) \
        .select("doc_id", big("i").alias("win"), "body")


@query("token_windows_w2", f"""WITH l AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
k AS (SELECT *, unnest(range(0, ceil(greatest(len(w) - 64, 0) / 32)::BIGINT + 1)) AS i FROM l)
SELECT doc_id, i::BIGINT AS win, array_to_string(w[i * 32 + 1:i * 32 + 64], ' ') AS body FROM k""")
def token_windows(spark, root):
    return documents(spark, root).select("doc_id", F.posexplode(W.token_windows(T.words(C("text")), 64)).alias("i", "body")) \
        .select("doc_id", big("i").alias("win"), "body")


_TRANSCRIPT = ("array_to_string(list_transform(string_split(text, chr(10)), lambda ln, i: CASE WHEN i % 2 = 1 THEN '[doctor] ' "
               "ELSE '[patient] ' END || ln), chr(10))")


@query("turn_windows_w3", f"""WITH RECURSIVE t AS (SELECT doc_id, {S.non_empty(f"string_split(regexp_replace({_TRANSCRIPT}, '(?i)(\\[(?:doctor|patient)\\])', {S.M} || '\\1', 'g'), {S.M})")} AS l FROM documents),
c AS (SELECT doc_id, l, len(l) AS n, list_transform(range(0, len(l) + 1), lambda k: coalesce(list_sum(list_transform(l[1:k], lambda y: length(y) + 1)), 0)) AS c FROM t),
w AS (SELECT doc_id, 0 AS win, 0 AS i FROM c WHERE n > 0
 UNION ALL SELECT c.doc_id, win + 1, len(list_filter(c.c, lambda e: e < c.c[w.i + 1] + 700)) FROM w JOIN c USING (doc_id)
  WHERE len(list_filter(c.c, lambda e: e < c.c[w.i + 1] + 700)) < c.n - 1),
z AS (SELECT w.*, l, greatest(i + 1, len(list_filter(c.c, lambda e: e <= c.c[w.i + 1] + 1400)) - 1) AS j FROM w JOIN c USING (doc_id))
SELECT doc_id, win::BIGINT AS win, i::BIGINT AS first_turn, (j - 1)::BIGINT AS last_turn, array_to_string(l[i + 1:j], chr(10)) AS body FROM z""")
def turn_windows(spark, root):
    tagged = F.array_join(F.transform(F.split("text", "\n"), lambda ln, i: F.concat(
        F.when(i % 2 == 0, "[doctor] ").otherwise("[patient] "), ln)), "\n")
    return documents(spark, root).select("doc_id", tagged.alias("tr")) \
        .select("doc_id", F.posexplode(W.turn_windows(C("tr"))).alias("i", "x")) \
        .select("doc_id", big("i").alias("win"), big("x.first").alias("first_turn"), big("x.last").alias("last_turn"), C("x.body").alias("body"))


def user_events(spark, root, *cols):
    return table(spark, root, "events").select("event_id", "user_id", "ts", *cols)


POS_SQL = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"


@query("token_chunks_w4", f"""WITH p AS (SELECT *, {POS_SQL} AS tok FROM events)
SELECT user_id, (tok // 8)::BIGINT AS chunk, max((event_type = 'error' OR event_type = 'signup')::INT)::BIGINT AS label,
 min_by(event_type, tok) FILTER (event_type IN ('error', 'signup')) AS kind, round(avg(value), 6) AS mean_score, count(*)::BIGINT AS n_tokens
FROM p GROUP BY 1, 2""")
def token_chunks(spark, root):
    ev = user_events(spark, root, "event_type", "value").withColumn("flag", C("event_type").isin("error", "signup"))
    return G.token_chunks(ev, ["user_id"], ["ts", "event_id"], 8, "flag", "event_type", "value") \
        .withColumn("mean_score", F.round("mean_score", 6))


@query("low_runs_w5", f"""WITH p AS (SELECT user_id, {POS_SQL} AS pos, value / max(value) OVER (PARTITION BY user_id) AS cv FROM events),
r AS (SELECT *, sum((cv >= 0.2)::INT) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM p)
SELECT user_id, min(pos)::BIGINT AS start_at, (max(pos) + 1)::BIGINT AS end_at, count(*)::BIGINT AS n_tokens, round(avg(cv), 6) AS mean_coverage
FROM r WHERE cv < 0.2 GROUP BY user_id, run HAVING count(*) >= 3""")
def low_runs(spark, root):
    out = G.low_runs(user_events(spark, root, "value"), ["user_id"], ["ts", "event_id"], "value", 0.2, 3)
    return out.select("user_id", C("start").alias("start_at"), C("end").alias("end_at"), "n_tokens", F.round("mean_coverage", 6).alias("mean_coverage"))


_TOK = "[a-zA-Z0-9']+"


@query("longest_run_w6", f"""WITH {S.sentence_rows('documents', 'doc_id', 'text')},
p AS (SELECT a.doc_id, a.idx, a.s, list_distinct({S.content_words('b.s')}) AS q FROM sent a JOIN sent b ON a.doc_id = b.doc_id AND b.idx = a.idx + 1),
t AS (SELECT *, regexp_extract_all(s, {S.q(_TOK)}) AS h, regexp_split_to_array(s, {S.q(_TOK)}) AS g FROM p),
e AS (SELECT doc_id, idx, s, q, i, h[i] AS w, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0))::BIGINT AS st
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM t)),
k AS (SELECT *, st + length(w) AS en FROM e WHERE list_contains(q, lower(w))),
l AS (SELECT *, lag(i) OVER o AS pi, lag(en) OVER o AS pe FROM k WINDOW o AS (PARTITION BY doc_id, idx ORDER BY i)),
r AS (SELECT *, sum((pi IS NULL OR i - pi > 3 OR regexp_matches(substr(s, pe + 1, st - pe), '[;.:]'))::INT) OVER (PARTITION BY doc_id, idx ORDER BY i) AS run FROM l),
a AS (SELECT doc_id, idx, run, min(st) AS st, max(en) AS en, count(*) AS n, any_value(len(q)) AS nq FROM r GROUP BY 1, 2, 3)
SELECT doc_id, idx, st::BIGINT AS run_start, en::BIGINT AS run_end, n::BIGINT AS hits FROM a
QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY n DESC, st) = 1 AND n >= least(2, nq)""")
def longest_run(spark, root):
    docs = documents(spark, root).select("doc_id", T.sentences(C("text")).alias("l"))
    pairs = docs.filter(F.size("l") > 1).select("doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size("l") - 2), lambda i: F.struct(F.get("l", i).alias("a"), F.get("l", i + 1).alias("b")))).alias("i", "p"))
    return pairs.select("doc_id", big("i").alias("idx"), W.longest_run(C("p.a"), C("p.b")).alias("r")).filter(C("r").isNotNull()) \
        .select("doc_id", "idx", big("r.start").alias("run_start"), big("r.end").alias("run_end"), big("r.hits").alias("hits"))


@query("span_means_w7", f"""WITH p AS (SELECT user_id, {POS_SQL} AS pos, value FROM events),
sp AS (SELECT user_id, pos AS a, pos + CASE WHEN pos % 21 = 0 THEN 0 ELSE 5 + pos % 3 END AS z FROM p WHERE pos % 7 = 0)
SELECT sp.user_id, a::BIGINT AS start_at, z::BIGINT AS end_at, round(avg(value), 6) AS mean FROM sp
LEFT JOIN p ON p.user_id = sp.user_id AND p.pos >= a AND p.pos < z GROUP BY 1, 2, 3""")
def span_means(spark, root):
    series = with_position(user_events(spark, root, "value"), ["user_id"], ["ts", "event_id"])
    width = F.when(C("pos") % 21 == 0, 0).otherwise(5 + C("pos") % 3)
    spans = series.filter(C("pos") % 7 == 0).select("user_id", C("pos").alias("start"), (C("pos") + width).alias("end"))
    out = G.span_means(series, spans, ["user_id"], C("value").cast("decimal(18,2)"))
    return out.select("user_id", C("start").alias("start_at"), C("end").alias("end_at"), F.round("mean", 6).alias("mean"))


def _w8_step(cur):
    rest = f"substr(note, {cur} + 1)"
    cases, ends = [f"WHEN strpos({rest}, s) > 0 THEN {cur} + strpos({rest}, s) - 1"], [f"WHEN strpos({rest}, s) > 0 THEN {cur} + strpos({rest}, s) - 1 + length(s)"]
    for z in (40, 24, 16):
        head = f"({cur} + strpos({rest}, left(s, {z})))"
        ok = f"length(s) >= {z} AND strpos({rest}, left(s, {z})) > 0"
        tail = f"strpos(substr(note, {head}), right(s, {z}))"
        cases.append(f"WHEN {ok} THEN {head} - 1")
        ends.append(f"WHEN {ok} THEN least(CASE WHEN {tail} > 0 THEN {head} - 2 + {tail} + {z} ELSE {head} - 1 + length(s) END, length(note))")
    mode = f"CASE WHEN strpos({rest}, s) > 0 THEN 'exact' WHEN " + " OR ".join(
        f"(length(s) >= {z} AND strpos({rest}, left(s, {z})) > 0)" for z in (40, 24, 16)) + " THEN 'fuzzy' ELSE 'fail' END"
    return f"CASE {' '.join(cases)} END", f"CASE {' '.join(ends)} END", mode


_ST0, _EN0, _MO0 = _w8_step("0")
_ST, _EN, _MO = _w8_step("cur")


@query("place_sentences_w8", f"""WITH RECURSIVE {S.sentence_rows('documents', 'doc_id', 'text', 'raw')},
sn AS (SELECT raw.doc_id, idx, text AS note, CASE idx % 4 WHEN 1 THEN left(s, 20) || '#' || substr(s, 22) WHEN 2 THEN '#' || s ELSE s END AS s FROM raw JOIN documents USING (doc_id)),
w AS (SELECT doc_id, idx, st, en, mode, coalesce(en, 0) AS cur FROM (SELECT doc_id, idx, {_ST0} AS st, {_EN0} AS en, {_MO0} AS mode FROM sn WHERE idx = 0)
 UNION ALL SELECT doc_id, idx, st, en, mode, coalesce(en, cur) FROM (SELECT n.doc_id, n.idx, {_ST} AS st, {_EN} AS en, {_MO} AS mode, cur
  FROM w JOIN sn n ON n.doc_id = w.doc_id AND n.idx = w.idx + 1))
SELECT doc_id, idx, st::BIGINT AS start_at, en::BIGINT AS end_at, mode, len(regexp_split_to_array(left(text, st), '\\s+')) - 1 AS word_at FROM w JOIN documents USING (doc_id)""")
def place_sentences(spark, root):
    altered = F.transform(T.sentences(C("text")), lambda s, i: F.when(i % 4 == 1, F.concat(
        F.left(s, F.lit(20)), F.lit("#"), F.substring(s, F.lit(22), F.length(s)))).when(i % 4 == 2, F.concat(F.lit("#"), s)).otherwise(s))
    placed = documents(spark, root).withColumn("l", altered)
    # the text itself is not repeated with every sentence
    numbered = T.let(W.place_sentences(C("text"), C("l")), lambda p: F.zip_with(
        p, W.words_before(C("text"), F.transform(p, lambda x: x["start"])), lambda x, n: F.struct(x.alias("p"), n.alias("n"))))
    placed = placed.select("doc_id", F.posexplode(numbered).alias("i", "x"))
    return placed.select("doc_id", big("i").alias("idx"), big("x.p.start").alias("start_at"), big("x.p.end").alias("end_at"), C("x.p.mode").alias("mode"),
                         big("x.n").alias("word_at"))
