"""Segmentation, normalisation and extraction (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import sql as S
from ..functions import text as T
from ..sources.tables import spread, table
from .registry import query
from .stand_ins import document_sentences, documents, notes

C = F.col


def _exploded(df, key, parts, name="s"):
    return df.select(key, F.posexplode(parts).alias("i", name)).select(key, C("i").cast("bigint").alias("idx"), name)


def _unnest(src, key, parts, name="s"):
    return (f"SELECT {key}, (i - 1)::BIGINT AS idx, l[i] AS {name} FROM (SELECT {key}, l, "
            f"unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, {parts} AS l FROM {src}))")


@query("normalise_t1", f"SELECT doc_id, {S.norm('text')} AS norm FROM documents")
def normalise(spark, root):
    return documents(spark, root).select("doc_id", T.normalise(C("text")).alias("norm"))


@query("split_sentences_t2", _unnest("documents", "doc_id", S.sentences("text")))
def split_sentences(spark, root):
    return document_sentences(spark, root)


_B = S.non_empty(
    "flatten(list_transform(string_split(text, chr(10)), lambda ln: string_split(regexp_replace("
    + S.strip("ln") + f", '([.!?])\\s+([A-Z])', '\\1' || {S.M} || '\\2', 'g'), {S.M})))")


@query("split_any_stop_t3", _unnest("documents", "doc_id", _B))
def split_any_stop(spark, root):
    return _exploded(documents(spark, root), "doc_id", T.sentences_any_stop(C("text")))


_CH = (f"regexp_split_to_array(regexp_replace(regexp_replace(text, {S.q(K.INLINE_HEADER)}, chr(10) || '\\1', 'g'), "
       f"'([.!?])\\s+', '\\1' || {S.M}, 'g'), '\\x02|\\n+')")


@query("split_at_headers_t4", _unnest("documents", "doc_id", S.non_empty(_CH)))
def split_at_headers(spark, root):
    return _exploded(documents(spark, root), "doc_id", T.sentences_at_headers(C("text")))


_TAGGED = ("(SELECT conv_id, turn, CASE role WHEN 'user' THEN '[patient] ' WHEN 'assistant' THEN '[doctor] ' "
           "ELSE '[nurse note] ' END || text AS text FROM conversations)")
_SAID = (f"array_to_string(list_transform({S.lines('text')}, lambda ln: regexp_replace({S.strip('ln')}, "
         f"{S.q(K.SPEAKER_TAG)}, '')), chr(10))")


@query("utterances_t5", f"""SELECT conv_id, turn, (i - 1)::BIGINT AS idx, l[i] AS s FROM (
 SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM (
 SELECT conv_id, turn, {S.sentences('said')} AS l FROM (SELECT conv_id, turn, {_SAID} AS said FROM {_TAGGED})))""")
def utterances(spark, root):
    tag = F.when(C("role") == "user", "[patient] ").when(C("role") == "assistant", "[doctor] ").otherwise("[nurse note] ")
    tagged = spread(table(spark, root, "conversations")).select("conv_id", "turn", F.concat(tag, "text").alias("text"))
    return tagged.select("conv_id", "turn", F.posexplode(T.utterances(C("text"))).alias("i", "s")) \
        .select("conv_id", "turn", C("i").cast("bigint").alias("idx"), "s")


@query("clauses_t6", _unnest("documents", "doc_id",
                             f"flatten(list_transform(string_split(replace(text, ',', ';'), ';'), lambda ck: {S.sentences('ck')}))"))
def clauses(spark, root):
    semi = F.replace(C("text"), F.lit(","), F.lit(";"))
    return _exploded(documents(spark, root), "doc_id", T.clauses(semi))


_SECT = ("CASE WHEN lower(h) LIKE 'subjective%' THEN 'subjective' WHEN lower(h) LIKE 'objective%' THEN 'objective' "
         "WHEN lower(h) LIKE 'assessment%' OR lower(h) LIKE 'problem%' THEN 'assessment' "
         "WHEN lower(h) LIKE 'plan%' THEN 'plan' WHEN lower(h) LIKE 'follow%' THEN 'followup' ELSE 'all' END")
BLOCKS_SQL = f"""{S.NOTES},
pieces AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id,
  string_split(regexp_replace(note, {S.q('(?im)^(' + K.SECTION_HEADER + ')(\\s*:)')}, {S.M} || '\\1\\2', 'g'), {S.M}) AS l FROM notes)),
blocks AS (SELECT doc_id, i, l[i] AS txt,
  regexp_extract(l[i], {S.q('(?i)^(' + K.SECTION_HEADER + ')')}, 1) AS h,
  list_sum([length(x) for x in l[1:i-1]])::BIGINT AS before FROM pieces WHERE i > 1),
named AS (SELECT *, {_SECT} AS section, coalesce(before, 0) AS b0, coalesce(before, 0) + length(txt) AS b1 FROM blocks)"""


@query("header_sections_t7", f"""WITH {BLOCKS_SQL}
SELECT doc_id, section, string_agg({S.strip('txt')}, chr(10) ORDER BY i) AS body FROM named GROUP BY 1, 2
UNION ALL SELECT doc_id, 'all', note FROM notes""")
def header_sections(spark, root):
    return notes(spark, root).select("doc_id", F.inline(T.header_sections(C("note"))))


_HEAD = "regexp_replace(" + S.strip("lower(ln)") + ", '[:\\s]+$', '')"
_LSEC = ("CASE WHEN length({h}) >= 50 THEN NULL " + " ".join(
    f"WHEN regexp_matches({{h}}, {S.q(p)}) THEN '{n}'" for n, p in K.LINE_SECTIONS) + " END")


@query("line_sections_t8", f"""WITH {S.NOTES},
ln AS (SELECT doc_id, i, l[i] AS ln FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, string_split(note, chr(10)) AS l FROM notes))),
tagged AS (SELECT doc_id, i, ln, {_LSEC.format(h=_HEAD)} AS h FROM ln),
filled AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 'other') AS section FROM tagged),
bodies AS (SELECT doc_id, section, string_agg(ln, chr(10) ORDER BY i) AS body FROM filled WHERE h IS NULL GROUP BY 1, 2)
SELECT d.doc_id, n.section, coalesce({S.strip('b.body')}, '') AS body FROM documents d
CROSS JOIN (SELECT unnest({S.sql_list([n for n, _ in K.LINE_SECTIONS] + ['other'])}) AS section) n
LEFT JOIN bodies b ON b.doc_id = d.doc_id AND b.section = n.section""")
def line_sections(spark, root):
    return notes(spark, root).select("doc_id", F.inline(T.line_sections(C("note"))))


_H9 = "(?i)(?:^|\\n)\\s*(Subjective|Objective|Assessment|Plan)\\s*:?"


@query("last_sections_t9", f"""WITH {S.NOTES},
p AS (SELECT doc_id, regexp_extract_all(note, {S.q(_H9)}, 1) AS hs, regexp_split_to_array(note, {S.q(_H9)}) AS bs, note FROM notes),
e AS (SELECT doc_id, i, lower(hs[i]) AS section, {S.strip('bs[i + 1]')} AS body FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM p))
SELECT doc_id, section, max_by(body, i) AS body FROM e GROUP BY 1, 2
UNION ALL SELECT doc_id, 'unknown', {S.strip('note')} FROM p WHERE len(hs) = 0""")
def last_sections(spark, root):
    return notes(spark, root).select("doc_id", F.inline(T.last_sections(C("note"))))


@query("clean_subclaims_t13", f"""WITH {S.sentence_rows('documents', 'doc_id', 'text')},
c AS (SELECT doc_id, idx, {S.subclaims("replace(s, ',', ';')")} AS l FROM sent)
SELECT doc_id, idx, (i - 1)::BIGINT AS claim_idx, l[i] AS claim FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM c)""")
def clean_subclaims(spark, root):
    parts = T.subclaims(F.replace(C("s"), F.lit(","), F.lit(";")))
    return document_sentences(spark, root).select("doc_id", "idx", F.posexplode(parts).alias("p", "claim")) \
        .select("doc_id", "idx", C("p").cast("bigint").alias("claim_idx"), "claim")


@query("header_filters_t14", f"""WITH {S.NOTES}, {S.sentence_rows('notes', 'doc_id', 'note')}
SELECT doc_id, idx, s, ends_with({S.strip('s')}, ':') AS colon,
 regexp_matches({S.strip('s')}, {S.q(K.BARE_HEADER)}) AS bare,
 regexp_matches({S.strip('s')}, {S.q(K.STRUCTURAL_LABEL)}) AS structural FROM sent""")
def header_filters(spark, root):
    rows = notes(spark, root).select("doc_id", F.posexplode(T.sentences(C("note"))).alias("idx", "s"))
    return rows.select("doc_id", C("idx").cast("bigint").alias("idx"), "s", T.ends_with_colon(C("s")).alias("colon"),
                       T.is_bare_header(C("s")).alias("bare"), T.is_structural_label(C("s")).alias("structural"))


_CORE = "lower(regexp_replace(w, '^[.,;:!?()\\[\\]{}\"''`~-]+|[.,;:!?()\\[\\]{}\"''`~-]+$', '', 'g'))"


@query("content_words_t15", f"""SELECT doc_id, array_to_string({S.content_words('text')}, ' ') AS stop_listed,
 array_to_string(list_sort(list_distinct(list_transform(list_filter({S.words('text')}, lambda w: length(w) > 3),
   lambda w: regexp_replace(lower(w), '^[.,;:]+|[.,;:]+$', '', 'g')))), ' ') AS long_words,
 len(list_filter({S.words('text')}, lambda w: regexp_matches({_CORE}, '[\\p{{L}}\\p{{N}}]')
   AND NOT list_contains({S.sql_list(K.FUNCTION_WORDS + K.POSSESSIVE_EXTRA)}, {_CORE})))::BIGINT AS n_content,
 len({S.word_tokens('text')})::BIGINT AS n_tokens FROM documents""")
def content_words(spark, root):
    t = C("text")
    return documents(spark, root).select(
        "doc_id", F.array_join(T.content_words(t), " ").alias("stop_listed"),
        F.array_join(F.array_sort(T.long_words(t)), " ").alias("long_words"),
        F.size(F.filter(T.words(t), T.is_content_word)).cast("bigint").alias("n_content"),
        F.size(T.word_tokens(t)).cast("bigint").alias("n_tokens"))


_NAMES = (f"list_sort(list_distinct(list_filter(list_transform(list_filter(list_transform({S.words('text')}, lambda w: "
          f"regexp_replace(w, '[^\\p{{L}}\\p{{N}}_''-]', '', 'g')), lambda w: regexp_matches(w, '^[A-Z][a-zA-Z]+$')), "
          f"lambda w: lower(w)), lambda w: NOT list_contains({S.sql_list(K.NAME_STOP)}, w))))")


@query("extract_values_t16", f"""WITH RECURSIVE hits AS (SELECT doc_id, text, regexp_extract_all(text, {S.q(K.NUMBER)}) AS h,
  regexp_split_to_array(text, {S.q(K.NUMBER)}) AS g, {_NAMES} AS nm FROM documents)
SELECT doc_id, array_to_string(list_transform(h, lambda x: lower(x)), ' ') AS numbers, array_to_string(nm, ' ') AS names,
 array_to_string(list_transform(h, lambda x, i: (list_sum(list_transform(g[1:i], lambda y: length(y)))
   + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0))::BIGINT::VARCHAR), ' ') AS number_starts FROM hits""")
def extract_values(spark, root):
    t = C("text")
    return documents(spark, root).select(
        "doc_id", F.array_join(T.numbers(t), " ").alias("numbers"),
        F.array_join(F.array_sort(T.names(t)), " ").alias("names"),
        F.array_join(F.transform(T.match_spans(t, K.NUMBER), lambda x: x["start"].cast("string")), " ").alias("number_starts"))


# word edges spelt out: the checker's \\b knows ASCII letters only
_NEG = "(?i)(?:^|[^\\p{L}\\p{N}_])(?:no|not|denies?|denied|without|negative for|absence of)(?:$|[^\\p{L}\\p{N}_])"


@query("negation_t17", f"""WITH {S.sentence_rows('documents', 'doc_id', 'text')}
SELECT doc_id, idx, regexp_matches(s, {S.q(_NEG)}) AS negated FROM sent""")
def negation(spark, root):
    return document_sentences(spark, root).select("doc_id", "idx", T.is_negated(C("s")).alias("negated"))


def _hit(terms, suffixes):
    return (f"(regexp_matches(lower(r), {S.q(T.literal_alternatives(terms))}) OR len(list_filter(tk, lambda w: "
            f"regexp_matches(w, {S.q('(?i)^.+(?:' + '|'.join(suffixes) + ')$')}))) > 0)")


@query("content_type_t18", f"""WITH {S.sentence_rows('documents', 'doc_id', 'text')},
p AS (SELECT doc_id, idx, {S.strip('s')} AS r FROM sent), k AS (SELECT *, regexp_extract_all(r, {S.q(K.TOKEN)}) AS tk FROM p)
SELECT doc_id, idx, CASE WHEN NOT regexp_matches(r, '[\\p{{L}}\\p{{N}}]') THEN 'word'
 WHEN contains(lower(r), 'not mentioned') OR contains(lower(r), '[unknown]') THEN 'word'
 WHEN list_contains({S.sql_list(K.CONTENT_HEADERS)}, lower({S.strip("regexp_replace(" + S.strip("string_split(r, ':')[1]") + ", '^[\\[\\]]+|[\\[\\]]+$', '', 'g')")})) THEN 'word'
 WHEN regexp_replace(regexp_replace(r, '\\[[^\\]]*\\]', '', 'g'), '^[ :;,.]+|[ :;,.]+$', '', 'g') = '' THEN 'word'
 WHEN {_hit(K.CONDITION_TERMS, K.CONDITION_SUFFIXES)} THEN 'condition'
 WHEN {_hit(K.PROCEDURE_TERMS, K.PROCEDURE_SUFFIXES)} THEN 'procedure'
 WHEN {_hit(K.MEDICATION_TERMS, K.MEDICATION_SUFFIXES)} THEN 'medication'
 WHEN regexp_matches(r, '[0-9]') THEN 'numerical'
 WHEN len(list_filter(tk[2:], lambda w: regexp_matches(w, '^[A-Z][^A-Z]*[a-z][^A-Z]*$')
   AND NOT list_contains({S.sql_list(K.PROPER_NOUN_STOP + K.CONTENT_HEADERS)}, lower(w)))) > 0 THEN 'name' ELSE 'word' END AS content_type FROM k""")
def content_type(spark, root):
    return document_sentences(spark, root).select("doc_id", "idx", T.content_type(C("s")).alias("content_type"))


def _share(test):
    return f"round(len(list_filter(w, lambda x: {test})) / (len(w) + 1) + 1e-9, 4)"


_BARE = "regexp_replace(lower(x), '[,.;]+$', '')"


@query("complexity_t20", f"""WITH k AS (SELECT doc_id, text, {S.words('text')} AS w FROM documents)
SELECT doc_id, {_share("regexp_matches(x, '^[A-Z][a-z]+$')")} AS entity_density,
 {_share(f"list_contains({S.sql_list(K.HEDGE_WORDS)}, {_BARE})")} AS hedge_density,
 {_share(f"list_contains({S.sql_list(K.NEGATION_WORDS)}, {_BARE})")} AS negation_density,
 (len(regexp_extract_all(text, '(?i)(?:doctor|physician|dr\\.?)\\s*:')) + len(regexp_extract_all(text, '(?i)patient\\s*:')))::BIGINT AS speaker_turns,
 len(w)::BIGINT AS source_words,
 round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / (len(w) + 1) + 1e-9, 4) AS type_token_ratio FROM k""")
def complexity(spark, root):
    cols = T.complexity(C("text"))
    return documents(spark, root).select("doc_id", *[v.alias(k) for k, v in cols.items()])


@query("keep_facts_t22", f"""WITH {S.sentence_rows('documents', 'doc_id', 'text')}
SELECT doc_id, idx, s AS fact FROM sent WHERE len({S.words('s')}) >= 3 AND NOT regexp_matches(s, {S.q(K.CONJUNCTION)})""")
def keep_facts(spark, root):
    return document_sentences(spark, root).filter(T.keep_fact(C("s"))).select("doc_id", "idx", C("s").alias("fact"))


@query("list_items_t26", _unnest("documents", "doc_id",
       f"list_filter(list_transform({S.lines('text')}, lambda ln: " + S.strip(f"regexp_replace({S.strip('ln')}, {S.q(K.LIST_MARK)}, '')")
       + "), lambda s: length(s) > 4)", "item"))
def list_items(spark, root):
    return _exploded(documents(spark, root), "doc_id", T.list_items(C("text")), "item")
