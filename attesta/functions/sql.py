"""The same building blocks as DuckDB SQL, used only to check results."""

from __future__ import annotations

from . import constants as K

M = "chr(2)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def norm(e: str) -> str:
    return f"lower(trim(regexp_replace({e}, '\\s+', ' ', 'g')))"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda w: w <> '')"


def non_empty(e: str) -> str:
    return f"list_filter(list_transform({e}, lambda s: {strip('s')}), lambda s: s <> '')"


LINES = "\\r\\n|[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]"


def lines(e: str) -> str:
    return f"regexp_split_to_array({e}, '{LINES}')"


def sentences(e: str) -> str:
    """Split with a marker character in place of the look-around."""
    abbr = f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(K.ABBREVIATIONS)})\\."
    bare = strip(f"regexp_replace({strip('ln')}, {q(K.BULLETS)}, '')")
    guarded = f"regexp_replace({bare}, {q(abbr)}, '\\1\\2' || chr(1), 'g')"
    marked = f"regexp_replace({guarded}, '(\\.)\\s+([A-Z])', '\\1' || {M} || '\\2', 'g')"
    parts = f"flatten(list_transform({lines(e)}, lambda ln: string_split({marked}, {M})))"
    return non_empty(f"list_transform({parts}, lambda p: replace(p, chr(1), '.'))")


def sentence_rows(src: str, key: str, text: str, out: str = "sent") -> str:
    """CTE with (key, idx, s)."""
    return f"""{out}_l AS (SELECT {key}, {sentences(text)} AS l FROM {src}),
{out} AS (SELECT {key}, (i - 1)::BIGINT AS idx, l[i] AS s
  FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i FROM {out}_l))"""


def word_tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {q(K.WORD)})"


def content_words(e: str) -> str:
    stop = sql_list(K.FUNCTION_WORDS + K.CLINICAL_FILLER)
    return (f"list_filter(regexp_extract_all(lower({e}), {q(K.PLAIN_WORD)}), "
            f"lambda w: NOT list_contains({stop}, w) AND length(w) > 1)")


def clean(e: str) -> str:
    bare = strip(f"regexp_replace({e}, {q(K.FIELD_PREFIX)}, '')")
    return f"regexp_replace(regexp_replace({bare}, {q(K.TEMPLATE_JUNK)}, '', 'g'), '^[ ;,.]+|[ ;,.]+$', '', 'g')"


def subclaims(e: str) -> str:
    c = clean(e)
    parts = non_empty(f"regexp_split_to_array({c}, ';\\s*')")
    return f"CASE WHEN len({parts}) > 1 THEN {parts} WHEN {c} <> '' THEN [{c}] ELSE [] END"


def note_text(key: str = "doc_id", text: str = "text") -> str:
    """Stand-in clinical note: every third line gets a header line."""
    heads = sql_list(["Subjective", "Objective", "Assessment / Problem List", "Plan", "Follow-up"])
    return (f"CASE WHEN {key} % 7 = 0 THEN {text} ELSE array_to_string(list_transform("
            f"string_split({text}, chr(10)), lambda ln, i: CASE WHEN (i - 1) % 3 = 0 THEN "
            f"({heads})[1 + ((i - 1) // 3 + {key}) % 5] || ':' || chr(10) ELSE '' END || ln), chr(10)) END")


NOTES = f"notes AS (SELECT doc_id, {note_text()} AS note FROM documents)"


def lcs(a: str, b: str) -> str:
    """LCS length of two word lists; rows of the table are lists of numbers."""
    row = (f"list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]), lambda cur, y: list_append(cur, "
           f"CASE WHEN {b}[y[1]] = {a}[x[1]] THEN prev[y[1]] + 1 ELSE greatest(prev[y[1] + 1], cur[-1]) END), [0::BIGINT])")
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i]), "
            f"lambda prev, x: {row}, list_transform(range(0, len({b}) + 1), lambda z: 0::BIGINT))[-1] END")


def long_words(e: str) -> str:
    return (f"list_distinct(list_transform(list_filter({words(e)}, lambda w: length(w) > 3), "
            f"lambda w: regexp_replace(lower(w), '^[.,;:]+|[.,;:]+$', '', 'g')))")
