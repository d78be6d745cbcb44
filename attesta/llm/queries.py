"""Registered queries of the pipeline operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import decontaminate, exact_dedup, html_extraction, license_scan, mixing, near_dedup, phrases, pitman_yor, prefix_trie, quality, simhash, token_counts, toxicity

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op3_lm_score")
def op3(spark: SparkSession, root: str) -> DataFrame:
    scored = pitman_yor.score_texts(table(spark, root, "documents"), ~held_out(10, 0))
    return scored.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_exact_dedup", """
    select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
           count(*) over (partition by coalesce(text, '')) as group_size,
           doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
           sha256(coalesce(text, '')) as text_sha256
    from documents""")
def op4(spark: SparkSession, root: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, root, "documents"))


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@query("op1_toxicity")
def op1(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, root, "labels")))


@query("op2_near_dedup")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, root, "documents"), size=3, percent=85)


@query("op5_html_extraction")
def op5(spark: SparkSession, root: str) -> DataFrame:
    return html_extraction.extract(table(spark, root, "pages"))


@query("op6_quality")
def op6(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    scored = quality.score_quality(docs, quality.fit(docs, table(spark, root, "labels")))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


@query("op7_decontaminate")
def op7(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"), words=13)


@query("op8_mixing")
def op8(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix_digest(table(spark, root, "documents")).drop("source")


@query("op9_token_counts")
def op9(spark: SparkSession, root: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_license_scan")
def op10(spark: SparkSession, root: str) -> DataFrame:
    return license_scan.scan(table(spark, root, "documents"))


@query("op13_simhash_dedup")
def op13(spark: SparkSession, root: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, root, "documents"))


@query("op11_prefix_trie", """
    with bytes as (
      select list(v order by i) as t from (
        select i, list_reduce(list_prepend(i, range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v
        from range(256) r(i))),
    seqs as (
      select conv_id as c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''),
          left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) as s
      from conversations where conv_id is not null group by conv_id),
    spread as (
      select c, s, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
          lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 6 as h
      from seqs, bytes),
    whole as (
      select a.c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) as q
      from spread a left join seqs b on b.c = a.c - a.c % 100),
    paths as (select c, d, q[1:d] as p, d = len(q) as ends from (select c, q, unnest(range(len(q) + 1)) as d from whole)),
    nodes as (
      select p, d, min(c) as lo, count(*) as n, string_agg(c::varchar, ',' order by c) filter (ends) as names,
             case when d = 0 then 0 else (count(*) - 1) * length(p[d].t) end as saved
      from paths group by p, d),
    kids as (select a.p, count(*) as kids from nodes a join nodes b on b.d = a.d + 1 and b.p[1:a.d] = a.p group by a.p),
    below as (
      select a.p, sum(b.saved) as saved, count(*) filter (k.kids is null) as leaves
      from nodes a join nodes b on b.d >= a.d and b.p[1:a.d] = a.p left join kids k on k.p = b.p group by a.p)
    select n.lo as conv_id, n.d as depth, u.lo as parent_conv_id, n.n as n_convs, coalesce(k.kids, 0) as n_children,
           b.leaves as n_leaves, b.saved::bigint as saved_tokens, sha256(coalesce(n.names, '')) as ends_sha256,
           case when n.d > 0 then left(sha256(length(n.p[n.d].r) || ':' || n.p[n.d].r || n.p[n.d].t), 32) end as turn_id
    from nodes n join below b on b.p = n.p left join kids k on k.p = n.p left join nodes u on u.d = n.d - 1 and n.p[1:u.d] = u.p""")
def op11(spark: SparkSession, root: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, root, "conversations"))))


@query("op12_collocations", r"""
    with words as (
      select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
]')), '[^ 	]+') as w
      from documents),
    grams as (
      select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, w[i:i + k - 1] as w
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 6) ks(k) where len(w) >= k)),
    f as (select lang, k, phrase, any_value(w) as w, count(*) as f from grams group by lang, k, phrase having k = 1 or count(*) >= 100),
    totals as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
    cand as (select * from f where k > 1),
    parts as (select lang, f, k, array_to_string(w[i:i + m - 1], ' ') as phrase
      from (select lang, w, f, k, m, unnest(range(1, k - m + 2)) as i from cand, range(2, 5) ms(m) where m < k)),
    kept as (select c.* from cand c where not exists (select 1 from parts p where p.lang = c.lang and p.phrase = c.phrase and 100 * p.f >= 100 * c.f)),
    cuts as (
      select c.lang, c.phrase, c.f as a, j as c, l.f as l, r.f as r, n, (1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as score
      from (select *, unnest(range(1, k)) as j from kept) c
      join f l on l.lang = c.lang and l.k = j and l.phrase = array_to_string(c.w[1:j], ' ')
      join f r on r.lang = c.lang and r.k = c.k - j and r.phrase = array_to_string(c.w[j + 1:], ' ')
      join totals t on t.lang = c.lang),
    best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, c) = 1)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
    from best qualify rank <= 2000""")
def op12(spark: SparkSession, root: str) -> DataFrame:
    return phrases.collocations(table(spark, root, "documents"))
