"""Sources and sinks (S) on documents that Spark derives from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import io as IO
from ..sources.durable import shared_folder
from ..sources.tables import table
from .registry import query
from .stand_ins import documents
from .window_queries import big

C = F.col


@query("generation_documents_s1", """SELECT doc_id AS sample_idx, (i - 1)::BIGINT AS note_idx, l[i] AS note, 'tr ' || doc_id AS transcript FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""")
def generation_documents(spark, root):
    """Lines as the notes of a sample, through the JSON document form."""
    doc = F.to_json(F.struct(C("doc_id").alias("sample_idx"), F.concat(F.lit("tr "), C("doc_id")).alias("transcript"), F.split("text", "\n").alias("notes")))
    parsed = documents(spark, root).select(F.from_json(doc, IO.GENERATION).alias("d")).select("d.*")
    return IO.explode_notes(parsed).select(big("sample_idx").alias("sample_idx"), big("note_idx").alias("note_idx"), "note", "transcript")


@query("file_keys_s2", """SELECT conv_id AS sample_idx, turn AS note_idx, length(text)::BIGINT AS size FROM conversations WHERE role <> 'system'""")
def file_keys(spark, root):
    """Keys that live in a file name; names of another form are skipped."""
    path = F.concat(F.lit("out/sentences/"), F.when(C("role") == "system", "summary_").otherwise("sample_"), F.lpad(C("conv_id").cast("string"), 5, "0"),
                    F.lit("_note_"), F.lpad(C("turn").cast("string"), 2, "0"), F.lit("_sentences.csv"))
    rows = table(spark, root, "conversations").withColumn("path", path)
    return IO.file_keys(rows, C("path")).select(big("sample_idx").alias("sample_idx"), big("note_idx").alias("note_idx"), F.length("text").cast("bigint").alias("size"))


@query("union_splits_s3", "SELECT source, lang, doc_id % 7 AS sample_idx, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang, doc_id % 7 ORDER BY doc_id) = 1")
def union_splits(spark, root):
    docs = table(spark, root, "documents").select("source", "lang", (C("doc_id") % 7).alias("sample_idx"), "doc_id", "n_chars")
    return IO.union_splits(docs, ["source", "lang", "sample_idx"], ["doc_id"])


@query("resolve_columns_s4", """SELECT doc_id, text AS transcript, coalesce(nullif(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END, '^\\s+|\\s+$', '', 'g'), ''), lang) AS gold FROM documents""")
def resolve_columns(spark, root):
    docs = documents(spark, root, "lang", "source").select("doc_id", C("text").alias("conversation"), F.when(C("doc_id") % 3 == 0, "  ").otherwise(C("source")).alias("tgt"), C("lang").alias("note"))
    return docs.select("doc_id", IO.resolve_column(docs, ["src", "dialogue", "conversation", "transcript", "input"], True).alias("transcript"),
                       IO.resolve_column(docs, ["target", "tgt", "note"], False).alias("gold"))


_LAYOUT = """CASE event_id % 4 WHEN 0 THEN '"' || k || '"' WHEN 1 THEN '{"type": "' || k || '", "severity": "Major"}'
 WHEN 2 THEN '{"faithful": "Not Faithful", "type": "' || k || '", "severity": "Minor"}' ELSE '{"faithful": "Faithful", "type": null}' END"""
_KIND = "CASE event_type WHEN 'click' THEN 'Faithful' WHEN 'view' THEN 'Fabrication' WHEN 'error' THEN 'Negation' WHEN 'purchase' THEN 'Other' ELSE 'Contextual' END"


@query("annotations_s5", f"""WITH e AS (SELECT event_id, {_KIND} AS k, regexp_extract(props, '\\d+')::BIGINT AS idx FROM events)
SELECT event_id, idx, CASE event_id % 4 WHEN 2 THEN 'Not Faithful' WHEN 3 THEN 'Faithful' ELSE CASE k WHEN 'Faithful' THEN 'Faithful' WHEN 'Other' THEN NULL ELSE 'Not Faithful' END END AS faithful,
 CASE event_id % 4 WHEN 2 THEN k WHEN 3 THEN NULL ELSE CASE WHEN k IN ('Faithful', 'Other') THEN NULL ELSE k END END AS type, (['N/A', '4', '2', 'N/A'])[1 + event_id % 4] AS severity FROM e""")
def annotations(spark, root):
    """Label maps in the present and the two older layouts."""
    ev = table(spark, root, "events").select("event_id", F.expr(_KIND).alias("k"), F.get_json_object("props", "$.k").alias("i"))
    labels = ev.select("event_id", F.concat(F.lit('{"'), C("i"), F.lit('": '), F.expr(_LAYOUT), F.lit("}")).alias("labels"))
    return labels.select("event_id", F.inline(IO.annotation_labels(C("labels"))))


@query("available_s6", """WITH p AS (SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rk FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N'))
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM p WHERE rk = l_linenumber AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = p.l_orderkey AND b.l_linenumber = p.l_linenumber AND b.l_linestatus = 'O')""")
def available(spark, root):
    li = table(spark, root, "lineitem").select("l_orderkey", (C("l_linenumber") - 1).cast("bigint").alias("note"), "l_returnflag", "l_linestatus")
    a = li.filter("l_returnflag <> 'N'").select("l_orderkey", "note").distinct()
    out = IO.available(a, li.filter("l_linestatus = 'O'"), "l_orderkey", "note")
    return out.select("l_orderkey", (C("note") + 1).alias("l_linenumber"))


@query("pending_s7", "SELECT o_orderkey, o_custkey FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) < 3")
def pending(spark, root):
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", F.lit(3).alias("expected"))
    done = table(spark, root, "lineitem").select(C("l_orderkey").alias("o_orderkey"))
    return IO.pending(orders, done, "o_orderkey", "expected").drop("expected")


@query("status_table_s9", """SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_notes, CASE WHEN n IS NULL THEN 'no_generations' WHEN n < 8 THEN 'insufficient_generations' ELSE 'ok' END AS status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def status_table(spark, root):
    return IO.status_table(table(spark, root, "customer").select("c_custkey"), table(spark, root, "orders").select(C("o_custkey").alias("c_custkey")), "c_custkey", 8)


@query("scope_s10", "SELECT conv_id, turn, role FROM conversations WHERE conv_id >= 10 AND conv_id < 80 AND turn < 3")
def scope(spark, root):
    return IO.scope(table(spark, root, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 10, 80, 3)


@query("cap_notes_s10", "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 25")
def cap_notes(spark, root):
    return IO.cap_notes(table(spark, root, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 25)


@query("note_round_trip_s9", """SELECT lang AS config, 'test' || (doc_id % 3) AS split, (doc_id % 8)::INT AS sample_idx, ((doc_id // 8) % 5)::INT AS note_idx,
 doc_id::INT AS sentence_idx, md5(text) AS sentence, (n_chars % 100) / 100.0::DOUBLE AS uncertainty FROM documents""")
def note_round_trip(spark, root):
    """Notes written in part, listed, the pending ones and some again written, and all read."""
    folder = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    doc = C("doc_id")
    rows = table(spark, root, "documents").select(
        C("lang").alias("config"), F.concat(F.lit("test"), (doc % 3).cast("string")).alias("split"), (doc % 8).cast("int").alias("sample_idx"),
        F.floor(doc / 8 % 5).cast("int").alias("note_idx"), doc.cast("int").alias("sentence_idx"), F.md5("text").alias("sentence"), (C("n_chars") % 100 / 100.0).alias("uncertainty"))
    IO.write_notes(rows.filter("sample_idx < 5"), folder, "sentences")
    missing = rows.join(IO.written_notes(spark, folder), ["config", "split", "sample_idx", "note_idx"], "left_anti")
    IO.write_notes(missing.unionByName(rows.filter("sample_idx = 2")), folder, "sentences")
    return IO.read_notes(spark, folder, IO.SENTENCE_SCORE).select("config", "split", "sample_idx", "note_idx", "sentence_idx", "sentence", "uncertainty")
