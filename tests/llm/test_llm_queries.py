"""The registered queries against their SQL, and their columns on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from attesta.llm import queries

ROOT = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": {"doc_id", "expected_severity", "p_toxic", "grade", "kept"},
    "op2_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op3_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op5_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op6_quality": {"doc_id", "held_out", "score", "predicted"},
    "op7_decontaminate": {"doc_id", "item_id", "start", "end", "edits", "segments"},
    "op8_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op9_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op11_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"},
    "op12_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op13_simhash_dedup": {"doc_id", "fingerprint", "component_id"},
    "op10_license_scan": {"doc_id", "license", "coverage", "matched_words", "start", "end"},
}


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, ROOT)
    assert set(df.columns) == COLUMNS[name]
    if name.startswith(("op11", "op12")):  # nodes and phrases have no row of their own in the table
        assert df.count() > 0
        return
    table, key = ("pages", "page_id") if name.startswith("op5") else ("documents", "doc_id")
    ids = sorted(r[0] for r in df.select(key).collect())
    whole = sorted(r[0] for r in spark.read.parquet(f"{ROOT}/{table}.parquet").select(key).collect())
    assert ids == whole if not name.startswith(("op7", "op10")) else set(ids) < set(whole)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{ROOT}/{table}.parquet'")
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(map(str, r)) for r in found.fetchall())
    df = queries.QUERIES[name](spark, ROOT).select(names)
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want
