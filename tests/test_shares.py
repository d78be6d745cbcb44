"""Pooled n-gram shares: a bitmap that lets everything or little pass gives the same."""

import pytest

from attesta.operators import segments as G


def made(spark):
    texts = ["the quick brown fox jumps over it", "a b c", "", None, "unseen words only here now", "the quick brown fox"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, "jumps over it again")], "k long, t string")
    gold = spark.createDataFrame([("THE quick brown fox",), ("fox jumps over",), (None,)], "text string")
    return docs, gold


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_share_and_uncovered(spark, monkeypatch, bits):
    plain = G.gram_filter
    monkeypatch.setattr(G, "gram_filter", lambda known: plain(known, bits))
    docs, gold = made(spark)
    share = {r["k"]: (r["n_grams"], r["n_found"]) for r in G.ngram_share(docs, gold, "k", "t", 3).collect()}
    assert share == {0: (5, 3), 1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (3, 0), 5: (4, 2)}
    left = {r["k"]: r["n_uncovered"] for r in G.uncovered_tokens(docs.filter("k < 5"), gold, "k", "t", 3).collect()}
    assert left[0] == 1 and left[1] == 3 and left[4] == 5


def test_unrelated_grams_do_not_pass(spark):
    known = spark.range(500).selectExpr("concat('known ', id) as gram")
    bits, size = G.gram_filter(known)
    others = G.with_scalar(spark.range(4000).selectExpr("concat('other ', id) as gram"), bits)
    assert others.filter(G.may_be_known(G.F.col("gram"), G.F.col("bits"), size)).count() < 600
    assert G.with_scalar(known, bits).filter(~G.may_be_known(G.F.col("gram"), G.F.col("bits"), size)).isEmpty()
