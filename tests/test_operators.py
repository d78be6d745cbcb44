import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators import dedupe as D
from attesta.operators import labels as L
from attesta.operators import match as MA
from attesta.operators import metrics as M
from attesta.operators import pools as P
from attesta.operators import report as R
from attesta.operators import sample as X
from attesta.operators import segments as G
from attesta.operators import vectors as V
from attesta.operators.ordered import carry_last, running_sums, with_position

C = F.col


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows."""
    rnd = random.Random(1)
    return spark.createDataFrame([("hot" if i % 5 else f"g{i % 3}", i, rnd.randint(-5, 9), i % 7 == 0) for i in range(2000)],
                                 "g string, i long, v long, flag boolean").cache()


def test_running_sums_equal_a_window(skewed):
    got = running_sums(skewed, ["g"], ["i"], {"s": C("v")}, F.floor(C("i") / 64))
    want = skewed.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy("i")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_carry_last_equals_a_window(skewed):
    value = F.when(C("flag"), C("v"))
    got = carry_last(skewed, ["g"], ["i"], value, "c")
    want = skewed.withColumn("c", F.last(value, ignorenulls=True).over(Window.partitionBy("g").orderBy("i")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_position_without_a_group(skewed):
    got = with_position(skewed, [], ["i"], F.floor(C("i") / 100)).select("i", "pos").collect()
    assert all(r["i"] == r["pos"] for r in got)


def test_low_runs_close_at_the_end(spark):
    vals = [1.0, 0.1, 0.1, 1.0, 0.05, 0.1, 0.1]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)], "g string, i long, v double")
    got = G.low_runs(df, ["g"], ["i"], "v", 0.2, 3).collect()
    assert [(r["start"], r["end"]) for r in got] == [(4, 7)]


def auroc(df):
    return M.auroc(M.histogram(df, [], "y", "s"), []).collect()[0]["auroc"]


def brute_auroc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auroc_ties_and_mirror(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), float(rnd.randint(-6, 6))) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert auroc(df) == pytest.approx(brute_auroc(rows))
    assert auroc(df.withColumn("s", -C("s"))) == pytest.approx(1 - brute_auroc(rows))


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    out = M.auroc(M.histogram(df, [], "y", "s"), []).collect()[0]
    assert out["auroc"] is None and out["n"] == 2
    assert M.average_precision(M.histogram(df, [], "y", "s"), []).collect()[0]["auprc"] is None


def test_average_precision(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.3), (0, 0.3)]
    df = spark.createDataFrame(rows, "y int, s double")
    want = (1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5)
    assert M.average_precision(M.histogram(df, [], "y", "s"), []).collect()[0]["auprc"] == pytest.approx(want)


def test_cohens_d_single_row_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.1), (0, 0.3)], "y int, x double")
    assert M.cohens_d(df, [], "y", "x").collect()[0]["d"] is None


def test_p_values(spark):
    df = spark.createDataFrame([(2.0, 10.0, 4.0, 2.0, 10.0)], "t double, dof double, f double, a double, b double")
    r = df.select(M.t_p_value(C("t"), C("dof")).alias("p"), M.f_p_value(C("f"), C("a"), C("b")).alias("q")).collect()[0]
    assert r["p"] == pytest.approx(0.0733880, abs=1e-6) and r["q"] == pytest.approx(0.0528283, abs=2e-4)


def test_top_fraction_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate([3, -5, 5, 5, None, 1, 2, 0, 1, 1])], "id long, s double")
    assert sorted(r["id"] for r in M.select_top_fraction(df, "id", "s", 0.2).collect()) == [1, 2]
    assert sorted(r["id"] for r in M.select_top_fraction(df, "id", "s", 0.2, keep_ties=True).collect()) == [1, 2, 3]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.25, 0.3, 1.0)], "x double")
    got = {r["bin"]: r["n"] for r in R.bucket_counts(df, C("x")).collect()}
    # 3 * 0.1 is above 0.3 as a double, so 0.3 stays in the third bin
    assert [got[i] for i in range(10)] == [2, 0, 2, 0, 0, 0, 0, 0, 0, 1]


def test_section_table(spark):
    df = spark.createDataFrame([("Plan", 0.0), ("Plan", 0.25), ("Plan", 1.0), ("Preamble", 0.5)], "section string, u double")
    got = {r["section"]: r for r in R.section_table(df, "section", "u").collect()}
    assert set(got) == {"Plan", "All"} and got["All"]["n"] == 3 and got["Plan"]["share_q4"] == pytest.approx(1 / 3)


VOTES = "item long, rater string, verdict string, type string"


def test_majority_resolutions(spark):
    f, b = "Faithful", "Not Faithful"
    rows = [(1, "a", f, None), (1, "b", b, "Negation"), (2, "a", f, None), (2, "b", b, "Negation"), (3, "a", b, "Causality"),
            (3, "b", b, "Negation"), (3, "c", f, None), (4, "a", f, None), (5, "a", f, None), (5, "b", f, None)]
    got = {r["item"]: r for r in L.majority(spark.createDataFrame(rows, VOTES), spark.createDataFrame([(1, b)], "item long, agreed string"), "item").collect()}
    assert [got[i]["resolution"] for i in range(1, 6)] == ["consensus_file", "unresolved_tie", "majority", "single_annotator", "unanimous"]
    assert got[1]["verdict"] == b and got[2]["verdict"] is None and got[3]["error_type"] == "Causality"


def test_identical_raters_agree_fully(spark):
    rows = [(i, r, "x" if i % 3 else "y") for i in range(12) for r in ("a", "b", "c")]
    v = spark.createDataFrame(rows, "item long, rater string, label string")
    assert all(r["kappa"] == pytest.approx(1) for r in L.cohen_kappa(L.rater_pairs(v, "item", "label"), ["rater_a", "rater_b"]).collect())
    assert L.fleiss_kappa(v, "item", "label", 3).collect()[0]["kappa"] == pytest.approx(1)
    assert L.krippendorff_alpha(v, "item", "label").collect()[0]["alpha"] == pytest.approx(1)


def test_incomplete_items(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "x"), (2, "b", "y")]
    v = spark.createDataFrame(rows, "item long, rater string, label string")
    fleiss = L.fleiss_kappa(v, "item", "label", 3).collect()[0]
    assert (fleiss["n_used"], fleiss["n_total"]) == (1, 2)
    assert L.krippendorff_alpha(v, "item", "label").collect()[0]["n_ratings"] == 5


def test_greedy_keep_is_the_sequential_result(spark):
    rnd = random.Random(7)
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60) if rnd.random() < 0.08]
    kept, dropped = [], set()
    for i in range(60):
        if i not in dropped:
            kept.append(i)
            dropped |= {b for a, b in edges if a == i}
    nodes = spark.range(60)
    got = D.greedy_keep(nodes, spark.createDataFrame(edges, "before long, after long"), "id")
    assert sorted(r["id"] for r in got.collect()) == kept
    chain = spark.createDataFrame([(0, 1), (1, 2)], "before long, after long")
    assert sorted(r["id"] for r in D.greedy_keep(spark.range(3), chain, "id").collect()) == [0, 2]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["id"]: r["component"] for r in D.components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


def test_span_resolution(spark):
    spans = [(0, 5, 0, 0.1), (3, 12, 1, 0.5), (11, 13, 2, 0.9), (20, 22, 3, 0.2)]
    df = spark.createDataFrame([([dict(start=a, end=b, id=i, score=s) for a, b, i, s in spans],)], f"spans array<{D.SPAN}>")
    placed = df.select(D.longest_first(C("spans")).alias("p"), D.higher_score(C("spans")).alias("h")).collect()[0]
    assert [p["id"] for p in placed["p"]] == [1, 3] and [p["id"] for p in placed["h"]] == [2, 3]


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 8)).astype("float32")
    x[1] = x[0]
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)], "id long, block int, vec array<float>")
    old, V.CHUNK = V.CHUNK, 16
    try:
        pairs = {(r["q_id"], r["c_id"]) for r in V.similar_pairs(df, "block", "id", "vec", 0.6).collect()}
        top = {(r["q_id"], r["rank"]): r["c_id"] for r in V.top_k_cosine(df.filter("id < 20"), df.filter("id >= 20"), "block", "id", "id", "vec", 3).collect()}
    finally:
        V.CHUNK = old
    n = x.astype("float64") / np.linalg.norm(x, axis=1, keepdims=True)
    cos = n @ n.T
    assert pairs == {(i, j) for i in range(80) for j in range(i + 1, 80) if (i - j) % 2 == 0 and cos[i, j] >= 0.6}
    for q in range(20):
        cand = [j for j in range(20, 80) if (j - q) % 2 == 0]
        assert [top[q, r] for r in (1, 2, 3)] == sorted(cand, key=lambda j: -cos[q, j])[:3]


def test_pools_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(15)]
    notes = {(s, n): {k: [rnd.sample(vocab, 4) for _ in range(2)] for k in (["list", "all"] if rnd.random() < 0.6 else ["all"])} for s in range(2) for n in range(70)}
    ndf = spark.createDataFrame([(s, n, v) for (s, n), v in notes.items()], "sample long, note long, sections map<string,array<array<string>>>")
    claims = [(s, n, "list", rnd.sample(vocab, 3)) for s in range(2) for n in range(0, 70, 9)]
    cdf = spark.createDataFrame(claims, "sample long, note long, section string, words array<string>")
    got = {(r["sample"], r["note"]): (r["support_sum"], r["n_compared"]) for r in P.pair_support(cdf, ndf, "sample", "note", "section").collect()}

    def cover(c, w):
        return len(set(c) & set(w)) / len(c)

    for s, n, sec, words in claims:
        want = sum(max(cover(words, w) for w in v.get(sec, v["all"])) for (a, b), v in notes.items() if a == s and b != n)
        assert got[s, n][0] == pytest.approx(want) and got[s, n][1] == 69


def test_single_note_has_no_comparison(spark):
    ndf = spark.createDataFrame([(1, 0, {"all": [["a"]]})], "sample long, note long, sections map<string,array<array<string>>>")
    cdf = spark.createDataFrame([(1, 0, "list", ["a"])], "sample long, note long, section string, words array<string>")
    assert P.pair_support(cdf, ndf, "sample", "note", "section").collect()[0]["n_compared"] == 0


def test_fallback_only_for_weak_claims(spark):
    secs = "sample long, note long, sections map<string,array<array<string>>>"
    ndf = spark.createDataFrame([(1, 0, {"p": [["z"]]}), (1, 1, {"p": [["a", "b"]], "q": [["a", "b", "c", "d"]]}), (1, 2, {"q": [["a"]]}), (1, 3, {})], secs)
    cdf = spark.createDataFrame([(1, 0, "p", ["a", "b", "c", "d"])], "sample long, note long, section string, words array<string>")
    r = P.fallback_support(cdf, ndf, "sample", "note", "section", 0.5).collect()[0]
    assert r["support_sum"] == pytest.approx(0.5 + 0.25) and r["n_compared"] == 2


def test_label_words_last_span_wins(spark):
    words = [dict(start=0, end=4, text="aaaa"), dict(start=5, end=9, text="bbbb"), dict(start=300, end=304, text="cccc")]
    spans = [dict(start=0, end=7, category="x"), dict(start=3, end=8, category="y"), dict(start=290, end=301, category="z")]
    df = spark.createDataFrame([(words, spans)], "w array<struct<start:int,end:int,text:string>>, s array<struct<start:int,end:int,category:string>>")
    got = df.select(MA.label_words(C("w"), C("s"), "Faithful").alias("r")).collect()[0]["r"]
    assert [r["category"] for r in got] == ["y", "y", "z"]


def test_best_fact_match_prefers_the_numbered_sentence(spark):
    facts = spark.createDataFrame([(1, 0, "he had pulse 72 today", "objective"), (1, 1, "zzz", "plan")], "n long, fact_idx long, fact string, section string")
    sents = spark.createDataFrame([(1, 0, "Objective:", "objective"), (1, 1, "The pulse is 72 bpm.", "objective"), (1, 2, "pulse unknown.", "objective")],
                                  "n long, sent_idx long, sentence string, section string")
    got = {r["fact_idx"]: r for r in MA.best_fact_match(facts, sents, ["n"], "fact", "sentence", "section").collect()}
    assert got[0]["match_idx"] == 1 and got[0]["matched_by"] == "number" and got[1]["match_idx"] is None and not got[1]["clean_match"]


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i % 10}", int(i % 10 < 6 and i % 2)) for i in range(200)], "g string, y int")
    folds = X.group_folds(df, "g", "y", 4, "s").collect()
    assert len(folds) == 10 and {r["fold"] for r in folds} <= {0, 1, 2, 3}


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, i % 3, int(i % 5 == 0)) for i in range(90)] + [(1000, 9, 1)], "id long, g long, y int")
    counts = {(r["g"], r["y"]): r["count"] for r in X.sample_balanced(df, "g", "y", "id", 4, "s").groupBy("g", "y").count().collect()}
    assert counts == {(g, y): 4 for g in range(3) for y in (0, 1)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=400), np.zeros(100), rng.normal(size=3) * 1e6])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0)], "g string, x double")
    got = {r["g"]: r["q"] for r in M.exact_quantiles(df, ["g"], "x", [0.0, 0.1, 0.5, 0.975, 1.0]).collect()}
    assert got["a"] == pytest.approx(list(np.quantile(x, [0.0, 0.1, 0.5, 0.975, 1.0]))) and got["b"] == [2.0] * 5


def test_value_buckets_follow_the_order_and_spread_near_one(spark):
    from attesta.operators.ordered import value_bucket
    values = sorted([0.0, 1e-300, 1e-9, 0.25, 0.4999999, 0.5, 0.50001, 0.75, 1.0, 1.0000001, 2.0, 1e9] + [1 - 2.0**-k for k in range(2, 50)])
    values = sorted({-v for v in values} | set(values))
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(value_bucket(F.col("v")).alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) > 100


def test_quadrants_of_few_groups_are_not_dealt_out_by_group(spark):
    from attesta.operators import metrics, score
    rows = spark.range(4000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    got = score.quadrants(rows, ["g"], "a", "b")
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and got.count() == 4000
    many = metrics.with_groups(rows, rows.groupBy("g").agg(F.max("a").alias("m")), ["g"], most=1)
    assert many.count() == 4000 and many.filter("m = 6").count() == 4000
