"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names, or 'all' (default: the headline list)
BENCH_DUCKDB   seconds that DuckDB may take for each query's SQL on the same
               cores; its times are printed beside (default: not measured)
"""

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attesta.plans import catalogue  # noqa: E402
from attesta.session import session  # noqa: E402

HEADLINE = [
    "split_sentences_t2", "header_sections_t7", "fill_sections_t11", "content_type_t18", "ngram_share_t21",
    "turn_windows_w3", "low_runs_w5", "longest_run_w6", "pair_support_p3", "max_support_p5", "match_by_text_p6",
    "label_words_p12", "top_k_cosine_p13", "sentence_uncertainty_u2", "js_divergence_u14", "overlap_metrics_u18",
    "dedupe_first_d1", "components_d5", "strict_labels_j3", "majority_j7", "cohen_kappa_five_a1", "metrics_by_dataset_m3",
    "auroc_by_layer_m4", "cohens_d_moments_m7", "select_top_fraction_m8", "cluster_bootstrap_m17", "rate_by_decile_m18",
    "section_table_g1", "cost_rollup_g11", "sample_balanced_x1", "stream_moments_q1",
]


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duckdb_seconds(root, names, most):
    """Time of each query's SQL; None where it was stopped after ``most`` seconds."""
    import duckdb
    con = duckdb.connect(config={"threads": int(os.environ.get("BENCH_CPUS", "8"))})
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    out = {}
    for name in names:
        if name not in catalogue.SQL:
            continue
        stop = threading.Timer(most, con.interrupt)
        stop.start()
        start = time.time()
        try:
            con.execute(catalogue.SQL[name]).fetchall()
            out[name] = round(time.time() - start, 3)
        except duckdb.InterruptException:
            out[name] = None
        finally:
            stop.cancel()
    return out


def main():
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalogue.QUERIES) if wanted == "all" else [w for w in wanted.split(",") if w] or HEADLINE
    spark = session("bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times, failed = {}, {}
    for name in names:
        start = time.time()
        try:
            catalogue.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as error:  # noqa: BLE001 - a failed query must not hide the others
            failed[name] = str(error)[:200]
        print(f"{name} {times.get(name, 'FAILED')}", file=sys.stderr, flush=True)
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(root.rstrip("/"))}
    if os.environ.get("BENCH_DUCKDB"):
        out["duckdb"] = duckdb_seconds(root, names, float(os.environ["BENCH_DUCKDB"]))
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
