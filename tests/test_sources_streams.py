import json

from pyspark.sql import functions as F

from attesta.operators.metrics import auroc, d_from_moments, histogram, moments
from attesta.sources import io as IO
from attesta.streaming import live as S

C = F.col


def test_note_tables_from_file_names(spark, tmp_path):
    folder = tmp_path / "cfg" / "test1" / "sentences"
    folder.mkdir(parents=True)
    (folder / "sample_003_note_02_sentences.csv").write_text('sentence_idx,sentence,uncertainty\n0,"He said ""yes"",\nthen left",0.25\n1,,1.0\n')
    (folder / "other_sentences.csv").write_text("sentence_idx,sentence,uncertainty\n0,x,0.5\n")
    rows = IO.read_note_tables(spark, str(folder / "*.csv"), IO.SENTENCE_SCORE).orderBy("sentence_idx").collect()
    assert [(r["config"], r["split"], r["sample_idx"], r["note_idx"]) for r in rows] == [("cfg", "test1", 3, 2)] * 2
    assert rows[0]["sentence"] == 'He said "yes",\nthen left' and rows[1]["sentence"] is None


def test_generation_documents(spark, tmp_path):
    folder = tmp_path / "cfg" / "test2" / "generations"
    folder.mkdir(parents=True)
    (folder / "sample_000_generations.json").write_text(json.dumps({"sample_idx": 0, "transcript": "t", "gold_note": "g", "notes": ["a", "b"], "K": 2}, indent=1))
    rows = IO.read_generations(spark, str(folder / "*.json")).orderBy("note_idx").collect()
    assert [(r["split"], r["note_idx"], r["note"]) for r in rows] == [("test2", 0, "a"), ("test2", 1, "b")]


def test_annotation_layouts(spark, tmp_path):
    labels = {"0": "Faithful", "1": "Negation", "2": {"type": "Faithful", "severity": "Minor"}, "3": {"faithful": "Not Faithful", "type": "Causality", "severity": "Major"}}
    (tmp_path / "sample_001_note_00_rater_one.json").write_text(json.dumps({"token_spans": [], "sentence_labels": labels, "note_html": ""}))
    rows = {r["idx"]: r for r in IO.read_annotations(spark, str(tmp_path / "*.json")).collect()}
    assert [(rows[i]["faithful"], rows[i]["type"], rows[i]["severity"]) for i in range(4)] == [
        ("Faithful", None, "N/A"), ("Not Faithful", "Negation", "N/A"), ("Faithful", None, "2"), ("Not Faithful", "Causality", "4")]
    assert rows[0]["rater"] == "rater_one"


def test_available_stops_at_the_first_gap(spark):
    a = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 1)], "s long, n long")
    b = spark.createDataFrame([(1, 1), (1, 3), (2, 1)], "s long, n long")
    assert [tuple(r) for r in IO.available(a, b, "s", "n", 0, 10).collect()] == [(1, 1)]


def test_results_by_split(spark, tmp_path):
    df = spark.createDataFrame([("cfg", "test1", 1), ("other", "test1", 2)], "config string, split string, v int")
    IO.write_results(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).filter("config = 'cfg'").collect()
    assert [r["v"] for r in back] == [1]


def test_first_present_alias(spark):
    df = spark.createDataFrame([("", "gold", "x")], "tgt string, note string, src string")
    assert df.select(IO.resolve_column(df, ["tgt", "note"], False).alias("v")).collect()[0]["v"] == "gold"
    assert df.select(IO.resolve_column(df, ["tgt", "note"], True).alias("v")).collect()[0]["v"] == ""


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.range(400).select((C("id") % 3).alias("layer"), (C("id") % 2).alias("y"), (C("id") % 17).cast("double").alias("x"))
    rows.filter("x < 8").coalesce(1).write.mode("append").parquet(str(src))
    rows.filter("x >= 8").coalesce(1).write.mode("append").parquet(str(src))
    stream = S.file_stream(spark, str(src), "*.parquet", "layer bigint, y bigint, x double", files_per_batch=1)
    state = S.run_available(stream, S.moments_of(["layer"], "y", C("x")), ["layer"], str(tmp_path / "state"))
    got = sorted(map(tuple, d_from_moments(state, ["layer"]).collect()))
    want = sorted(map(tuple, d_from_moments(moments(rows, ["layer"], "y", C("x")), ["layer"]).collect()))
    assert got == want and len(list((tmp_path / "state" / "delta").glob("batch=*"))) == 2


def test_repeated_and_torn_batches_and_compaction(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "state")
    rows = spark.range(300).select((C("id") % 3).alias("layer"), (C("id") % 2).alias("y"), (C("id") % 17).cast("double").alias("x"))
    summary = S.moments_of(["layer"], "y", C("x"))

    def feed(low, high):
        rows.filter(C("x").between(low, high)).coalesce(1).write.mode("append").parquet(str(src))
        stream = S.file_stream(spark, str(src), "*.parquet", "layer bigint, y bigint, x double", files_per_batch=1)
        return S.run_available(stream, summary, ["layer"], out)

    def same(state, upto):
        want = moments(rows.filter(C("x") <= upto), ["layer"], "y", C("x"))
        assert sorted(map(tuple, state.select(want.columns).collect())) == sorted(map(tuple, want.collect()))

    same(feed(0, 4), 4)
    same(feed(5, 9), 9)
    # batch 1 again, and a third one that never finished
    summary(rows.filter(C("x").between(5, 9))).write.mode("overwrite").parquet(f"{out}/delta/batch=1")
    S.mark(spark, out, "done", 1)
    summary(rows).write.parquet(f"{out}/delta/batch=7")
    same(S.state(spark, ["layer"], out), 9)
    S.compact(spark, ["layer"], out)
    same(S.state(spark, ["layer"], out), 9)
    same(feed(10, 16), 16)


def test_running_auroc_is_exact(spark, tmp_path):
    """Unrounded scores over three batches, one repeated and one torn: the same as one batch over all."""
    src, out = tmp_path / "in", str(tmp_path / "state")
    rows = spark.range(600).select((C("id") % 3).alias("layer"), (C("id") % 2).alias("y"), F.when(C("id") % 50 != 0, F.sin(C("id") * 7) / 3).alias("x"), (C("id") % 3).alias("part"))
    summary = S.histogram_of(["layer"], "y", C("x"))
    for part in range(3):
        rows.filter(C("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(src))
        stream = S.file_stream(spark, str(src), "*.parquet", "layer bigint, y bigint, x double", files_per_batch=1)
        S.run_available(stream, summary, ["layer", "score"], out)
    summary(rows.filter("part = 1")).write.mode("overwrite").parquet(f"{out}/delta/batch=1")
    S.mark(spark, out, "done", 1)
    summary(rows).write.parquet(f"{out}/delta/batch=9")
    got = auroc(S.state(spark, ["layer", "score"], out), ["layer"])
    want = auroc(histogram(rows, ["layer"], "y", "x"), ["layer"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3


def test_notes_are_written_once_listed_and_resumed(spark, tmp_path):
    folder = str(tmp_path / "notes")
    assert IO.written_notes(spark, folder).collect() == [] and IO.read_notes(spark, folder, IO.SENTENCE_SCORE).collect() == []
    rows = spark.createDataFrame([("c", "t", s, n, i, f'say "{i}",\nthen', i / 4) for s in range(3) for n in range(2) for i in range(2)],
                                 "config string, split string, sample_idx int, note_idx int, sentence_idx int, sentence string, uncertainty double")
    IO.write_notes(rows.filter("sample_idx < 2"), folder, "sentences")
    done = IO.written_notes(spark, folder)
    assert {(r["sample_idx"], r["note_idx"]) for r in done.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    IO.write_notes(rows.join(done, ["config", "split", "sample_idx", "note_idx"], "left_anti").unionByName(rows.filter("sample_idx = 0")), folder, "sentences")
    back = IO.read_notes(spark, folder, IO.SENTENCE_SCORE).select(rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert IO.existing(spark, [folder, folder + "-none"]) == [folder]
