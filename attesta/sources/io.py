"""Sources and sinks: generation documents, note tables, annotations, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

GENERATION = ("sample_idx int, orig_row_idx int, encounter_id string, transcript_version string, transcript string, "
              "gold_note string, notes array<string>, model string, K int, temperature double")
SENTENCE_SCORE = "sentence_idx int, sentence string, uncertainty double"
FACT_SCORE = "fact_idx int, section string, fact string, uncertainty double"
SPAN_JUDGE = "sentence_idx int, sentence string, label string, note_span string"
SAMPLE_FILE = "sample_(\\d+)_"
NOTE_FILE = "sample_(\\d+)_note_(\\d+)_"


def with_split(df: DataFrame, path: Column) -> DataFrame:
    """config and split from the directory: .../<config>/<split>/<kind>/<file>."""
    parts = F.regexp_extract(path, "([^/]+)/([^/]+)/[^/]+/[^/]+$", 1), F.regexp_extract(path, "([^/]+)/([^/]+)/[^/]+/[^/]+$", 2)
    return df.withColumn("config", parts[0]).withColumn("split", parts[1])


def explode_notes(docs: DataFrame) -> DataFrame:
    """One row per note of a generation document; the index is the position."""
    rest = [c for c in docs.columns if c != "notes"]
    return docs.select(*rest, F.posexplode("notes").alias("note_idx", "note"))


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """(config, split, sample_idx, note_idx, note, ...) from JSON documents."""
    docs = spark.read.schema(GENERATION).option("multiLine", True).json(path)
    return explode_notes(with_split(docs.select("*"), F.input_file_name()))


def file_keys(df: DataFrame, path: Column) -> DataFrame:
    """Sample and note number from the file name; other files are left out."""
    keyed = df.withColumn("sample_idx", F.regexp_extract(path, NOTE_FILE, 1).try_cast("int")) \
        .withColumn("note_idx", F.regexp_extract(path, NOTE_FILE, 2).try_cast("int"))
    return keyed.filter(F.col("sample_idx").isNotNull() & F.col("note_idx").isNotNull())


def read_note_tables(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All per-note CSV files of a glob at once, empty cells as NULL."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True) \
        .option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(glob)
    named = rows.withColumn("_path", F.col("_metadata.file_path"))
    return with_split(file_keys(named, F.col("_path")), F.col("_path")).drop("_path")


def union_splits(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of all splits; of equal keys the first file wins."""
    rest = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(rest, F.struct(*order)).alias("_r")) \
        .select("_r.*").select(*df.columns)


def resolve_column(df: DataFrame, aliases: list[str], allow_empty: bool) -> Column:
    """First alias that is present; or the first that is present and not blank."""
    present = [a for a in aliases if a in df.columns]
    if not present:
        raise ValueError(f"none of the columns {aliases} is present")
    if allow_empty:
        return F.col(present[0])
    return F.coalesce(*[F.nullif(T.strip(F.col(a).cast("string")), F.lit("")) for a in present])


def rater_name(name: Column) -> Column:
    clean = F.left(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]", "_"), F.lit(32))
    return F.when(clean == "", F.lit("annotator")).otherwise(clean)


def annotation_labels(labels: Column) -> Column:
    """array<struct<idx,faithful,type,severity>> of a JSON map of sentence labels.

    Older layouts are a bare string, or an object whose type may be 'Faithful'.
    """
    entries = F.map_entries(F.from_json(labels, "map<string,string>"))

    def migrated(e):
        obj = F.from_json(e["value"], "faithful string, type string, severity string")
        bare = ~F.trim(e["value"]).startswith("{")
        has_verdict = F.contains(e["value"], F.lit('"faithful"'))
        old = F.when(bare, e["value"]).otherwise(obj["type"])
        known = old.isin(K.ERROR_TYPES)
        verdict = F.when(old == "Faithful", "Faithful").when(known, "Not Faithful")
        given = F.coalesce(obj["severity"], F.lit("N/A"))
        severity = F.when(bare, "N/A").when(given == "Major", "4").when(given == "Minor", "2").otherwise(given)
        return F.struct(
            e["key"].try_cast("bigint").alias("idx"),
            F.when(~bare & has_verdict, obj["faithful"]).otherwise(verdict).alias("faithful"),
            F.when(~bare & has_verdict, obj["type"]).otherwise(F.when(known, old)).alias("type"), severity.alias("severity"))

    return F.transform(entries, migrated)


def read_annotations(spark: SparkSession, glob: str) -> DataFrame:
    """(sample_idx, note_idx, rater, idx, faithful, type, severity)."""
    files = spark.read.option("wholetext", True).text(glob).withColumn("_path", F.input_file_name())
    keyed = file_keys(files, F.col("_path"))
    rater = F.regexp_extract("_path", "sample_\\d+_note_\\d+_(.*)\\.json$", 1)
    labels = F.get_json_object("value", "$.sentence_labels")
    return keyed.select("sample_idx", "note_idx", rater.alias("rater"), F.inline(annotation_labels(labels)))


def contiguous(notes: DataFrame, sample: str, note: str) -> DataFrame:
    """Notes of the unbroken prefix 0..n of each sample.

    A note belongs to it if it lies before the first missing number, and the
    first missing number is the smallest n + 1 that has no row.
    """
    present = notes.select(sample, note).distinct()
    candidates = present.select(sample, (F.col(note) + 1).alias(note)).unionByName(
        present.select(sample).distinct().withColumn(note, F.lit(0).cast("bigint")))
    gap = candidates.join(present, [sample, note], "left_anti").groupBy(sample).agg(F.min(note).alias("_gap"))
    return notes.join(gap, sample).filter(F.col(note) < F.col("_gap")).drop("_gap")


def available(a: DataFrame, b: DataFrame, sample: str, note: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Keys of the contiguous notes of ``a`` that ``b`` holds too; samples start <= key < end where given."""
    inside = a if start is None else a.filter(F.col(sample) >= start)
    inside = inside if end is None else inside.filter(F.col(sample) < end)
    return contiguous(inside, sample, note).join(b.select(sample, note), [sample, note], "left_semi")


def pending(inputs: DataFrame, done: DataFrame, key: str, expected: str) -> DataFrame:
    """Inputs whose finished notes are fewer than expected."""
    counts = done.groupBy(key).agg(F.count(F.lit(1)).alias("_done"))
    return inputs.join(counts, key, "left").filter(F.coalesce("_done", F.lit(0)) < F.col(expected)).drop("_done")


def status_table(requested: DataFrame, generated: DataFrame, key: str, least: int) -> DataFrame:
    """ok / no_generations / insufficient_generations for every requested sample."""
    counts = generated.groupBy(key).agg(F.count(F.lit(1)).alias("n_notes"))
    n = F.coalesce("n_notes", F.lit(0))
    return requested.join(counts, key, "left").withColumn("n_notes", n).withColumn(
        "status", F.when(F.col("n_notes") == 0, "no_generations").when(F.col("n_notes") < least, "insufficient_generations").otherwise("ok"))


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Results by config and split.  One file per task; no driver pass."""
    df.write.mode(mode).partitionBy("config", "split").parquet(path)


def existing(spark: SparkSession, folders: list[str]) -> list[str]:
    """Those of the folders (or globs) that are there, by the file system they name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        hits = path.getFileSystem(conf).globStatus(path)
        if hits is not None and len(hits):
            found.append(folder)
    return found


def write_notes(df: DataFrame, folder: str, kind: str, sample: str = "sample_idx", note: str = "note_idx") -> None:
    """Rows of notes by config, split and note, the note's name as ``sample_003_note_02_<kind>``.

    Writing again replaces the notes at hand and leaves all others, so that a
    repeated or resumed run ends in the same files.
    """
    name = F.concat(F.lit("sample_"), F.lpad(F.col(sample).cast("string"), 3, "0"), F.lit("_note_"), F.lpad(F.col(note).cast("string"), 2, "0"), F.lit(f"_{kind}"))
    df.withColumn("file", name).drop(sample, note).repartition("config", "split", "file").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").option("header", True).option("escape", '"').partitionBy("config", "split", "file").csv(folder)


def written_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(config, split, sample_idx, note_idx) of the notes that are there, from file names alone; none where the folder is missing."""
    if not existing(spark, [f"{folder}/config=*"]):
        return spark.createDataFrame([], "config string, split string, sample_idx int, note_idx int")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder).select("path")
    named = file_keys(files, F.col("path")).select(F.regexp_extract("path", "/config=([^/]*)/", 1).alias("config"),
                                                   F.regexp_extract("path", "/split=([^/]*)/", 1).alias("split"), "sample_idx", "note_idx")
    return named.distinct()


def read_notes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of all notes of a folder of ``write_notes``, with config, split, sample and note; no rows where it is missing."""
    columns = f"{schema}, config string, split string, file string"
    if not existing(spark, [f"{folder}/config=*"]):
        return file_keys(spark.createDataFrame([], columns), F.col("file")).drop("file")
    rows = spark.read.schema(columns).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(folder)
    return file_keys(rows, F.col("file")).drop("file")


def scope(df: DataFrame, sample: str, note: str, start: int, end: int, k: int) -> DataFrame:
    """Samples in [start, end) and their first k notes."""
    return df.filter(F.col(sample).between(start, end - 1) & (F.col(note) < k))


def cap_notes(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """At most n rows in a total order."""
    return df.orderBy(*order).limit(n)

