"""A training corpus from ``documents`` in five stages.

Every stage reads all that the one before it kept, from Parquet, and all but
the last return the columns of ``documents``:

1. toxicity: rows with an expected severity from 0.5 on go (model fitted on ``labels``);
2. exact dedup: of equal texts the row with the largest id stays;
3. near dedup: one row of each group of texts that share 80 % of their five-word shingles stays;
4. decontamination: rows that hold a passage of ``benchmark``, from 13 words on, go;
5. mixing: how many words of each row the mix of sources takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontaminate, exact_dedup, mixing, near_dedup, toxicity
from attesta.sources.durable import shared_folder
from attesta.sources.tables import table


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, size=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), words=13)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_near_copy),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix),
]

#: The first stage is a trained model, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
