"""Corpus preparation: language ID, near-duplicate removal, benchmark decontamination, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; its result is written as Parquet and reread as
the next stage's ``docs``. All but the last return the columns they were given. The last returns the packing
plan: (doc_id, piece, start, size, bin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm import decontaminate, language_id, near_dedup, packing, secret_scan
from kinetrace.llm.textkernel import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language known from the labels (or have no letters)."""
    return language_id.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near and exact copies."""
    return near_dedup.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secret literals; keeps every document."""
    return secret_scan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document (or its pieces) in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Packing is sequential and signatures are hashes: SQL cannot express run(); it is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over the whole documents table; stages meet in the shared checkpoint folder."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        if done:
            _drop(spark, done)  # its successor is written and reread: nothing depends on it any more
        docs, done = spark.read.parquet(out), out
    return docs


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
