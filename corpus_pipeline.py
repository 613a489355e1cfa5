"""The corpus pipeline: each stage reads what the stage before it kept, written as Parquet and read again.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``: the quality classifier drops what it
rejects, near-dedup keeps the least doc_id of each group, substring dedup takes repeated passages out of texts,
decontamination drops documents that hold benchmark questions. The last gives each document's pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import decontamination, near_dup, passages, quality, sentencepiece_codec
from fieldweave.llm.workspace import stored


def _only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id the verdicts (doc_id, kept; one for each row) do not drop. A null doc_id stays.

    What goes is the smaller side as a rule; rows of one doc_id share a fate: one kept text keeps it.
    """
    gone = verdicts.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, quality.assess(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, near_dup.near_duplicates(docs)).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.cut(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
