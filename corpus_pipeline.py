"""From raw documents to a training mix: five stages over the corpus operators of quern.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import op2_minhash, op5_quality, op6_seeds, op7_mix, op10_lines
from quern.llm.common import remove, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from labels outside the held-out fifth. Null and empty texts get the score of no features; without labels all stay or go by the prior."""
    return op5_quality.accept(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go from the texts; no document goes, one that loses all keeps an empty text. Null texts stay null; rows that share an id but not the text are places of their own."""
    return op10_lines.line_dedup(docs, runs=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more. Null and wordless texts stay; of rows without an id those go that are like one with an id."""
    return op2_minhash.drop_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go, by their own text, with or without an id; null and empty texts stay."""
    return op6_seeds.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return op7_mix.mixed(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", decontaminate), ("mix", mix)]

#: The stages hash, draw and iterate in ways that SQL cannot say; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written to the shared folder and read by the next, then removed.

    Stages take nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns as their
    operators state; the last stage's rows stay in the shared folder, for the result reads them."""
    docs, top = _table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
        if k:
            remove(spark, f"{top}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
