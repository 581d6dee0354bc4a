"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, source mixing, token table.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns a DataFrame. ``run`` writes what a
stage returns as Parquet in the shared folder and reads it again as the next one's ``docs``. Empty tables give empty tables;
columns beside ``doc_id``, ``text`` and ``source`` are kept whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontaminate, pivotal_mix, simhash_pivot, token_table, toxicity
from threadloom.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. Null and empty texts are no toxic ones; without labels of both classes all
    documents stay. Repeated rows are judged alike."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id (null ids are the largest; of equal ids the smallest
    text hash, then the smallest other columns). Documents without words are one component."""
    return simhash_pivot.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of a benchmark item's shingles go. Null and empty texts hold none; an empty benchmark lets
    all pass."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words are taken not at all; null sources are one source; rows that
    agree in all columns share their copies."""
    return pivotal_mix.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the token table, read back from its files. Null and empty texts are the end id alone; repeated rows are rows."""
    return token_table.token_rows(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("token table", write_token_ids)]

#: A trained classifier and random rounding can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
