"""A corpus from language ID to token ids, each stage over everything that the stage before it kept.

Stages write Parquet to the shared folder of spark.checkpoint.dir and read it again, so a lost executor repeats a stage at
most. ``ORACLE_SQL`` is None: language profiles and BPE merges are beyond SQL; tests compare a run with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm import bpe, langid, line_dedup, mixture, simhash
from marginlens.llm.common import small_batches, table

ORACLE_SQL = None
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles tell; the others go."""
    small_batches(spark)
    return langid.accepted(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of passages; a document of which nothing is left goes. n_chars follows the text."""
    cleaned = line_dedup.without_repeats(docs)
    left = cleaned.filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints of three-word shingles within two bits."""
    small_batches(spark)
    return simhash.first_of_each(docs, words=3)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to two times."""
    return mixture.mixed(docs)


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to."""
    small_batches(spark)
    return bpe.round_trip(docs, VOCABULARY)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", near_deduplication),
    ("source mixing", source_mixing),
    ("BPE", tokenisation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
