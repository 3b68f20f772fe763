"""From raw documents to packed training sequences: five stages, each written and read again by the next.

quality rules, language ID, near-duplicate groups, repeated passages, packing. Every stage but the last returns the columns
of its input; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.llm import jaccard_join, language_id, packing, quality_rules, suffix_dedup
from stayline.llm.queries import held_out
from stayline.llm.shared import written

LEAST_SCORE = 0.4
CAPACITY = 2048
END_ID = 0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _only(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("`" + name.replace("`", "``") + "`") for name in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learned(quality_rules.labelled(docs.select("doc_id", "text"), labels))
    # The statistics go into columns of their own, whatever the documents' columns are called.
    judged = quality_rules.judged(docs.select(F.struct("*").alias("document"), "text"), rules)
    return judged.where("kept").select("document.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell."""
    network = language_id.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = language_id.identified(docs.select(F.struct("*").alias("document"), "text"), network)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(
        "document.*"
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    return jaccard_join.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place keeps; n_chars follows the text."""
    cleaned = suffix_dedup.cleaned(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _only(cleaned, docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document and their places in sequences."""
    pieces = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)
    rows = pieces.select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32")
    )
    return packing.pack(rows, CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]

# Learned rules, a trained network and a genetic algorithm have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
