"""Registered queries of the text operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import scratch
from .shared import written
from . import byte_bpe, collocations, elias_fano, exact_dedup, exact_topk, jaccard_join, language_id, oracle, packing, periodic_runs, quality_rules, suffix_dedup, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token and pre-token counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_tokens", "n_pretokens")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat, by document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.spans(docs).select(
        "doc_id", "span", "first_word", "end_word", "removed_words", "source_id"
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by merge replay, and the bytes they decode to, as digests."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(docs, *vocabulary).select("doc_id", "ids")
    return byte_bpe.decode(encoded, *vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    vectors = exact_topk.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    best = exact_topk.top_k(vectors, vectors.where("id % 100 = 0"), 10)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rule, and the learned list's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learned(quality_rules.labelled(docs, table(spark, sf_dir, "labels")))
    return quality_rules.judged(docs, rules).select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = scratch.path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    # Written without payloads: archives are parsed once for every use of their records.
    records = written(
        warc.read(spark, path).select(
            "page_id", F.length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
        ),
        "records",
    )
    responses = records.where("record_type = 'response'")
    sizes = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest", "left")
    return responses.unionByName(revisits)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language_id.fit(docs.where(~held_out()))
    return language_id.identified(docs.select("doc_id", "text"), network).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 2048."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)
    rows = pieces.select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32")
    )
    return packing.pack(rows, 2048)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similar_groups(docs).select("doc_id", "n_shingles", "component_id")


def op10_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written in ascending doc_id order and read back."""
    path = scratch.path(spark, "tokens")
    elias_fano.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return elias_fano.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts: the row that stays, the group's size and the text's digest, for every row."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to four words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), 2000)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, every tenth of them made to loop."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.zip_with(
        F.arrays_zip("starts", "lengths"), "periods", lambda run, period: F.concat_ws(",", run["starts"], run["lengths"], period)
    )
    return periodic_runs.periodic_runs(docs, periodic_runs.looped).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_topk": op4_exact_topk,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_elias_fano": op10_elias_fano,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.STATEMENTS)
