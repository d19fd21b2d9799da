"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import table


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and the labels of its blocks."""
    from ledgerloom.llm.html_blocks import extract_text, train

    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, train(pages))


def op2_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass the compression bands, with their ratios."""
    from ledgerloom.llm.compression_rules import compression_metrics

    return compression_metrics(table(spark, sf_dir, "documents")).where("keep").drop("keep", "reason")


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to exactly its text."""
    from ledgerloom.llm.bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens."""
    from ledgerloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training windows of 2,048 tokens over all documents."""
    from ledgerloom.llm.packing import pack_windows

    return pack_windows(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the network, fitted to the labels, takes for good, with their probability."""
    from ledgerloom.llm.byte_cnn import KEEP, quality_scores, train

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels"))).where(f"probability >= {KEEP}")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a group of near duplicates, with the smallest id of its group, which is the one that stays."""
    from ledgerloom.llm.probminhash import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents"))


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, in shards that are wavelet matrices."""
    from ledgerloom.llm.wavelet import wavelet_shards

    return wavelet_shards(table(spark, sf_dir, "documents"))


def op7_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document."""
    from ledgerloom.llm.secret_novelty import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other vectors, of every vector whose id is divisible by 100."""
    from ledgerloom.llm.kdtree_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_blocks, op2_compression_rules, op3_bpe_encode, op8_token_counts, op9_pack_windows, op10_quality_classifier, op6_near_duplicates, op5_wavelet_shards, op7_secret_novelty, op4_kdtree_topk)}


def oracle_sql() -> dict[str, str]:
    from ledgerloom.llm.kdtree_topk import TOP_K_SQL

    return {"op4_kdtree_topk": TOP_K_SQL}
