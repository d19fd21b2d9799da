"""The corpus pipeline: from raw documents to training windows.

Five stages, each on all that the one before it kept: compression rules drop repetitive and incompressible documents, the
classifier drops those of low quality, of each group of near duplicates one document stays, secrets are replaced in the
text, and the rest is packed into windows.  A stage's result is written as Parquet into the shared folder and read
again, so that no stage depends on the lineage of another; it is deleted once the next one has been written, and the
last one, which the caller reads, stays with the application's checkpoints.

Defined results
---------------
* null, empty or blank text: dropped by the first stage;  null ids and repeated rows: each row goes through the filters on
  its own; of a group of near duplicates the rows of the smallest id stay, and rows without an id are never compared;
* very long texts: read whole by every stage, and cut into several windows;
* ties: the smallest id stays;  extra columns: kept by every stage but the last;
* empty table: no windows.

run() starts Spark jobs at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import remove, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands of their lengths."""
    from ledgerloom.llm.compression_rules import compression_filter

    return compression_filter(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for good; it is fitted to labelled documents of the whole table."""
    from ledgerloom.llm.byte_cnn import quality_filter, train

    return quality_filter(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    from ledgerloom.llm.probminhash import near_dedup as one_of_each

    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    from ledgerloom.llm.secret_novelty import redact_secrets

    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 tokens."""
    from ledgerloom.llm.packing import pack_windows

    return pack_windows(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: Compression, the network and the packing have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
