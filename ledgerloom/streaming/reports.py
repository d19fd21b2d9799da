"""Reports as they arrive: a file source of pages, each micro-batch going through the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.reports import PAGES


def stream_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Pages written as Parquet into a folder; all pages of a filing belong into one file."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def process_stream(pages: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a batch plan on every micro-batch; a batch that runs again overwrites its own folder, so each counts once."""

    def each(batch: DataFrame, epoch: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
