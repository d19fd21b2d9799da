"""Small helpers shared by the training-data operators.

Ids are 64-bit integers, as doc_id, page_id and vec_id are; a column of another type is cast where every value fits and is
an error where one doesn't.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Arrow batches of long texts are bounded by bytes, not only by rows.
BATCH_BYTES = 16 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The vectorized reader holds so many rows of every column at once, and by default 4,096; the writer asks how full a page
#: or a row group is after so many rows, and by default 100.  Both know rows and no bytes, so a few rows are the bound that
#: holds for book-length texts too.  Settings of sessions, which reach the writer as well.
ROW_SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": 16, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}


def bound_batches(spark: SparkSession) -> None:
    """Bound what is held of a table at once, in the Arrow batches sent to Python and where Parquet is read and written,
    unless the session has bounds of its own.

    A batch of 10,000 rows is harmless for short rows and several GB for book-length ones.
    """
    for key, most in {BATCH_SETTING: BATCH_BYTES, **ROW_SETTINGS}.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with byte-bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, made usable for ``checkpoint()``: the one named in spark.checkpoint.dir.

    Where none is named, a local master gets a temporary one (tests); a cluster gets an error, as a folder of one machine
    would lose what the others wrote.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into the shared folder as Parquet and read again, so that columns nobody asks for stay there.

    The folder lies below this application's checkpoints and is removed with them.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def one_text_each(rows: DataFrame, ids: list[int], id_col: str, text_col: str, budget: int) -> dict[int, str]:
    """{id: text} for a bounded list of ids, in its order, of at most `budget` characters together.

    One text counts for each id: of several the one with the least hash, and of equal hashes the shortest and of those the
    least, so that the choice doesn't hang on the order of rows.  Rows are read twice: hashes and lengths alone choose, and
    only chosen texts are moved, so that what is shuffled and what reaches the driver are bounded in rows and in characters.
    A text that no longer fits is left out whole.
    """
    if not ids:
        return {}
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], "i bigint"))  # as long as the list
    of_ids = rows.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    hashed = F.xxhash64("t").alias("h"), F.length("t").alias("n")
    least = of_ids.join(wanted, "i").select("i", *hashed).groupBy("i").agg(F.min(F.struct("h", "n")).alias("m"))
    sizes, keep = {r.i: (r.h, r.n) for r in least.select("i", "m.*").collect()}, []
    for i in ids:
        if i in sizes and sizes[i][1] <= budget:
            keep.append((i, *sizes[i]))
            budget -= sizes[i][1]
    if not keep:
        return {}
    fits = F.broadcast(spark.createDataFrame(keep, "i bigint, least bigint, chars int"))
    chosen = of_ids.join(fits, "i").where((hashed[0] == F.col("least")) & (hashed[1] == F.col("chars")))
    text = {r.i: r.t for r in chosen.groupBy("i").agg(F.min("t").alias("t")).collect()}
    return {i: text[i] for i, _, _ in keep}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
