"""What the operators share: settings, durable intermediate tables, and iteration over Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one pass of a vectorised kernel works on; a longer text is one pass by itself.
BLOCK_BYTES = 1 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small: some documents are thousands of times longer than the median."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; without one, local runs take a local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), "textloom-checkpoints")
        os.makedirs(path, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_count_up_to(df: DataFrame, bound: int) -> int:
    """Rows of ``df``, but no more than ``bound + 1`` are looked at."""
    return df.limit(bound + 1).count()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets, without a copy; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``size`` bytes, or one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo ``n``: the folds of the held-out measurements."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
