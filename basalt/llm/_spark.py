"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session, as in tests, gets a folder of this machine where the setting is missing.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "basalt-checkpoints"))
    return str(sc.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a compressed table in the shared folder, which goes at the end of the block."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    try:
        yield spark.read.schema(df.schema).parquet(where)
    finally:
        remove(spark, where)


def remove(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is ``rest``; a missing id belongs to no fold."""
    return F.coalesce((F.crc32(F.col(doc_id).cast("string")) % mod) == rest, F.lit(False))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession) -> None:
    """Texts are long rows: unless the session says otherwise, 2,000 of them make an Arrow batch, not 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "2000")


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows that hold about ``limit`` bytes of text each.

    A row of more bytes makes a run of its own, so memory follows the longest text.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()  # workers are used again: what a task has freed shouldn't stay with them


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n + 1 offsets of its rows; null counts as empty."""
    if array.null_count:
        array = pc.fill_null(array, "" if not pa.types.is_binary(array.type) else b"")
    kind = np.int64 if array.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the system, after a model was fitted on the driver."""
    gc.collect()
    trim()


def sweep(spark: SparkSession) -> None:
    """Files of shuffles and checkpoints that nothing refers to any more go now; else they wait for the driver's collector."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Give back what is free already."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
