"""Shared pieces of the training-data operators: tables, shared folders, Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimloom.sources.durable import removed, shared_folder, written

__all__ = ["free_name", "offsets_of", "removed", "shared_folder", "slices", "small", "table", "written"]

#: Bytes of text that one vectorised step holds at a time; bounds a task's memory.
SLICE_BYTES = 1 << 19


#: Rows that Spark hands to Python at a time: texts are long, and two batches of each task are in memory on either side.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batches_of_texts(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session for rows that hold texts; a smaller bound stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, for operators on texts."""
    batches_of_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(offsets_of(batch.column(batch.schema.get_field_index(column)))[0]))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Hand memory that was freed back to the system: a Python worker keeps it otherwise, while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and the bytes they point into; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


#: A table of so many narrow rows at most is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 10_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a written table whose rows are counted and few; else leave the join to Spark."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with marks added one that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows (doc_id and ``columns``, text among them) one for each doc_id: that with the smallest hash of its text.

    Rows are combined before the shuffle, so a doc_id that very many rows share is no hot key.
    """
    from pyspark.sql import functions as F

    first = rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct(F.xxhash64("text"), *[c for c in columns if c != "text"])).alias("_one"))
    return first.select("doc_id", *[F.col("_one")[c].alias(c) for c in columns])
