"""Streams into tables, exactly once: a batch that is run again replaces what it wrote before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def into_batches(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """Write every micro-batch to a folder of its own number below ``path``.

    After a failure Spark runs the open batch again under the same number, so its folder is
    written again and nothing is stored twice. ``each`` is applied to a batch before it is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def with_state(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataStreamWriter:
    """Carry a table from batch to batch: each batch reads the table that the one before wrote, and writes the next.

    A batch that is run again starts from the same table as the first time.
    """

    def write(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/state={number - 1}") if number else None
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/state={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def progress(batches: DataFrame, total: int, every: int = 5) -> DataFrame:
    """How many documents are done after each batch (batch, n), told whenever another ``every`` are, and at the end."""
    from pyspark.sql.window import Window as W

    done = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("batch"))  # one row for each batch of one job
    rows = batches.withColumn("done", done)
    before = F.coalesce(F.lag("done").over(W.partitionBy(F.lit(0)).orderBy("batch")), F.lit(0))
    return rows.withColumn("_b", before).where((F.floor(F.col("done") / every) > F.floor(F.col("_b") / every)) | (F.col("done") >= total)).drop("_b")
