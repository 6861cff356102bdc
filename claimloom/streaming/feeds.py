"""Streams: deduplicated ingest, windows over events, change feeds and failure lockout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Failures that lock, and the minutes in which they count.
FAILURES, MINUTES = 5, 15


def first_seen(stream: DataFrame, key: str = "content_sha", at: str = "received_at", within: str = "1 day") -> DataFrame:
    """Each key once, as long as the watermark remembers it."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by type and window, for streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type and window, with a window opening at every step."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def changes(frames: DataFrame, key: str, at: list[str], signature: list[str]) -> DataFrame:
    """Rows whose signature differs from the one before for the same key."""
    before = F.lag(F.struct(*signature)).over(W.partitionBy(key).orderBy(*at))
    return frames.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.struct(*signature))).drop("_b")


def _fold(times: list[float], first: float, count: int) -> tuple[float, int, list[tuple[float, int, bool]]]:
    out = []
    for t in times:
        if count == 0 or t - first > MINUTES * 60:
            first, count = t, 0
        count += 1
        out.append((t, count, count >= FAILURES))
    return first, count, out


def lockouts(failures: DataFrame) -> DataFrame:
    """Failures of each user in order with the count in their window: it starts anew 15 minutes after its first."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by user, so of a user only the open window is carried from batch to batch.
        user, first, count, begun = None, 0.0, 0, False
        for batch in batches:
            users = batch.column("user_id").to_pylist()
            times = [float("nan") if t is None else t for t in batch.column("t").to_pylist()]
            rows: list[tuple[float, int, bool]] = []
            at = 0
            while at < len(users):
                if not begun or users[at] != user:
                    user, first, count, begun = users[at], 0.0, 0, True
                end = at + 1
                while end < len(users) and users[end] == user:
                    end += 1
                first, count, out = _fold(times[at:end], first, count)
                rows += out
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("user_id"), batch.column("event_id"), pa.array([n for _, n, _ in rows], pa.int32()), pa.array([x for _, _, x in rows], pa.bool_())],
                names=["user_id", "event_id", "failures", "locked"],
            )

    time = (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t")
    timed = failures.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), time)
    ordered = timed.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_last("t"), F.asc_nulls_last("event_id"))
    return ordered.mapInArrow(fold, "user_id long, event_id long, failures int, locked boolean")


def lockout_stream(failures: DataFrame) -> DataFrame:
    """The same over a stream, with each user's window in the state store until the watermark has passed it."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for f in frames for t in f["t"])
        first, count = state.get if state.exists else (0.0, 0)
        first, count, rows = _fold(times, first, count)
        state.update((first, count))
        state.setTimeoutTimestamp(max(int(first * 1000) + MINUTES * 60_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"user_id": [key[0]] * len(rows), "t": [t for t, _, _ in rows], "failures": [n for _, n, _ in rows], "locked": [x for _, _, x in rows]})

    timed = failures.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{MINUTES} minutes")
    timed = timed.select("user_id", "ts", (F.unix_micros("ts").cast("double") / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(fold, "user_id long, t double, failures int, locked boolean", "first double, count int", "append", "EventTimeTimeout")


def rates(events: DataFrame, key: str = "user_id", width: str = "1 minute") -> DataFrame:
    """Requests of each key in each window."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
