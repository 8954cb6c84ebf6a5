"""Event streams: file sources, windowed counts with late data, resumable upserts, run watchdogs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_event_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, width: str, watermark: str | None = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) per tumbling window; the same plan for a table or a stream.

    On a stream events later than the watermark are dropped and a window is emitted once it is past.
    """
    timed = events.withWatermark("ts", watermark) if watermark and events.isStreaming else events
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): activity without a pause of ``gap``."""
    timed = events.withWatermark("ts", watermark) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_arrivals(events: DataFrame, key: str, watermark: str = "1 day") -> DataFrame:
    """Events without those that come again within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def upsert_latest(folder: str, key: str, order: list[str]):
    """A ``foreachBatch`` function that keeps the latest row per key in ``folder``.

    Each batch writes a new version beside the old ones; the version in force is the last one whose write
    was committed, so a batch that is run again after a failure starts from the version that was complete.
    Works on any file system that Spark writes to.
    """
    from factaudit.operators.evaluation import latest
    from factaudit.session import file_system

    def versions(spark) -> list[int]:
        fs, path = file_system(spark, folder)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        numbers = [int(n.removeprefix("version-")) for n in names if n.startswith("version-")]
        return [n for n in sorted(numbers) if fs.exists(file_system(spark, f"{folder}/version-{n:08d}/_SUCCESS")[1])]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = versions(spark)
        if done and done[-1] >= batch_id:
            return
        rows = batch.unionByName(spark.read.parquet(f"{folder}/version-{done[-1]:08d}")) if done else batch
        latest(rows, [key], order).write.mode("overwrite").parquet(f"{folder}/version-{batch_id:08d}")

    return run


def watchdog(events: DataFrame, stall_ms: int = 300_000) -> DataFrame:
    """(user_id, state, attempts, failures): per run the last state, stalled after silence.

    State kept per run is two counters.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, failures = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "state": ["stalled"], "attempts": [attempts], "failures": [failures]})
            return
        for batch in batches:
            attempts += len(batch)
            failures += int((batch["event_type"] == "error").sum())
        state.update((attempts, failures))
        state.setTimeoutDuration(stall_ms)
        yield pd.DataFrame({"user_id": [key[0]], "state": ["failing" if failures * 2 > attempts else "running"], "attempts": [attempts], "failures": [failures]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, state string, attempts bigint, failures bigint", "attempts bigint, failures bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)
