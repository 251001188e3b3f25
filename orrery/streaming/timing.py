"""Timing on streams. Watermarks bound state; every aggregate here also runs on a static table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New files of events as they come, as entity_id, ts, event_type."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.select("event_id", F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


def overlap_by_window(events: DataFrame, window: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """Per window: events and roughly how many entities act (exact counts of distinct values do not stream)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", window)).agg(F.count("*").alias("n_events"), F.approx_count_distinct("entity_id", 0.02).alias("n_entities"))
    return grouped.select(F.col("window.start").alias("start"), "n_events", "n_entities", (F.col("n_entities") > 1).alias("overlap"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events a day, which busy_days() compares."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Runs of an entity's events with no longer gap than that."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy("entity_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"))
    return grouped.select("entity_id", F.col("s.start").alias("start"), "n_events")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by id, each once while its duplicates can come in time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def burst_alerts(events: DataFrame, minutes: float = 60, least: int = 3, late: str = "1 hour") -> DataFrame:
    """An alert (entity_id, at, n) whenever an entity's run of close events grows to `least` or more within a batch. The state of an
    entity is the time of its last event and the length of its run; it goes when the watermark is past the gap."""
    gap = minutes * 60

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, run = state.get if state.exists else (float("-inf"), 0)
        alerts = []
        times = sorted(t for f in frames for t in (f["ts"].astype("int64") / 1e9).tolist())
        for t in times:
            run = run + 1 if t - last <= gap else 1
            last = max(last, t)
            if run >= least:
                alerts.append((key[0], pd.Timestamp(t, unit="s"), run))
        state.update((last, run))
        state.setTimeoutTimestamp(max(int((last + gap) * 1000), state.getCurrentWatermarkMs() + 1))
        if alerts:
            yield pd.DataFrame(alerts, columns=["entity_id", "at", "n"])

    return events.withWatermark("ts", late).groupBy("entity_id").applyInPandasWithState(step, "entity_id long, at timestamp, n int", "last double, run int", "append", GroupStateTimeout.EventTimeTimeout)
