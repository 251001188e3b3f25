"""Queries that run a stream over what is there to its end, and return what it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.catalog import query
from orrery.plans.tables import shared_dir
from orrery.streaming import timing as T


def to_the_end(stream: DataFrame) -> DataFrame:
    """All that the stream gives for the input that is there. The result is small: a row per window, not per event."""
    spark, name = stream.sparkSession, f"stream_{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_dir(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read_events(spark, f"{sf_dir}/events.parque[t]")  # a pattern: the table may be a file or a folder


@query("stream_daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    return to_the_end(T.daily_counts(events(spark, sf_dir)))


@query("stream_windows", "SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day_number, count(*) AS n_events, count(DISTINCT user_id) > 1 AS overlap FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    rows = to_the_end(T.overlap_by_window(events(spark, sf_dir)))
    return rows.select(F.floor(F.unix_seconds("start") / 86_400).alias("day_number"), "n_events", "overlap")
