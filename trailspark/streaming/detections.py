"""Bulk-operation counts and critical-action alerts over a stream of events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.functions.timecols import ntz, wall_clock_micros
from trailspark.operators.filters import listed_events
from trailspark.schema import CRITICAL_ACTIONS
from trailspark.streaming import hourly


def count_stream(events: DataFrame, counts: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds the events per actor, action and clock hour of every batch to the table ``counts``.

    Events of any age count, and no watermark drops late ones; see ``streaming.hourly``.
    """
    return hourly.maintain_hourly(events, counts, checkpoint, **trigger)


def bulk_alerts(spark: SparkSession, counts: str, threshold: int = 50) -> DataFrame:
    """Actor, action and clock hour with more events than the threshold, by the counts so far."""
    return hourly.bulk_hours(hourly.hourly_counts(spark, counts), threshold)


def _with_clock(events: DataFrame, delay: str) -> DataFrame:
    """Adds ``_clock`` with a watermark: the event time as an instant, since watermarks take no zone-less time.

    The wall clock is read as UTC, so nothing depends on the session's zone.
    """
    return events.withColumn("_clock", F.timestamp_micros(wall_clock_micros(F.col("date_jst")))).withWatermark("_clock", delay)


def windowed_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events per actor, action and clock hour, each hour once when it is over.

    An hour is given out when the watermark, the latest event time less ``delay``, has passed
    its end; until then its counts are held as state, and nothing of older hours is. Rows that
    come later still are not in it: see ``late_corrections``.
    """
    hours = _with_clock(events, delay).groupBy(F.window("_clock", "1 hour"), "actor", "action").agg(F.count("*").alias("count"))
    start = F.lit(dt.timedelta(microseconds=1)) * F.unix_micros("window.start")
    return hours.select("actor", "action", (ntz("1970-01-01") + start).alias("hour_window"), "count")


def late_corrections(windows: DataFrame, hourly: DataFrame) -> DataFrame:
    """actor, action, hour_window, count, given: hours that had late rows after they were given out.

    ``windows`` is what ``windowed_counts`` has written, ``hourly`` the counts of all events (see
    ``streaming.hourly``). An hour whose every row was late was never given out: ``given`` is 0
    where a later hour has been. Hours that are still open are not reported.
    """
    last = windows.agg(F.max("hour_window").alias("last_given"))
    given = windows.select(
        F.col("actor").alias("_actor"), F.col("action").alias("_action"), F.col("hour_window").alias("_hour"), F.col("count").alias("given")
    )
    same = F.col("actor").eqNullSafe(F.col("_actor")) & F.col("action").eqNullSafe(F.col("_action")) & (F.col("hour_window") == F.col("_hour"))
    over = hourly.where(F.col("hour_window") <= last.scalar())
    found = over.join(given, same, "left").select("actor", "action", "hour_window", "count", F.coalesce("given", F.lit(0)).alias("given"))
    return found.where(F.col("count") > F.col("given"))


def critical_alert_feed(
    events: DataFrame, keys: Sequence[str], delay: str = "1 day", actions: Sequence[str] = CRITICAL_ACTIONS
) -> DataFrame:
    """Critical events, each once: a row with the keys of one seen within ``delay`` is not given out again.

    The keys held as state end with the watermark. Written by ``write_stream``, an event that is
    delivered twice alerts once, over restarts as well.
    """
    critical = critical_event_stream(events, actions)
    return _with_clock(critical, delay).dropDuplicatesWithinWatermark(list(keys)).drop("_clock")


def critical_event_stream(events: DataFrame, actions: Sequence[str] = CRITICAL_ACTIONS) -> DataFrame:
    """Critical events as they arrive; stateless. An empty list finds none."""
    return listed_events(events, actions)


def write_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to Parquet files; the checkpoint makes restarts exactly-once.

    Without a trigger argument everything available is processed, then the query ends.
    """
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
