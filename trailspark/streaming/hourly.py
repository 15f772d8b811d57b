"""Events per actor, action and hour, maintained as events arrive.

Each batch adds a run, its own partial counts. ``FAN`` runs of a level are merged into one of
the next, so that after n batches at most ``FAN`` - 1 runs of each of log(n) levels are read,
and each count is rewritten once per level. Which runs count is a small numbered list, written
last: readers of an older list still find its runs until ``clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailspark.functions import timecols as t
from trailspark.operators.anomaly import hourly_action_counts
from trailspark.sources import versions

FAN = 8

_COUNTS = "actor string, action string, hour_window timestamp_ntz, count bigint"
_RUNS = "stream string, first bigint, last bigint, level int, path string"


def live_runs(spark: SparkSession, store: str) -> list:
    """The runs that make up the table: stream, first and last batch, level and path."""
    return versions.read_version(spark, f"{store}/live", _RUNS)[1]


def _read(spark: SparkSession, store: str, runs: list) -> DataFrame:
    paths = [f"{store}/runs/{row['path']}" for row in runs if row["path"]]
    return spark.read.schema(_COUNTS).parquet(*paths) if paths else spark.createDataFrame([], _COUNTS)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("actor", "action", "hour_window").agg(F.sum("count").alias("count"))


def hourly_counts(spark: SparkSession, store: str) -> DataFrame:
    """actor, action, hour_window, count over everything added so far."""
    return _summed(_read(spark, store, live_runs(spark, store)))


def add_counts(events: DataFrame, store: str, stream: str, number: int, fan: int = FAN) -> None:
    """Adds the events of batch ``number`` of a stream, once, however often it is called.

    Batches of a stream come in ascending order, and one writer adds at a time.
    """
    spark = events.sparkSession
    version, runs = versions.read_version(spark, f"{store}/live", _RUNS)
    runs = [tuple(row) for row in runs]
    if any(name == stream and last >= number for name, _, last, _, _ in runs):
        return
    path = f"{stream}-{number}-0"
    hourly_action_counts(events).write.mode("overwrite").parquet(f"{store}/runs/{path}")
    runs.append((stream, number, number, 0, path))
    level = 0
    while len(own := [run for run in runs if run[0] == stream and run[3] == level]) >= fan:
        merged = f"{stream}-{number}-{level + 1}"
        found = _summed(_read(spark, store, [{"path": run[4]} for run in own]))
        found.write.mode("overwrite").parquet(f"{store}/runs/{merged}")
        runs = [run for run in runs if run not in own] + [(stream, own[0][1], own[-1][2], level + 1, merged)]
        level += 1
    versions.write_version(spark.createDataFrame(runs, _RUNS), f"{store}/live", version + 1)


def clean(spark: SparkSession, store: str) -> None:
    """Deletes lists before the last one, and runs that no list names any more."""
    numbers = versions.complete(spark, f"{store}/live", "version")
    live = {row["path"] for row in live_runs(spark, store)}
    for number in numbers[:-1]:
        for row in spark.read.schema(_RUNS).parquet(f"{store}/live/version={number}").collect():
            if row["path"] not in live:
                versions.remove(spark, f"{store}/runs/{row['path']}")
        versions.remove(spark, f"{store}/live/version={number}")


def maintain_hourly(events: DataFrame, store: str, checkpoint: str, fan: int = FAN, **trigger) -> StreamingQuery:
    """Keeps the table from a stream of events. Late events count like any other."""
    stream = versions.stream_id(events.sparkSession, checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        add_counts(batch, store, stream, number, fan)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def actor_totals(counts: DataFrame) -> DataFrame:
    """Events per actor, as ``activity.events_per_actor`` gives them."""
    return _ranked(counts.groupBy("actor").agg(F.sum("count").alias("event_count")), "event_count", "actor")


def bulk_hours(counts: DataFrame, threshold: int = 50) -> DataFrame:
    """Actor, action and hour with more events than the threshold, as ``anomaly.bulk_operations``."""
    return _ranked(counts.where(F.col("count") > threshold), "count", "hour_window", "actor", "action")


def _ranked(rows: DataFrame, count: str, *keys: str) -> DataFrame:
    return rows.orderBy(F.desc(count), *[F.asc_nulls_last(key) for key in keys])


def period_totals(counts: DataFrame, granularity: str) -> DataFrame:
    """``period`` and ``count`` per hour, day, week or month, as the series of events count them."""
    start = {"hour": t.hour_start, "day": t.day, "week": t.week_start, "month": t.month_start}
    if granularity not in start:
        raise ValueError(f"granularity must be one of {', '.join(start)}, not {granularity!r}")
    return counts.groupBy(start[granularity](F.col("hour_window")).alias("period")).agg(F.sum("count").alias("count")).orderBy("period")


def hour_totals(counts: DataFrame) -> DataFrame:
    """``hour`` (of day) and ``count``."""
    return counts.groupBy(F.hour("hour_window").alias("hour")).agg(F.sum("count").alias("count")).orderBy("hour")


def weekday_totals(counts: DataFrame) -> DataFrame:
    """``weekday`` (ISO) and ``count``."""
    return counts.groupBy(t.iso_weekday(F.col("hour_window")).alias("weekday")).agg(F.sum("count").alias("count")).orderBy("weekday")
