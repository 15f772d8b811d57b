"""Counts and rankings of actors, actions, repositories and files.

Every ranking is one aggregate that combines before its shuffle, so a bot with a third of
all events costs each task one row. Limits are top-k selections with the key as tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.timecols import days_between
from trailspark.operators.filters import (
    DateRange,
    date_range_condition,
    without_bots,
)


def ranked(counts: DataFrame, count: str, *keys: str, n: int | None = None) -> DataFrame:
    """Largest counts first; all rows, or the first ``n``."""
    ordered = counts.orderBy(F.col(count).desc(), *[F.col(key).asc_nulls_last() for key in keys])
    return ordered if n is None else ordered.limit(n)


def count_by(rows: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def file_counts(events: DataFrame) -> DataFrame:
    """Events per source file. Files of one name in several folders are several files."""
    return count_by(events, "_source_path", "_source_file", name="event_count").orderBy("_source_path", "_source_file")


def _different(name: str):
    """Number of different values, null being one of them."""
    has_null = F.max(F.when(F.col(name).isNull(), 1).otherwise(0))
    return F.count_distinct(name) + F.coalesce(has_null, F.lit(0))


def _event_totals(events: DataFrame) -> DataFrame:
    """One row: events, time range, different actors and actions.

    The distinct counts run over one row per actor and action, not over events.
    """
    pairs = events.groupBy("actor", "action").agg(
        F.count("*").alias("n"), F.min("date_jst").alias("first"), F.max("date_jst").alias("last")
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("event_count"),
        F.min("first").alias("first_event"),
        F.max("last").alias("last_event"),
        _different("actor").alias("unique_actors"),
        _different("action").alias("unique_actions"),
    )


def dataset_summary(events: DataFrame) -> DataFrame:
    """One row: events, files, bytes, time range, different actors and actions.

    A null actor or action counts as one more value. Files are told apart by path and
    come from a scan of their own, which reads no column of the other and keeps the
    shuffles free of file and actor combinations.
    """
    files = events.groupBy("_source_path").agg(F.max("_source_bytes").alias("_source_bytes"))
    file_totals = files.agg(F.struct(
        F.count("*").alias("file_count"), F.coalesce(F.sum("_source_bytes"), F.lit(0)).alias("total_bytes")
    ))
    return (
        _event_totals(events)
        .withColumn("files", file_totals.scalar())
        .select("event_count", "files.file_count", "files.total_bytes", "first_event", "last_event",
                "unique_actors", "unique_actions")
    )


def event_profile(events: DataFrame) -> DataFrame:
    """One row: events, first and last date, different actions and actors."""
    return _event_totals(events).select(
        "event_count",
        F.to_date("first_event").alias("first_date"),
        F.to_date("last_event").alias("last_date"),
        "unique_actions",
        "unique_actors",
    )


def data_span(events: DataFrame) -> DataFrame:
    """One row: first and last date, whole days between the first and last event."""
    span = events.agg(F.min("date_jst").alias("first"), F.max("date_jst").alias("last"))
    return span.select(
        F.to_date("first").alias("first_date"),
        F.to_date("last").alias("last_date"),
        days_between(F.col("first"), F.col("last")).alias("days"),
    )


def selected_counts(events: DataFrame, date_range: DateRange | None) -> DataFrame:
    """One row: events in the date range and in all, in one pass."""
    condition = F.lit(True) if date_range is None else date_range_condition(date_range)
    return events.agg(F.count_if(condition).alias("selected_events"), F.count("*").alias("total_events"))


def distinct_actions(events: DataFrame) -> DataFrame:
    return events.select("action").distinct().orderBy(F.col("action").asc_nulls_first())


def events_per_actor(events: DataFrame) -> DataFrame:
    return ranked(count_by(events, "actor", name="event_count"), "event_count", "actor")


def user_totals(events: DataFrame) -> DataFrame:
    """One row: users, events, mean events per user."""
    return count_by(events, "actor", name="n").agg(
        F.count("*").alias("users"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        (F.coalesce(F.sum("n"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("events_per_user"),
    )


def top_actors(events: DataFrame, n: int = 10, exclude_bots: bool = True) -> DataFrame:
    rows = without_bots(events) if exclude_bots else events
    return ranked(count_by(rows, "actor", name="event_count"), "event_count", "actor", n=n)


def actor_actions(events: DataFrame) -> DataFrame:
    """Events per actor and action; by actor, then largest count first."""
    return count_by(events, "actor", "action").orderBy(
        F.col("actor").asc_nulls_first(), F.col("count").desc(), F.col("action").asc_nulls_last()
    )


def action_distribution(events: DataFrame, n: int | None = None) -> DataFrame:
    return ranked(count_by(events, "action"), "count", "action", n=n)


def _top_named(events: DataFrame, name: str, n: int) -> DataFrame:
    return ranked(count_by(events.where(F.col(name).isNotNull()), name), "count", name, n=n)


def top_repos(events: DataFrame, n: int = 15) -> DataFrame:
    """Repositories with the most events; events without one are left out."""
    return _top_named(events, "repo", n)


def top_teams(events: DataFrame, n: int = 15) -> DataFrame:
    return _top_named(events, "team", n)
