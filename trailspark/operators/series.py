"""Event counts per period, hour of day and weekday. Periods without events have no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import timecols as t

GRANULARITIES = ("hour", "day", "week", "month")


def _series(events: DataFrame, period, label) -> DataFrame:
    counts = events.select(period.alias("period")).groupBy("period").agg(F.count("*").alias("count"))
    return counts.withColumn("period_str", label(F.col("period"))).orderBy("period")


def hourly_series(events: DataFrame) -> DataFrame:
    return _series(events, t.hour_start(F.col("date_jst")), t.hour_label)


def daily_series(events: DataFrame) -> DataFrame:
    return _series(events, t.day(F.col("date_jst")), t.date_text)


def weekly_series(events: DataFrame) -> DataFrame:
    return _series(events, t.week_start(F.col("date_jst")), t.week_label)


def monthly_series(events: DataFrame) -> DataFrame:
    """Counts per year and month with a sort key and a label."""
    counts = (
        events.select(F.year("date_jst").alias("year"), F.month("date_jst").alias("month"))
        .groupBy("year", "month")
        .agg(F.count("*").alias("count"))
    )
    year, month = F.col("year"), F.col("month")
    return (
        counts.withColumn("period", t.month_key(year, month))
        .withColumn("period_str", t.month_label(year, month))
        .orderBy("year", "month")
    )


def activity_series(events: DataFrame, granularity: str = "day") -> DataFrame:
    series = dict(zip(GRANULARITIES, (hourly_series, daily_series, weekly_series, monthly_series)))
    if granularity not in series:
        raise ValueError(f"granularity must be one of {', '.join(GRANULARITIES)}, not {granularity!r}")
    return series[granularity](events)


def hour_distribution(events: DataFrame) -> DataFrame:
    """Events per hour of day, with the business-hour flag of the hour."""
    counts = events.select(F.hour("date_jst").alias("hour")).groupBy("hour").agg(F.count("*").alias("count"))
    return counts.withColumn("is_business_hour", t.business_hour_number(F.col("hour"))).orderBy("hour")


def weekday_distribution(events: DataFrame, weekend_from: int = t.SATURDAY, first_weekday: int = 1) -> DataFrame:
    """Events per ISO weekday with name and weekend flag.

    ``weekend_from=5, first_weekday=0`` gives the off-by-one names and weekend of a
    zero-based reading of ISO numbers.
    """
    counts = (
        events.select(t.iso_weekday(F.col("date_jst")).alias("weekday"))
        .groupBy("weekday")
        .agg(F.count("*").alias("count"))
    )
    return (
        counts.withColumn("weekday_name", t.weekday_name(F.col("weekday"), first_weekday))
        .withColumn("is_weekend", F.col("weekday") >= weekend_from)
        .orderBy("weekday")
    )


def peak_hour(events: DataFrame) -> DataFrame:
    """The hour of day with the most events, the earlier one on a tie."""
    return hour_distribution(events).select("hour", "count").orderBy(F.col("count").desc(), "hour").limit(1)
