"""Off-hours work, bulk operations, accounts with several addresses, risk score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import timecols as t
from trailspark.functions.labels import risk_level
from trailspark.operators.activity import count_by, ranked
from trailspark.operators.filters import (
    DateRange,
    date_range_condition,
    in_date_range,
    off_hours_events,
    without_bots,
)
from trailspark.schema import CRITICAL_ACTIONS, HIGH_RISK_ACTIONS


def off_hours_share(events: DataFrame, weekend_from: int = t.SATURDAY) -> DataFrame:
    """One row: off-hours events, all events, share in percent."""
    counts = events.agg(
        F.count_if(t.is_off_hours(F.col("date_jst"), weekend_from)).alias("off_hours_events"),
        F.count("*").alias("total_events"),
    )
    share = F.col("off_hours_events") / F.greatest(F.col("total_events"), F.lit(1)) * 100
    return counts.withColumn("off_hours_pct", share)


def off_hours_by_actor(events: DataFrame, n: int = 10, weekend_from: int = t.SATURDAY) -> DataFrame:
    """Actors with the most off-hours events, bots left out."""
    rows = without_bots(off_hours_events(events, weekend_from))
    return ranked(count_by(rows, "actor", name="off_hours_count"), "off_hours_count", "actor", n=n)


def hourly_action_counts(events: DataFrame) -> DataFrame:
    """Events per actor, action and calendar hour."""
    return (
        events.select("actor", "action", t.hour_start(F.col("date_jst")).alias("hour_window"))
        .groupBy("actor", "action", "hour_window")
        .agg(F.count("*").alias("count"))
    )


def bulk_operations(events: DataFrame, threshold: int = 50) -> DataFrame:
    """Actor, action and hour with strictly more events than the threshold."""
    found = hourly_action_counts(events).where(F.col("count") > threshold)
    return ranked(found, "count", "hour_window", "actor", "action")


def _actor_addresses(events: DataFrame) -> DataFrame:
    return events.where(F.col("actor_ip").isNotNull()).select("actor", "actor_ip").distinct()


def multi_ip_actors(events: DataFrame, more_than: int = 2) -> DataFrame:
    """Actors seen from more than this many addresses."""
    found = count_by(_actor_addresses(events), "actor", name="unique_ips").where(F.col("unique_ips") > more_than)
    return ranked(found, "unique_ips", "actor")


def multi_ip_lists(events: DataFrame, more_than: int = 2) -> DataFrame:
    """The same actors with their addresses: a row for each actor and address."""
    found = _actor_addresses(events)
    totals = count_by(found, "actor", name="unique_ips").where(F.col("unique_ips") > more_than)
    named = totals.withColumnRenamed("actor", "_actor")
    return found.join(named, F.col("actor").eqNullSafe(F.col("_actor"))).select("actor", "unique_ips", "actor_ip")


def risk_summary(
    events: DataFrame,
    date_range: DateRange | None = None,
    bulk_threshold: int = 50,
    scope: str = "as_written",
    weekend_from: int = t.SATURDAY,
    more_ips_than: int = 2,
    critical_actions: Sequence[str] = CRITICAL_ACTIONS,
    high_risk_actions: Sequence[str] = HIGH_RISK_ACTIONS,
) -> DataFrame:
    """One row: risk level and score with the counts behind it.

    ``scope="as_written"`` applies the date range to the critical and high-risk counts only;
    ``scope="filtered"`` applies it to every count.

    All but the address count follow from the events per actor, action and hour, since both
    the date range and off-hours are whole hours: one scan and one shuffle give them all.
    """
    if scope not in ("as_written", "filtered"):
        raise ValueError(f"scope must be as_written or filtered, not {scope!r}")
    if scope == "filtered":
        events, date_range = in_date_range(events, date_range), None

    hours = hourly_action_counts(events).withColumnRenamed("hour_window", "date_jst")
    in_range = F.lit(True) if date_range is None else date_range_condition(date_range)

    def events_where(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))

    counts = hours.agg(
        events_where(in_range & F.col("action").isin(*critical_actions)).alias("critical_events"),
        events_where(in_range & F.col("action").isin(*high_risk_actions)).alias("high_risk_events"),
        F.count_if(F.col("count") > bulk_threshold).alias("bulk_operations"),
        events_where(t.is_off_hours(F.col("date_jst"), weekend_from)).alias("off_hours_events"),
    )
    none = F.lit(0).cast("bigint")
    parts = counts.withColumn("multi_ip_actors", none)
    if "actor_ip" in events.columns:
        actors = count_by(_actor_addresses(events), "actor", name="n")
        addresses = actors.agg(F.count_if(F.col("n") > more_ips_than).alias("multi_ip_actors"))
        parts = parts.unionByName(addresses.select(
            *[none.alias(name) for name in counts.columns], "multi_ip_actors"
        ))
    totals = parts.agg(*[F.sum(name).alias(name) for name in parts.columns])
    score = (
        F.col("critical_events") * 10
        + (F.col("high_risk_events") + F.col("bulk_operations")) * 5
        + F.expr("off_hours_events div 100")
    )
    return totals.select(risk_level(score).alias("risk_level"), score.alias("risk_score"), *parts.columns)
