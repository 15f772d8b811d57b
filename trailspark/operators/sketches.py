"""Distinct counts over stored days: one mergeable sketch per day answers for any range of days.

Theta sketches are exact up to ``2 ** lg`` different values; beyond, the relative standard error
of a count is ``2 ** (-lg / 2)`` (0.8 % at 14). They can also be intersected, so that two
periods are compared without their events. The exact counts stay in ``operators.activity``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.labels import contains_bot_mark
from trailspark.operators.filters import DateRange

LG = 14
FIELDS = {"actors": "actor", "actions": "action", "addresses": "actor_ip"}


def day_sketches(events: DataFrame, lg: int = LG) -> DataFrame:
    """day, is_bot, event_count, and for actors, actions and addresses a sketch and whether null occurs.

    Null actors count as humans. One row per day and kind, whatever the number of events.
    """
    kind = F.coalesce(contains_bot_mark(F.col("actor")), F.lit(False)).alias("is_bot")
    # Combined per day before the shuffle: a task sends one sketch of bounded size per day.
    return events.groupBy(F.to_date("date_jst").alias("day"), kind).agg(
        F.count("*").alias("event_count"), *[F.theta_sketch_agg(of, lg).alias(name) for name, of in FIELDS.items()],
        *[F.max(F.col(of).isNull()).alias(f"null_{name}") for name, of in FIELDS.items()],
    )


def _in(date_range: DateRange) -> Column:
    start, end = (dt.date.fromisoformat(d) if isinstance(d, str) else d for d in date_range)
    return F.col("day").between(F.lit(start), F.lit(end))


def range_counts(days: DataFrame, date_range: DateRange, *by: str, lg: int = LG) -> DataFrame:
    """event_count, unique_actors, unique_actions and unique_addresses of a range, both dates inclusive.

    One row, or one for each value of ``by`` (``is_bot``, ``day``). Null is one more actor and one
    more action, as in ``activity.dataset_summary``, but no address.
    """
    found = days.where(_in(date_range)).groupBy(*by).agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"), *[F.theta_union_agg(name, lg).alias(name) for name in FIELDS],
        *[F.coalesce(F.max(f"null_{name}"), F.lit(False)).cast("long").alias(f"null_{name}") for name in FIELDS],
    )
    count = {name: F.coalesce(F.theta_sketch_estimate(name), F.lit(0).cast("long")) for name in FIELDS}
    return found.select(
        *by, "event_count", (count["actors"] + F.col("null_actors")).alias("unique_actors"),
        (count["actions"] + F.col("null_actions")).alias("unique_actions"), count["addresses"].alias("unique_addresses"),
    )


def compare_periods(days: DataFrame, first: DateRange, second: DateRange, lg: int = LG) -> DataFrame:
    """One row: events and actors of two periods, actors in both, and those only in one of them.

    Null actors are left out.
    """
    sides = days.agg(
        *[F.theta_union_agg(F.when(_in(r), F.col("actors")), lg).alias(name) for name, r in (("a", first), ("b", second))],
        *[F.coalesce(F.sum(F.when(_in(r), F.col("event_count"))), F.lit(0)).alias(f"{name}_events") for name, r in (("first", first), ("second", second))],
    )
    size = F.theta_sketch_estimate
    return sides.select(
        "first_events", "second_events", size("a").alias("first_actors"), size("b").alias("second_actors"),
        size(F.theta_intersection("a", "b")).alias("in_both"), size(F.theta_difference("a", "b")).alias("only_first"),
        size(F.theta_difference("b", "a")).alias("only_second"),
    )
