"""Addresses an actor has not used lately, against the actor's own trailing baseline.

Everything is computed from one row per actor, address and day, so that the events of a bot meet
in no task: the windows run over days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASELINE_DAYS = 30
LEAST_ACTIVE_DAYS = 3

_DAY = ["actor", "day"]


def address_days(events: DataFrame) -> DataFrame:
    """actor, actor_ip, day, event_count, first_event of events that have an address."""
    known = events.where(F.col("actor_ip").isNotNull())
    return known.groupBy("actor", "actor_ip", F.to_date("date_jst").alias("day")).agg(
        F.count("*").alias("event_count"), F.min("date_jst").alias("first_event")
    )


def address_baseline(days: DataFrame, baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """Per actor and day: how many addresses and active days the actor had in the days before.

    An address is known from the day after each use to ``baseline_days`` after it, or to its
    next use. These stretches do not overlap, so the known addresses of a day are the stretches
    begun by then less those ended, which is a running sum over one row per actor and day.
    """
    following = Window.partitionBy("actor", "actor_ip").orderBy("day")
    used = days.select("actor", "actor_ip", "day", F.lead("day").over(following).alias("next"))
    end = F.least(F.coalesce("next", F.date_add("day", baseline_days)), F.date_add("day", baseline_days))
    steps = used.select("actor", F.inline(F.array(
        F.struct(F.col("day"), F.lit(0).alias("step"), F.lit(1).alias("active")),
        F.struct(F.date_add("day", 1).alias("day"), F.lit(1).alias("step"), F.lit(0).alias("active")),
        F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).alias("step"), F.lit(0).alias("active")),
    )))
    per_day = steps.groupBy(*_DAY).agg(F.sum("step").alias("step"), F.max("active").alias("active"))
    number = F.unix_date("day")
    of_actor = Window.partitionBy("actor").orderBy(number)
    return per_day.select(
        *_DAY, "active", F.sum("step").over(of_actor.rowsBetween(Window.unboundedPreceding, 0)).alias("known_addresses"),
        F.coalesce(F.sum("active").over(of_actor.rangeBetween(-baseline_days, -1)), F.lit(0)).alias("active_days"),
    ).where("active = 1").drop("active")


def unusual_addresses(
    events: DataFrame, baseline_days: int = BASELINE_DAYS, least_active_days: int = LEAST_ACTIVE_DAYS
) -> DataFrame:
    """A row for each actor, address and day on which the address is new against the baseline.

    New means that the actor has not used the address in the ``baseline_days`` before that day.
    Actors who were active on fewer than ``least_active_days`` of these days have no baseline and
    are not reported. Columns: actor, actor_ip, day, event_count, first_event, last_seen (the day
    of the last use before, or null), known_addresses and active_days of the baseline. A null
    actor is one more actor. Newest days first.
    """
    days = address_days(events)
    before = Window.partitionBy("actor", "actor_ip").orderBy("day")
    seen = days.withColumn("last_seen", F.lag("day").over(before))
    new = seen.where(F.col("last_seen").isNull() | (F.datediff("day", "last_seen") > baseline_days))
    baseline = address_baseline(days, baseline_days).where(F.col("active_days") >= least_active_days)
    named = baseline.withColumnsRenamed({"actor": "_actor", "day": "_day"})
    found = new.join(named, F.col("actor").eqNullSafe(F.col("_actor")) & (F.col("day") == F.col("_day"))).drop("_actor", "_day")
    return found.orderBy(F.desc("day"), F.asc_nulls_last("actor"), "actor_ip")
