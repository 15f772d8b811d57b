"""Members joined with their activity and licence seats: who is dormant, who has left.

Events always shrink to one row per actor (or actor and month) before they meet the
members. A bot with a third of the events therefore never becomes a hot join key, and the
member filter needs no list on the driver: the join itself drops other actors.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.functions import timecols as t
from trailspark.functions.labels import activity_flag, dormancy_status, ends_with_bot_mark
from trailspark.operators.activity import count_by, ranked
from trailspark.operators.filters import in_period
from trailspark.schema import (
    STATUS_LOW,
    STATUS_NONE,
    STATUS_WATCH,
    TREND_ALL,
    TREND_DORMANT,
)

SEAT_COLUMNS = ("copilot_last_activity", "last_activity_editor", "pending_cancellation_date")
AsOf = dt.datetime | str


def latest_seats(seats: DataFrame) -> DataFrame:
    """One seat per login: the one with the latest activity, unused ones last.

    Ties go to the first organisation, then the newest seat; whole rows are kept, values of
    different seats never mix. Spark keeps one row per login in each task before the shuffle.
    """
    ties = [F.col("org_name").asc_nulls_last(), F.col("created_at").desc_nulls_last(),
            F.col("last_activity_editor").asc_nulls_last(), F.col("pending_cancellation_date").asc_nulls_last(),
            F.col("user_id").asc_nulls_last()]
    newest = Window.partitionBy("login").orderBy(F.col("last_activity_at").desc_nulls_last(), *ties)
    return seats.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def member_events(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events whose actor is a member."""
    return events.join(members, events["actor"] == members["login"], "left_semi")


def former_users(events: DataFrame, members: DataFrame) -> DataFrame:
    """Actors of the whole log who are no members; bots and null left out. One column, ``actor``."""
    actors = events.where(F.col("actor").isNotNull() & ~ends_with_bot_mark(F.col("actor"))).select("actor").distinct()
    return actors.join(members, actors["actor"] == members["login"], "left_anti")


def former_user_report(events: DataFrame, members: DataFrame, n: int = 10) -> DataFrame:
    """One row: number of former users, the first ``n`` names, how many more there are."""
    former = former_users(events, members)
    names = former.orderBy("actor").limit(n).agg(F.array_sort(F.collect_list("actor")).alias("names"))
    count = former.agg(F.count("*").alias("former_count"))
    return count.select(
        "former_count",
        F.array_join(names.scalar(), ", ").alias("first_names"),
        F.greatest(F.col("former_count") - n, F.lit(0)).alias("more"),
    )


def member_activity(events: DataFrame) -> DataFrame:
    """Per actor: events, last event, different actions (null counts as one)."""
    per_action = events.groupBy("actor", "action").agg(F.count("*").alias("n"), F.max("date_jst").alias("last"))
    return per_action.groupBy(F.col("actor").alias("login")).agg(
        F.sum("n").alias("audit_event_count"),
        F.max("last").alias("last_audit_activity"),
        F.count("*").alias("unique_actions"),
    )


def join_activity(members: DataFrame, activity: DataFrame) -> DataFrame:
    """Members with their activity; members without any keep zero counts.

    A login listed twice among the members keeps both rows.
    """
    return (
        members.select("login", "id", "type")
        .join(activity, "login", "left")
        .withColumn("audit_event_count", F.coalesce("audit_event_count", F.lit(0)))
        .withColumn("unique_actions", F.coalesce("unique_actions", F.lit(0)))
    )


def join_seats(summary: DataFrame, latest: DataFrame | None) -> DataFrame:
    """Adds the seat columns; typed nulls when there is no seat table."""
    if latest is None:
        types = ("timestamp_ntz", "string", "timestamp_ntz")
        return summary.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in zip(SEAT_COLUMNS, types)])
    seats = latest.select(
        "login", F.col("last_activity_at").alias(SEAT_COLUMNS[0]), *SEAT_COLUMNS[1:]
    )
    return summary.join(seats, "login", "left")


def with_inactivity(summary: DataFrame, as_of: AsOf) -> DataFrame:
    """Latest of audit and seat activity, and whole days from it to ``as_of``."""
    latest = F.greatest("last_audit_activity", "copilot_last_activity")
    return summary.withColumn("last_activity", latest).withColumn(
        "days_inactive", t.days_between(F.col("last_activity"), t.ntz(as_of))
    )


def member_summary(
    events: DataFrame, members: DataFrame, seats: DataFrame | None, as_of: AsOf, period_months: int = 3
) -> DataFrame:
    """Every member with activity in the trailing period and the latest seat."""
    activity = member_activity(in_period(events, as_of, period_months))
    summary = join_activity(members, activity)
    summary = join_seats(summary, None if seats is None else latest_seats(seats))
    return with_inactivity(summary, as_of)


def dormant_members(summary: DataFrame, threshold: int = 5) -> DataFrame:
    """Members with at most ``threshold`` events, with their status."""
    return summary.where(F.col("audit_event_count") <= threshold).withColumn(
        "status", dormancy_status(F.col("audit_event_count"), threshold)
    )


def dormancy_kpis(summary: DataFrame, threshold: int = 5) -> DataFrame:
    """One row: members, dormant members, their share in percent, members per status."""
    count = F.col("audit_event_count")
    dormant = count <= threshold
    status = dormancy_status(count, threshold)
    counts = summary.agg(
        F.count("*").alias("total_members"),
        F.count_if(dormant).alias("dormant_count"),
        F.count_if(dormant & (status == STATUS_NONE)).alias("complete_dormant"),
        F.count_if(dormant & (status == STATUS_LOW)).alias("low_activity"),
        F.count_if(dormant & (status == STATUS_WATCH)).alias("watch_needed"),
    )
    ratio = F.when(F.col("total_members") > 0, F.col("dormant_count") / F.col("total_members") * 100)
    return counts.withColumn("dormant_ratio", F.coalesce(ratio, F.lit(0.0)))


def bot_human_split(events: DataFrame, as_of: AsOf, period_months: int = 3) -> DataFrame:
    """One row: bots, other actors and their events in the trailing period.

    Works on one row per actor, so a null actor counts as one human actor.
    """
    actors = count_by(in_period(events, as_of, period_months), "actor", name="n")
    bot = F.coalesce(ends_with_bot_mark(F.col("actor")), F.lit(False))

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return actors.agg(
        F.count_if(bot).alias("bot_actor_count"),
        F.count_if(~bot).alias("human_actor_count"),
        total(bot).alias("bot_event_count"),
        total(~bot).alias("human_event_count"),
    )


def status_counts(dormant: DataFrame) -> DataFrame:
    return ranked(count_by(dormant, "status"), "count", "status")


def monthly_trend(
    events: DataFrame, members: DataFrame, as_of: AsOf, period_months: int = 3, threshold: int = 5
) -> DataFrame:
    """Per month of the period: events of all members, and of the dormant ones.

    One scan: the rows per actor and month, at most one per month of an actor, give the
    actor's total over a window.
    """
    months = (
        in_period(events, as_of, period_months)
        .select("actor", t.month_start(F.col("date_jst")).alias("month"))
        .groupBy("actor", "month")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("actor"))
    logins = members.select("login").distinct()
    return (
        months.withColumn("dormant_n", F.when(total <= threshold, F.col("n")).otherwise(0))
        .join(logins, F.col("actor") == F.col("login"), "left_semi")
        .groupBy("month")
        .agg(F.sum("n").alias("total_events"), F.sum("dormant_n").alias("dormant_events"))
        .orderBy("month")
    )


def trend_long(trend: DataFrame) -> DataFrame:
    """The trend with one row per month and category, and the month as ``yyyy-MM``."""
    long = trend.unpivot("month", ["total_events", "dormant_events"], "series", "events")
    category = F.when(F.col("series") == "total_events", F.lit(TREND_ALL)).otherwise(F.lit(TREND_DORMANT))
    return long.select("month", "events", category.alias("category"), t.year_month(F.col("month")).alias("month_label"))


def dormant_seats(dormant: DataFrame, latest: DataFrame) -> DataFrame:
    """Latest seats held by dormant members."""
    return latest.join(dormant.select("login"), "login", "left_semi")


def seat_profile(seats: DataFrame) -> DataFrame:
    """One row: seats, used ones, never used ones, ones pending cancellation."""
    return seats.agg(
        F.count("*").alias("total_seats"),
        F.count("last_activity_at").alias("active"),
        F.count_if(F.col("last_activity_at").isNull()).alias("never_used"),
        F.count("pending_cancellation_date").alias("pending"),
    )


def seat_usage(dormant: DataFrame, latest: DataFrame) -> DataFrame:
    """One row: dormant seat holders, of them used, never used, pending cancellation."""
    names = {"total_seats": "holders", "active": "used"}
    return seat_profile(dormant_seats(dormant, latest)).withColumnsRenamed(names)


def editor_distribution(dormant: DataFrame, latest: DataFrame) -> DataFrame:
    """Editors last used by dormant seat holders."""
    used = dormant_seats(dormant, latest).where(F.col("last_activity_editor").isNotNull())
    return ranked(count_by(used, "last_activity_editor"), "count", "last_activity_editor")


def former_user_seats(events: DataFrame, members: DataFrame, seats: DataFrame) -> DataFrame:
    """Seats whose holder is a former user."""
    former = former_users(events, members)
    return seats.join(former, seats["login"] == former["actor"], "left_semi")


def histogram_step(range_row: DataFrame, max_bins: int) -> DataFrame:
    """``step`` for the columns smallest and largest: 1, 2 or 5 times a power of ten.

    Each step is a column of its own: nested into one expression, each would hold the one
    before it three times.
    """
    smallest, largest, span, step = (F.col(c) for c in ("smallest", "largest", "span", "step"))
    row = range_row.withColumn("span", F.when(largest > smallest, (largest - smallest).cast("double")).otherwise(F.lit(1.0)))
    level = 0
    while 10**level < max_bins:
        level += 1
    row = row.withColumn("step", F.pow(F.lit(10.0), F.round(F.log10(span)) - level))
    # The start can be too small by a factor of 10 (level) times 10 ** 0.5 (rounding): two widenings do.
    for _ in range(2):
        row = row.withColumn("step", F.when(F.ceil(span / step) > max_bins, step * 10).otherwise(step))
    for divisor in (5, 2):
        row = row.withColumn("step", F.when(span / (step / divisor) <= max_bins, step / divisor).otherwise(step))
    return row.select("step")


def activity_histogram(summary: DataFrame, threshold: int = 5, max_bins: int = 30) -> DataFrame:
    """Members per bin of their event count, split into active and dormant.

    Members shrink to one row per event count first. The bin width is a scalar subquery
    over those rows: nothing comes to the driver.
    """
    count = F.col("audit_event_count")
    values = summary.groupBy(count).agg(F.count("*").alias("n"))
    ends = values.agg(F.min(count).alias("smallest"), F.max(count).alias("largest"))
    step = histogram_step(ends, max_bins).scalar()
    return (
        values.withColumn("bin_step", step)
        .select(
            (F.floor(count / F.col("bin_step")) * F.col("bin_step")).alias("bin_start"),
            "bin_step",
            activity_flag(count, threshold).alias("status"),
            "n",
        )
        .groupBy("bin_start", "bin_step", "status")
        .agg(F.sum("n").alias("members"))
        .orderBy("bin_start", "status")
    )


def dormant_table(dormant: DataFrame) -> DataFrame:
    """Display form of the dormant list: text columns, ``-`` and ``N/A`` for missing values."""
    dash = F.lit("-")
    return dormant.select(
        F.col("login").alias("ユーザー名"),
        F.col("status").alias("ステータス"),
        F.col("audit_event_count").alias("監査ログイベント数"),
        F.col("unique_actions").alias("ユニークアクション数"),
        F.coalesce(t.date_text(F.col("last_audit_activity")), dash).alias("最終監査ログ"),
        F.coalesce(t.date_text(F.col("copilot_last_activity")), dash).alias("最終Copilot利用"),
        F.coalesce("last_activity_editor", dash).alias("エディタ"),
        F.coalesce(F.col("days_inactive").cast("string"), F.lit("N/A")).alias("非アクティブ日数"),
    )


def dormant_export(dormant: DataFrame) -> DataFrame:
    """Export form of the dormant list: empty text and ``-1`` for missing values."""
    empty = F.lit("")
    return dormant.select(
        "login",
        "status",
        "audit_event_count",
        "unique_actions",
        F.coalesce(t.date_text(F.col("last_audit_activity")), empty).alias("last_audit_activity"),
        F.coalesce(t.date_text(F.col("copilot_last_activity")), empty).alias("copilot_last_activity"),
        F.coalesce("last_activity_editor", empty).alias("last_activity_editor"),
        F.coalesce("days_inactive", F.lit(-1)).alias("days_inactive"),
    )
