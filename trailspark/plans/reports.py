"""One function per report. Results are lazy; nothing runs before an action on them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import timecols as t
from trailspark.operators import activity, anomaly, dormancy, filters, series


def dormancy_report(
    events: DataFrame,
    members: DataFrame,
    seats: DataFrame | None,
    as_of: dt.datetime | str,
    period_months: int = 3,
    threshold: int = 5,
) -> DataFrame:
    """Dormant members with status, activity, seat and days inactive, least active first."""
    summary = dormancy.member_summary(events, members, seats, as_of, period_months)
    return dormancy.dormant_members(summary, threshold).orderBy("audit_event_count", "login", "id")


def dormant_trend(
    events: DataFrame, members: DataFrame, as_of: dt.datetime | str, period_months: int = 3, threshold: int = 5
) -> DataFrame:
    """Monthly events of all and of dormant members in long form."""
    return dormancy.trend_long(dormancy.monthly_trend(events, members, as_of, period_months, threshold))


class RiskReport(NamedTuple):
    summary: DataFrame
    critical_events: DataFrame
    high_risk_events: DataFrame
    off_hours_share: DataFrame
    off_hours_by_actor: DataFrame
    bulk_operations: DataFrame
    multi_ip_actors: DataFrame


def risk_report(
    events: DataFrame,
    date_range: filters.DateRange | None = None,
    bulk_threshold: int = 50,
    scope: str = "as_written",
    weekend_from: int = t.SATURDAY,
) -> RiskReport:
    """Risk score and every list behind it (``scope`` as in ``anomaly.risk_summary``)."""
    in_range = filters.in_date_range(events, date_range)
    rest = in_range if scope == "filtered" else events
    return RiskReport(
        anomaly.risk_summary(events, date_range, bulk_threshold, scope, weekend_from),
        filters.critical_events(in_range),
        filters.high_risk_events(in_range),
        anomaly.off_hours_share(rest, weekend_from),
        anomaly.off_hours_by_actor(rest, weekend_from=weekend_from),
        anomaly.bulk_operations(rest, bulk_threshold),
        anomaly.multi_ip_actors(rest),
    )


def activity_series(
    events: DataFrame, granularity: str = "day", date_range: filters.DateRange | None = None
) -> DataFrame:
    return series.activity_series(filters.in_date_range(events, date_range), granularity)


class ActionReport(NamedTuple):
    totals: DataFrame
    actions: DataFrame
    repos: DataFrame
    teams: DataFrame
    latest: DataFrame


def track_actions(
    events: DataFrame,
    date_range: filters.DateRange | None = None,
    actions: Sequence[str] | None = None,
    search: str | None = None,
    literal: bool = False,
) -> ActionReport:
    """Events matching date range, actions and search text, ranked by action, repo and team."""
    found = filters.in_date_range(events, date_range)
    found = filters.matching(filters.with_actions(found, actions), search, literal)
    per_action = activity.count_by(found, "action")
    totals = per_action.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("matched_events"), F.count("*").alias("matched_actions")
    )
    return ActionReport(
        totals,
        activity.action_distribution(found),
        activity.top_repos(found),
        activity.top_teams(found),
        filters.latest_events(found),
    )


class UserReport(NamedTuple):
    totals: DataFrame
    actors: DataFrame
    top_actors: DataFrame
    actor_actions: DataFrame
    user_actions: DataFrame | None


def user_report(
    events: DataFrame,
    date_range: filters.DateRange | None = None,
    top_n: int = 10,
    exclude_bots: bool = True,
    user: str | None = None,
) -> UserReport:
    """Actor totals, ranking and action breakdown; ``user`` adds the breakdown of one actor."""
    found = filters.in_date_range(events, date_range)
    breakdown = activity.actor_actions(found)
    return UserReport(
        activity.user_totals(found),
        activity.events_per_actor(found),
        activity.top_actors(found, top_n, exclude_bots),
        breakdown,
        None if user is None else filters.of_actor(breakdown, user),
    )
