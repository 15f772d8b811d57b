"""Row filters over events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.labels import contains_bot_mark
from trailspark.functions.timecols import SATURDAY, is_off_hours, ntz
from trailspark.schema import CRITICAL_ACTIONS, HIGH_RISK_ACTIONS

DateRange = tuple[dt.date, dt.date]

# Ties in time are broken by content, so ordered and limited results are repeatable and a
# range sort can split rows that share one instant.
_NEWEST_FIRST = ("action", "actor", "repo", "org", "_source_file")


def _date(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def newest_first(events: DataFrame) -> list:
    ties = [name for name in (*_NEWEST_FIRST, "event_id") if name in events.columns]
    return [F.col("date_jst").desc_nulls_last(), *[F.col(name).asc_nulls_last() for name in ties]]


def date_range_condition(date_range: DateRange):
    """Both dates inclusive, as a half-open range on the timestamp."""
    start, end = (_date(value) for value in date_range)
    time = F.col("date_jst")
    return (time >= ntz(start)) & (time < ntz(end + dt.timedelta(days=1)))


def in_date_range(events: DataFrame, date_range: DateRange | None) -> DataFrame:
    """Events from the start of the first date to the end of the last; all if no range.

    Stored events also carry ``event_date``: the same range on it prunes folders.
    """
    if date_range is None:
        return events
    if "event_date" in events.columns:
        start, end = (_date(value) for value in date_range)
        events = events.where(F.col("event_date").between(F.lit(start), F.lit(end)))
    return events.where(date_range_condition(date_range))


def in_time_range(events: DataFrame, start: dt.datetime | str, end: dt.datetime | str) -> DataFrame:
    """Both instants inclusive. On stored events the dates prune folders."""
    if "event_date" in events.columns:
        first, last = (dt.datetime.fromisoformat(v) if isinstance(v, str) else v for v in (start, end))
        events = events.where(F.col("event_date").between(F.lit(first.date()), F.lit(last.date())))
    return events.where(F.col("date_jst").between(ntz(start), ntz(end)))


def period_start(as_of: dt.datetime | str, period_months: int) -> dt.datetime:
    """A month counts as 30 days."""
    as_of = dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return as_of - dt.timedelta(days=30 * period_months)


def in_period(events: DataFrame, as_of: dt.datetime | str, period_months: int) -> DataFrame:
    """Events since the start of the trailing period. Later events than ``as_of`` stay in."""
    start = period_start(as_of, period_months)
    if "event_date" in events.columns:
        events = events.where(F.col("event_date") >= F.lit(start.date()))
    return events.where(F.col("date_jst") >= ntz(start))


def with_actions(events: DataFrame, actions: Sequence[str] | None) -> DataFrame:
    """Events with one of the actions; all if none are named."""
    return events.where(F.col("action").isin(*actions)) if actions else events


def listed_events(events: DataFrame, actions: Sequence[str]) -> DataFrame:
    """Events with an action of the list; none if the list is empty."""
    return events.where(F.col("action").isin(*actions) if actions else F.lit(False))


def matching(events: DataFrame, search: str | None, literal: bool = False) -> DataFrame:
    """Events whose action, actor or repo matches the search text, ignoring case.

    The text is lower-cased and used as a regular expression, or as plain text with
    ``literal``. A null field neither matches nor hides a match in another field.
    """
    if not search:
        return events
    term = search.lower()

    def hit(name: str):
        text = F.lower(F.col(name))
        return text.contains(term) if literal else text.rlike(term)

    return events.where(hit("action") | hit("actor") | hit("repo"))


def of_actor(rows: DataFrame, actor: str) -> DataFrame:
    return rows.where(F.col("actor") == actor)


def without_bots(events: DataFrame) -> DataFrame:
    """Drops actors with a bot mark anywhere in the name, and rows without actor."""
    return events.where(~contains_bot_mark(F.col("actor")))


def off_hours_events(events: DataFrame, weekend_from: int = SATURDAY) -> DataFrame:
    return events.where(is_off_hours(F.col("date_jst"), weekend_from))


def critical_events(events: DataFrame, actions: Sequence[str] = CRITICAL_ACTIONS) -> DataFrame:
    """Events with a critical action, newest first; an empty list finds none."""
    found = listed_events(events, actions)
    return found.orderBy(*newest_first(found))


def high_risk_events(events: DataFrame, actions: Sequence[str] = HIGH_RISK_ACTIONS) -> DataFrame:
    """Events with a high-risk action, newest first."""
    return critical_events(events, actions)


def latest_events(events: DataFrame, n: int = 100) -> DataFrame:
    return events.orderBy(*newest_first(events)).limit(n)
