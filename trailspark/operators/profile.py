"""Profile of an event table: totals, actor categories, anomaly indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions import timecols as t
from trailspark.functions.labels import in_category, is_suspicious_country
from trailspark.operators.activity import count_by, event_profile, ranked
from trailspark.schema import PROFILE_RISK_ACTIONS, SUSPICIOUS_COUNTRIES

__all__ = ["anomaly_indicators", "category_coverage", "event_profile", "top_values"]

# Login prefixes of the actor categories.
ACTOR_CATEGORIES = {"low_activity": "low-", "former": "former-"}


def top_values(events: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values of a column, null included."""
    return ranked(count_by(events, column), "count", column, n=n)


def category_coverage(events: DataFrame, categories: Mapping[str, str] = ACTOR_CATEGORIES) -> DataFrame:
    """One row: different actors per login prefix."""
    actors = events.select("actor").distinct()
    return actors.agg(*[
        F.count_if(in_category(F.col("actor"), prefix)).alias(f"{name}_actors") for name, prefix in categories.items()
    ])


def anomaly_indicators(
    events: DataFrame,
    risk_actions: Sequence[str] = PROFILE_RISK_ACTIONS,
    countries: Sequence[str] = SUSPICIOUS_COUNTRIES,
) -> DataFrame:
    """One row: late-night, risk-listed, weekend and suspicious-country events."""
    time = F.col("date_jst")
    return events.agg(
        F.count_if(t.is_late_night(time)).alias("late_night"),
        F.count_if(F.col("action").isin(*risk_actions)).alias("dangerous"),
        F.count_if(t.is_weekend(time)).alias("weekend"),
        F.count_if(is_suspicious_country(F.col("country_code"), countries)).alias("suspicious_country"),
    )
