"""Audit-log analytics as Spark DataFrame functions."""

from trailspark.plans.reports import (
    activity_series,
    dormancy_report,
    dormant_trend,
    risk_report,
    track_actions,
    user_report,
)
from trailspark.sources.directory import load_members, load_seats
from trailspark.sources.events import ingest_events, load_events, read_events, read_rejects, write_events

__all__ = [
    "activity_series",
    "dormancy_report",
    "dormant_trend",
    "ingest_events",
    "load_events",
    "load_members",
    "load_seats",
    "read_events",
    "read_rejects",
    "risk_report",
    "track_actions",
    "user_report",
    "write_events",
]
