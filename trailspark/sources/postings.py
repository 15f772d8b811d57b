"""Finding stored events without reading all of them: postings of values, and newest folders first.

Both use the date folders of the store. The postings hold each value of a searched field once
for each date it occurs on, which is far less than the events; a search looks its term up there
first and then opens the folders of the dates found only.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.operators.filters import latest_events, listed_events, matching
from trailspark.sources import versions
from trailspark.sources.events import read_events

FIELDS = ("action", "actor", "repo")  # those a text search looks at
MAX_DATES = 40_000  # a century of folders; their dates pass through the driver

_POSTINGS = "field string, value string, event_date date"


def postings_of(events: DataFrame) -> DataFrame:
    """field, value, event_date: each different value of each searched field and date."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]))
    return events.select("event_date", values.alias("x")).select("x.*", "event_date").where("value IS NOT NULL").distinct()


def index_store(spark: SparkSession, store: str, index: str) -> None:
    """Postings of dates the index lacks or whose number of events has changed since.

    Only those folders are read again. The list of dates is written last: a broken run is repeated.
    """
    counts = f"{index}/dates"
    now = read_events(spark, store).groupBy("event_date").agg(F.count("*").alias("n"))
    number, known = versions.read_version(spark, counts, "event_date date, n long")
    before = {row["event_date"]: row["n"] for row in known}
    found = now.limit(MAX_DATES + 1).collect()
    if len(found) > MAX_DATES:
        raise ValueError(f"more than {MAX_DATES} dates in {store}")
    stale = [row["event_date"] for row in found if before.get(row["event_date"]) != row["n"]]
    if stale:
        events = read_events(spark, store).where(F.col("event_date").isin(stale))
        by_date = postings_of(events).repartition("event_date")
        by_date.write.partitionBy("event_date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{index}/postings")
    versions.write_version(spark.createDataFrame([tuple(row) for row in found], "event_date date, n long"), counts, number + 1)


def dates_with(spark: SparkSession, index: str, search: str, literal: bool = False) -> list[dt.date]:
    """The dates on which a value matches, as ``filters.matching`` matches it."""
    term, value = search.lower(), F.lower("value")
    postings = spark.read.schema(_POSTINGS).parquet(f"{index}/postings")
    hit = value.contains(term) if literal else value.rlike(term)
    return sorted(row["event_date"] for row in postings.where(hit).select("event_date").distinct().collect())


def search_store(spark: SparkSession, store: str, index: str, search: str, literal: bool = False) -> DataFrame:
    """Stored events that ``filters.matching`` finds, from the folders of the dates found in the index only."""
    dates = dates_with(spark, index, search, literal)
    return matching(read_events(spark, store).where(F.col("event_date").isin(dates)), search, literal)


def store_dates(spark: SparkSession, store: str) -> list[dt.date]:
    """The dates of the store's folders, newest first; no file is opened."""
    system, folder = versions.folder_of(spark, store)
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    found = [re.fullmatch(r"event_date=(\d{4,}-\d\d-\d\d)", name) for name in names]
    return sorted((dt.date.fromisoformat(m[1]) for m in found if m), reverse=True)


def newest_dates(spark: SparkSession, store: str, n: int = 100, actions=None) -> list[dt.date]:
    """As many of the newest dates as hold ``n`` events (of the actions, if given), or all dates.

    Twice as many folders are counted at each step, so at most about twice as many as needed.
    """
    dates, taken, have = store_dates(spark, store), 0, 0
    while have < n and taken < len(dates):
        step = dates[taken : 2 * taken + 1]
        events = read_events(spark, store).where(F.col("event_date").isin(step))
        events = events if actions is None else listed_events(events, actions)
        have += events.limit(n).count()
        taken += len(step)
    return dates[:taken]


def latest_stored(spark: SparkSession, store: str, n: int = 100, actions=None) -> DataFrame:
    """The ``n`` newest stored events, ties as in ``filters.latest_events``, from the newest folders only.

    Every event of an older folder is older than any of a newer one, so once the newest folders
    hold ``n`` events no other can be among them.
    """
    dates = newest_dates(spark, store, n, actions)
    events = read_events(spark, store).where(F.col("event_date").isin(dates))
    return latest_events(events if actions is None else listed_events(events, actions), n)
