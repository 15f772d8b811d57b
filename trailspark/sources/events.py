"""Audit events: raw JSON records to the canonical event table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.functions import parsing as p
from trailspark.functions.timecols import day
from trailspark.schema import EVENT_SCHEMA, UNKNOWN
from trailspark.sources.text import MAX_DOCUMENT_BYTES, TOO_LARGE, raw_records

MALFORMED = "malformed_json"
NOT_OBJECT = "not_an_object"
BAD_TIME = "bad_timestamp"

_FIELDS = (
    "`@timestamp`: variant, timestamp: variant, action: variant, actor: variant, org: variant, repo: string, "
    "user: string, team: string, actor_ip: string, country_code: string, actor_is_bot: string"
)


class LoadedEvents(NamedTuple):
    """Good rows, and the records that could not be used with the reason."""

    events: DataFrame
    rejects: DataFrame


def _judged(raw: DataFrame) -> DataFrame:
    """Raw records with the parsed ``record``, its time and the ``reject_reason`` (null if good)."""
    record = F.col("record")
    if "_source_path" not in raw.columns:
        raw = raw.withColumn("_source_path", F.col("_source_file"))
    parsed = (
        raw.withColumn("objects", p.parse_objects(F.col("raw"), _FIELDS))
        .withColumn("record", p.only(F.col("objects")))
        # The second key counts only if the first is missing, not if it is null.
        .withColumn("stamp", F.coalesce("record.@timestamp", "record.timestamp"))
    )
    # Only records that gave no object are parsed again, to tell why.
    reason = F.when(F.col("raw").isNull(), F.lit(TOO_LARGE)).when(
        record.isNull(), F.when(p.is_json(F.col("raw")), F.lit(NOT_OBJECT)).otherwise(F.lit(MALFORMED))
    ).when(F.col("date_jst").isNull(), F.lit(BAD_TIME))
    return p.with_event_time(parsed, "stamp", "date_jst").withColumn("reject_reason", reason)


def _event_columns() -> list[Column]:
    record = F.col("record")
    return [
        F.col("date_jst"),
        *[p.text_or_default(record[key], UNKNOWN).alias(key) for key in ("action", "actor", "org")],
        *[record[key].alias(key) for key in ("repo", "user", "team", "actor_ip", "country_code")],
        record["actor_is_bot"].try_cast("boolean").alias("actor_is_bot"),
        F.col("_source_path"),
        F.col("_source_file"),
        F.col("_source_bytes"),
    ]


def parse_events(raw: DataFrame) -> LoadedEvents:
    """Typed events from raw records (columns ``_source_path``, ``_source_file``, ``_source_bytes``, ``raw``).

    Only built-in expressions; each record is parsed once per result. The rows come out of
    a generator that gives no row for the other kind of record. A filter in its place, and
    every later filter, would be pushed below the parsing and parse again.
    """
    judged = _judged(raw)
    is_good = F.col("reject_reason").isNull()
    reject = F.struct("_source_path", "_source_file", "raw", "reject_reason")
    return LoadedEvents(
        judged.select(F.inline(F.when(is_good, F.array(F.struct(*_event_columns()))))),
        judged.select(F.inline(F.when(~is_good, F.array(reject)))),
    )


def load_events(
    spark: SparkSession, paths: str | Sequence[str], layout: str = "auto", max_bytes: int = MAX_DOCUMENT_BYTES
) -> LoadedEvents:
    """Load exported audit logs: any mix of JSON arrays and line-delimited JSON."""
    return parse_events(raw_records(spark, paths, layout, max_bytes))


def ingest_events(
    spark: SparkSession, paths: str | Sequence[str], store: str, layout: str = "auto", mode: str = "append",
    max_bytes: int = MAX_DOCUMENT_BYTES,
) -> None:
    """Load exports into a store in one pass, rejects included (see ``read_rejects``)."""
    store_records(raw_records(spark, paths, layout, max_bytes), store, mode)


def store_records(raw: DataFrame, store: str, mode: str = "append") -> None:
    """Raw records parsed and stored, rejects included."""
    judged = _judged(raw)
    reason = F.col("reject_reason")
    is_good = reason.isNull()
    # A reject has no date and keeps its text; its other event columns are not read.
    time = F.when(is_good, F.col("date_jst")).alias("date_jst")
    rows = judged.select(time, *_event_columns()[1:], F.when(~is_good, F.col("raw")).alias("raw"), reason)
    write_events(rows, store, mode)


def write_events(events: DataFrame, store: str, mode: str = "append") -> None:
    """Store events as Parquet, one folder per UTC+9 date.

    The rebalance hint brings the rows of a date together and lets Spark split a date that
    holds far more rows than others, so no task writes a whole hot day.
    """
    (
        events.withColumn("event_date", day(F.col("date_jst")))
        .hint("rebalance", "event_date")
        .write.partitionBy("event_date")
        .mode(mode)
        .parquet(store)
    )


def _read(spark: SparkSession, store: str, fields: list[T.StructField]) -> DataFrame:
    return spark.read.schema(T.StructType([*fields, T.StructField("event_date", T.DateType())])).parquet(store)


def read_events(spark: SparkSession, store: str) -> DataFrame:
    """Stored events; a date range on them (``filters.in_date_range``) prunes folders."""
    return _read(spark, store, EVENT_SCHEMA.fields).where(F.col("event_date").isNotNull())


def read_rejects(spark: SparkSession, store: str) -> DataFrame:
    """Records an ingest could not use: they are in the folder without date."""
    names = ("_source_path", "_source_file", "raw", "reject_reason")
    stored = _read(spark, store, [T.StructField(name, T.StringType()) for name in names])
    return stored.where(F.col("event_date").isNull()).drop("event_date")
