"""Members and licence seats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.functions import parsing as p
from trailspark.schema import SEAT_DOCUMENT_SCHEMA, SEAT_SCHEMA, UNKNOWN
from trailspark.sources.text import MAX_DOCUMENT_BYTES, document_records, line_records, raw_records


def parse_members(raw: DataFrame) -> DataFrame:
    """Members from raw JSON records; a record that is no JSON object stops the load."""
    member = F.col("member")
    fault = F.raise_error(F.concat(F.lit("not a member record: "), F.col("raw")))
    fields = "login: string, id: bigint, type: variant, site_admin: variant"
    parsed = raw.withColumn("objects", p.parse_objects(F.col("raw"), fields)).withColumn(
        "member", p.only(F.col("objects"))
    )
    login = F.when(member.isNull(), fault.cast("string")).otherwise(member["login"])
    admin = F.try_variant_get(member["site_admin"], "$", "boolean")
    return parsed.select(
        login.alias("login"),
        member["id"].alias("id"),
        p.text_or_default(member["type"], "User").alias("type"),
        F.when(member["site_admin"].isNull(), F.lit(False)).otherwise(admin).alias("site_admin"),
    )


def load_members(
    spark: SparkSession, paths: str | Sequence[str], layout: str = "array", max_bytes: int = MAX_DOCUMENT_BYTES
) -> DataFrame:
    """Members export: a JSON array of accounts."""
    return parse_members(raw_records(spark, paths, layout, max_bytes))


def parse_seat_documents(raw: DataFrame) -> DataFrame:
    """``total_seats`` and ``seats`` of every raw document; anything but one document stops the load.

    The declared schema keeps columns typed even if every value in a file is null.
    """
    documents = F.from_json(p.closed(F.col("raw")), T.ArrayType(SEAT_DOCUMENT_SCHEMA), {"mode": "FAILFAST"})
    fault = F.raise_error(F.concat(F.lit("not one seat document: "), "_source_file")).cast(SEAT_DOCUMENT_SCHEMA)
    one = F.coalesce(p.only(F.col("documents")), fault)
    origin = [c for c in ("_source_path", "_source_file") if c in raw.columns]
    return (
        raw.select(*origin, documents.alias("documents"))
        .select(*origin, one.alias("document"))
        .select("document.*", *origin)
    )


def read_seat_documents(spark: SparkSession, paths: str | Sequence[str], layout: str = "document") -> DataFrame:
    """Seat exports: one JSON document per file, or per line with ``layout="lines"``."""
    raw = document_records(spark, paths) if layout == "document" else line_records(spark, paths)
    return parse_seat_documents(raw)


def flatten_seats(documents: DataFrame) -> DataFrame:
    """One row per seat of all documents."""
    # An expression, not the bare column: Spark would filter on a bare column's size below
    # the parsing and so parse every document twice.
    seat = documents.select(F.inline(F.coalesce("seats", F.array())))
    return seat.select(
        F.col("assignee.login").alias("login"),
        F.col("assignee.id").alias("user_id"),
        F.col("organization.login").alias("org_name"),
        p.seat_time(F.col("created_at")).alias("created_at"),
        p.seat_time(F.col("last_activity_at")).alias("last_activity_at"),
        "last_activity_editor",
        p.seat_time(F.col("pending_cancellation_date")).alias("pending_cancellation_date"),
    ).select(*SEAT_SCHEMA.names)


def load_seats(spark: SparkSession, paths: str | Sequence[str], layout: str = "document") -> DataFrame:
    """Seats of all organisations; a login in several organisations has several rows."""
    return flatten_seats(read_seat_documents(spark, paths, layout))


def seat_file_summary(documents: DataFrame) -> DataFrame:
    """Per document: organisation of its first seat (``unknown`` if none) and seat count."""
    first_org = F.get(F.col("seats"), F.lit(0))["organization"]["login"]
    return documents.select(
        *[c for c in ("_source_path", "_source_file") if c in documents.columns],
        F.coalesce(first_org, F.lit(UNKNOWN)).alias("org_name"),
        F.coalesce(F.size("seats"), F.lit(0)).cast("bigint").alias("seat_count"),
    )
