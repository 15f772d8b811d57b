"""Writing reports and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.operators.lists import paged_lists

PAGE_SIZE = 10_000


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV part files, each with a header, written by the executors."""
    df.write.option("header", True).option("emptyValue", "").option("nullValue", "").mode(mode).csv(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line. Null fields are left out."""
    df.write.mode(mode).json(path)


def seat_documents(seats: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Seat table back to nested documents ``{total_seats, seats: [...]}``.

    The seats of an organisation are spread over documents of about ``page_size`` seats,
    numbered by ``page`` from 0, because one document is one row in one task. Each carries
    the organisation's ``total_seats``. Loading all of them gives every seat.
    """
    def stamp(name: str):
        # Stored times are on the UTC+9 clock; the zone is written so they read back the same.
        return F.concat(F.replace(F.col(name).cast("string"), F.lit(" "), F.lit("T")), F.lit("+09:00")).alias(name)

    seat = F.struct(
        stamp("created_at"),
        stamp("pending_cancellation_date"),
        stamp("last_activity_at"),
        "last_activity_editor",
        F.struct(F.col("login"), F.col("user_id").alias("id")).alias("assignee"),
        F.struct(F.col("org_name").alias("login")).alias("organization"),
    )
    pages = paged_lists(seats.select("org_name", seat.alias("seat")), "org_name", "seat", page_size)
    return pages.select(
        "org_name",
        "page",
        F.col("total").cast("bigint").alias("total_seats"),
        F.col("items").alias("seats"),
    )


def write_seat_documents(seats: DataFrame, path: str, page_size: int = PAGE_SIZE, mode: str = "error") -> None:
    """One line-delimited document per organisation page."""
    seat_documents(seats, page_size).select("total_seats", "page", "seats").write.option(
        "ignoreNullFields", False
    ).mode(mode).json(path)
