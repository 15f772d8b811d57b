"""Collecting values per key into lists of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paged_lists(rows: DataFrame, key: str, item: str, page_size: int, more_than: int = 0) -> DataFrame:
    """``key``, ``total``, ``page``, ``items``: all items of a key in pages of about ``page_size``.

    Keys with ``more_than`` items or fewer give no row.

    A key with at most ``page_size`` items has one page. A larger one is spread by the hash
    of the item, and equal copies are counted first and then cut into runs that are spread
    too, so no task ever holds a whole hot key. Nothing is left out; items are sorted within
    a page. The explicit repartition lets Spark split a skewed join in front of it.
    """
    counted = rows.groupBy(key, item).agg(F.count("*").alias("copies"))
    totals = counted.groupBy(F.col(key).alias("_key")).agg(F.sum("copies").alias("total"))
    totals = totals.where(F.col("total") > more_than)
    runs = counted.select(
        key, item, "copies",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {page_size}"))).alias("run"),
    )
    length = F.least(F.lit(page_size).cast("bigint"), F.col("copies") - F.col("run") * page_size).cast("int")
    pages = F.expr(f"(total - 1) div {page_size} + 1")
    placed = (
        runs.join(totals, F.col(key).eqNullSafe(F.col("_key")))
        .select(
            key, "total",
            F.pmod(F.xxhash64(item, "run"), pages).alias("page"),
            F.array_repeat(item, length).alias("piece"),
        )
        .repartition(key, "page")
    )
    return (
        placed.groupBy(key, "total", "page")
        .agg(F.flatten(F.collect_list("piece")).alias("items"))
        .withColumn("items", F.array_sort("items"))
    )
