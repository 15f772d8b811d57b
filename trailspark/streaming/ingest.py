"""Incremental ingest: new export files of a folder go into a store as they come, each once.

A file stream finds the new files and hands on their names; each batch of names is loaded like
any other list of files. Events go to a folder of the batch, then a list of its files is
written, which commits it: readers look only at batches that have such a list. A batch that is
run again after a failure replaces its folder. A file is known by what is in it, so one that is
delivered again, under whatever name, adds nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from trailspark.schema import EVENT_SCHEMA
from trailspark.sources import versions
from trailspark.sources.events import store_records
from trailspark.sources.text import MAX_DOCUMENT_BYTES, raw_records

MAX_FILES = 1_000  # names in one batch; they pass through the driver

_FILE = "path string, modificationTime timestamp, length long, content binary"
_LISTED = "_source_path string, records long, digest string, name string, taken boolean, stream string, batch long"


def file_digests(raw: DataFrame) -> DataFrame:
    """_source_path, records and a digest of each file's records, whatever their order."""
    text = F.coalesce("raw", F.lit(""))
    first, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    return raw.groupBy("_source_path").agg(
        F.count("*").alias("records"),
        F.concat_ws("-", F.count("*"), F.sum(first.cast("decimal(38,0)")), F.sum(second.cast("decimal(38,0)"))).alias("digest"),
    )


def _files(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store}/files"
    if not versions.exists(spark, path):
        return spark.createDataFrame([], _LISTED)
    return spark.read.schema(_LISTED).option("recursiveFileLookup", True).parquet(path)


def ingested_files(spark: SparkSession, store: str) -> DataFrame:
    """Every file seen, and whether its events were taken (not if another file held the same)."""
    return _files(spark, store)


def ingest_stream(
    spark: SparkSession, folder: str, store: str, checkpoint: str, layout: str = "auto", max_files: int = MAX_FILES,
    max_bytes: int = MAX_DOCUMENT_BYTES, before_commit=None, **trigger,
) -> StreamingQuery:
    """Loads files that appear below ``folder`` into ``store``; see ``read_ingested``.

    A file without records is not listed and adds nothing. ``before_commit`` is called with the
    batch number between writing events and committing them (for tests of failures).
    """
    stream = versions.stream_id(spark, checkpoint)
    files = (
        spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files).load(folder)
    )

    def load(batch: DataFrame, number: int) -> None:
        # At most max_files names; what a pattern would read into a name is escaped.
        paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", row["path"]) for row in batch.select("path").collect()]
        if not paths:
            return
        mine = (F.col("stream") == stream) & (F.col("batch") == number)
        known = _files(spark, store).where(F.col("taken") & ~mine).select("digest").distinct().withColumn("known", F.lit(True))
        raw = raw_records(spark, paths, layout, max_bytes)
        found = file_digests(raw).join(known, "digest", "left")
        first = F.row_number().over(Window.partitionBy("digest").orderBy("_source_path")) == 1
        listed = found.select(
            "_source_path", "records", "digest", F.regexp_extract("_source_path", r"([^/]*)$", 1).alias("name"),
            (first & F.col("known").isNull()).alias("taken"), F.lit(stream).alias("stream"), F.lit(number).cast("long").alias("batch"),
        )
        rows = listed.collect()  # as many as files
        taken = spark.createDataFrame([(row["_source_path"],) for row in rows if row["taken"]], "_source_path string")
        store_records(raw.join(taken, "_source_path", "left_semi"), f"{store}/events/stream={stream}/batch={number}", mode="overwrite")
        if before_commit:
            before_commit(number)
        commit = spark.createDataFrame([tuple(row) for row in rows], _LISTED)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{store}/files/{stream}-{number}")

    return files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _committed(spark: SparkSession, store: str, fields: list[T.StructField]) -> DataFrame:
    parts = [T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("event_date", T.DateType())]
    if not versions.exists(spark, f"{store}/events"):
        return spark.createDataFrame([], T.StructType([*fields, *parts]))
    rows = spark.read.schema(T.StructType([*fields, *parts])).parquet(f"{store}/events")
    done = _files(spark, store).select("stream", "batch").distinct()
    return rows.join(done, ["stream", "batch"], "left_semi").drop("stream", "batch")


def read_ingested(spark: SparkSession, store: str) -> DataFrame:
    """Events of all committed batches; a date range on them prunes folders."""
    return _committed(spark, store, EVENT_SCHEMA.fields).where(F.col("event_date").isNotNull())


def read_ingest_rejects(spark: SparkSession, store: str) -> DataFrame:
    """Records of committed batches that could not be used, with the reason."""
    names = ("_source_path", "_source_file", "raw", "reject_reason")
    rows = _committed(spark, store, [T.StructField(name, T.StringType()) for name in names])
    return rows.where(F.col("event_date").isNull()).drop("event_date")
