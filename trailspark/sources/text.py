"""Raw JSON records of export files that are line-delimited or one JSON array each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailspark.functions.parsing import closed, only
from trailspark.sources.pieces import COMPRESSED_NAME, piece_records

RAW_SCHEMA = T.StructType([
    T.StructField("_source_path", T.StringType()),
    T.StructField("_source_file", T.StringType()),
    T.StructField("_source_bytes", T.LongType()),
    T.StructField("raw", T.StringType()),
])

#: A file read as one row has to fit into one value.
MAX_DOCUMENT_BYTES = (1 << 31) - (1 << 20)
TOO_LARGE = "file_too_large"

_SIZE = "_metadata.file_size"
_BLANK = r"^\s*$"
_LINE_NAME = r"\.(ndjson|jsonl)(\.(gz|bz2|zst|lz4|snappy|deflate))?$"


def _decoded(name: str) -> Column:
    # Spark gives names percent-encoded; a plus sign in one is a plus sign.
    return F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B")))


def _provenance() -> list[Column]:
    return [
        _decoded("_metadata.file_path").alias("_source_path"), _decoded("_metadata.file_name").alias("_source_file"),
        F.col(_SIZE).alias("_source_bytes"),
    ]


def _text(spark: SparkSession, paths: str | Sequence[str], whole: bool) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("recursiveFileLookup", True)
    return reader.text(paths, wholetext=True) if whole else reader.text(paths, lineSep="\n")


def _is_line_file() -> Column:
    return F.col("_metadata.file_name").rlike(_LINE_NAME)


def line_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One record per non-blank line; large files split over many tasks."""
    lines = _text(spark, paths, whole=False)
    return lines.where(~F.col("value").rlike(_BLANK)).select(*_provenance(), F.col("value").alias("raw"))


def array_line_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Records of JSON arrays laid out with one element per line; large files split over many tasks.

    The brackets and commas of the array are taken off. Lines of any other layout are passed
    on as they are, to be rejected later.
    """
    lines = line_records(spark, paths)
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("raw", r"\s+$|^\s+", "")), r"^\[\s*(?=\{|$)", ""), r"(?<=^|\})\s*[,\]]\s*$", "")
    return lines.withColumn("raw", bare).where(F.col("raw") != "")


def document_records(spark: SparkSession, paths: str | Sequence[str], max_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """One record per file. Of a file too large for one row the record is null."""
    fitting = _text(spark, paths, whole=True).where(F.col(_SIZE) <= max_bytes)
    # The size is known from the listing: only files beyond it are opened here.
    beyond = _text(spark, paths, whole=False).where(F.col(_SIZE) > max_bytes).select(*_provenance()).distinct()
    return fitting.select(*_provenance(), F.col("value").alias("raw")).unionByName(
        beyond.withColumn("raw", F.lit(None).cast("string"))
    )


def _elements_of(spark: SparkSession, paths: str | Sequence[str], chosen: Column, max_bytes: int, or_lines: bool) -> DataFrame:
    """Elements of the chosen files: whole files up to a size are a row each, others are read in pieces.

    How large a compressed file is inside is not known before, so it is never one row.
    """
    in_pieces = (F.col(_SIZE) > max_bytes) | F.col("_metadata.file_name").rlike(COMPRESSED_NAME)
    small = _text(spark, paths, whole=True).where(chosen & ~in_pieces)
    records = array_elements(small.select(*_provenance(), F.col("value").alias("raw")), or_lines)
    reader = spark.read.option("recursiveFileLookup", True)
    large = reader.text([paths] if isinstance(paths, str) else list(paths), lineSep="}").where(chosen & in_pieces)
    # The listing answers this; only if there are such files is anything read here.
    if large.select(F.lit(1)).isEmpty():
        return records
    return records.unionByName(piece_records(large, _provenance(), max_bytes))


def array_elements(documents: DataFrame, or_lines: bool = False) -> DataFrame:
    """One record per element of the JSON array in each record.

    A record that is no array is passed on as it is, to be rejected later. With ``or_lines``
    one that does not open with a bracket is cut into its non-blank lines.
    """
    parsed = documents.withColumn("parsed", F.from_json(closed(F.col("raw")), "array<array<string>>"))
    rest = F.array("raw")
    if or_lines:
        lines = F.filter(F.split("raw", "\n"), lambda line: ~line.rlike(_BLANK))
        rest = F.when(F.col("raw").rlike(r"^\s*\[") | F.col("raw").isNull(), rest).otherwise(lines)
    # A null among the elements is a record like any other; a null document is one that was not read.
    elements = F.coalesce(F.transform(only(F.col("parsed")), lambda x: F.coalesce(x, F.lit("null"))), rest)
    kept = [c for c in ("_source_path", "_source_file", "_source_bytes") if c in documents.columns]
    return parsed.select(*kept, F.explode(elements).alias("raw"))


def array_records(spark: SparkSession, paths: str | Sequence[str], max_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """One record per element of the JSON array in each file; files beyond ``max_bytes`` split over tasks."""
    return _elements_of(spark, paths, F.lit(True), max_bytes, or_lines=False)


def raw_records(
    spark: SparkSession, paths: str | Sequence[str], layout: str = "auto", max_bytes: int = MAX_DOCUMENT_BYTES
) -> DataFrame:
    """Raw JSON text of every record with its file's path, name and size.

    ``layout`` is ``lines``, ``array``, ``array_lines`` (an array with one element per line)
    or ``auto``: files named ``.ndjson`` or ``.jsonl``, compressed or not, are lines; any other
    may be an array or lines. Up to ``max_bytes`` one task reads such a file whole; a larger or
    compressed one is read in pieces that split over tasks (see ``sources.pieces``), after a pass
    that stores them. Conditions on name and size prune the file listing, so every file is
    opened once, in its own layout.
    """
    if layout == "lines":
        return line_records(spark, paths)
    if layout == "array":
        return array_records(spark, paths, max_bytes)
    if layout == "array_lines":
        return array_line_records(spark, paths)
    if layout != "auto":
        raise ValueError(f"layout must be auto, lines, array or array_lines, not {layout!r}")
    lines = _text(spark, paths, whole=False).where(_is_line_file() & ~F.col("value").rlike(_BLANK))
    others = _elements_of(spark, paths, ~_is_line_file(), max_bytes, or_lines=True)
    return lines.select(*_provenance(), F.col("value").alias("raw")).unionByName(others)
