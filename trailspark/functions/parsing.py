"""Reading values out of raw JSON records without losing the missing/null difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.functions.timecols import NTZ, instant_to_jst

# Numbers above this are milliseconds, others are seconds.
MILLISECOND_LIMIT = 10**12
_FIRST_MICRO, _LAST_MICRO = -62_135_596_800_000_000, 253_402_268_399_999_999
_NUMBER = r"^\s*[+-]?\d+(\.\d+)?\s*$"
_LOCAL = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?$"
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)$"


def closed(raw: Column) -> Column:
    """A text as the first of two elements of a JSON array, the second being null.

    A bare parse stops after the first value and would accept ``{"a":1} trailing``. Inside
    an array, anything after the value breaks the array or changes its length, even a
    closing bracket.
    """
    return F.concat(F.lit("["), raw, F.lit(",null]"))


def only(elements: Column) -> Column:
    """The value of a ``closed`` text; null if the text was not exactly one value."""
    is_one = (F.size(elements) == 2) & F.get(elements, F.lit(1)).isNull()
    return F.when(is_one, F.get(elements, F.lit(0)))


def parse_objects(raw: Column, fields: str) -> Column:
    """The JSON object in a text, cut down to ``fields`` (a DDL list), ready for ``only``.

    A ``variant`` field is SQL NULL if its key is missing and variant null if its value is
    null; any other type cannot tell the two apart.
    """
    return F.from_json(closed(raw), f"array<struct<{fields}>>", {"allowSingleQuotes": "false"})


def is_json(raw: Column) -> Column:
    """Whether a text is JSON values at all; for naming the fault of rejected records."""
    return F.try_variant_get(F.try_parse_json(closed(raw)), "$[1]", "variant").isNotNull()


def text_or_default(member: Column, default: str) -> Column:
    """Text of a variant field. The default replaces a missing key only; null stays null."""
    return F.when(member.isNull(), F.lit(default)).otherwise(F.try_variant_get(member, "$", "string"))


def with_event_time(df: DataFrame, stamp: str, name: str) -> DataFrame:
    """Adds the zone-less UTC+9 time of a raw timestamp value, null if it is none.

    Numbers (and digit-only strings) are epoch milliseconds or seconds; other strings are
    ISO-8601, taken as UTC when they carry no zone. Each step is a column of its own: steps
    used more than once would otherwise be repeated inside one huge expression.
    """
    value, kind, text = F.col(stamp), F.col("_kind"), F.col("_text")
    whole, number, micros = F.col("_whole"), F.col("_number"), F.col("_micros")
    is_text = kind == "STRING"
    fraction = (kind == "DOUBLE") | kind.startswith("DECIMAL")

    def scaled(value: Column) -> Column:
        return F.try_multiply(value, F.when(value > MILLISECOND_LIMIT, F.lit(1_000)).otherwise(F.lit(1_000_000)))

    return (
        df.withColumn("_kind", F.schema_of_variant(value))
        .withColumn("_text", F.when(is_text, F.try_variant_get(value, "$", "string")))
        .withColumn("_whole", F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")))
        .withColumn(
            "_number",
            F.when(fraction, F.try_variant_get(value, "$", "decimal(38,9)"))
            .when(text.rlike(_NUMBER), F.trim(text).try_cast("decimal(38,9)")),
        )
        .withColumn(
            "_micros",
            F.coalesce(
                scaled(whole),
                F.round(scaled(number)).try_cast("bigint"),
                F.when(text.rlike(_ZONED), F.unix_micros(text.try_cast("timestamp"))),
            ),
        )
        .withColumn(
            name,
            F.coalesce(
                F.when(micros.between(_FIRST_MICRO, _LAST_MICRO), instant_to_jst(micros)),
                F.when(text.rlike(_LOCAL), text.try_cast(NTZ)) + F.make_dt_interval(F.lit(0), F.lit(9)),
            ),
        )
        .drop("_kind", "_text", "_whole", "_number", "_micros")
    )


def seat_time(text: Column) -> Column:
    """Seat time: zoned values move to UTC+9, local values and plain dates stay as they are.

    Null and empty give null; other text that is no time stops the load.
    """
    zoned = F.when(text.rlike(_ZONED), instant_to_jst(F.unix_micros(text.try_cast("timestamp"))))
    local = F.when(text.rlike(_LOCAL), text.try_cast(NTZ))
    bad = F.when(text != "", F.raise_error(F.concat(F.lit("not a seat time: "), text)).cast(NTZ))
    return F.coalesce(zoned, local, bad)
