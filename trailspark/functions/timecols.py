"""Time columns over zone-less timestamps.

``date_trunc`` and ``timestampdiff`` first convert a zone-less value to the session zone,
which moves values around a daylight-saving change. The expressions here stay on dates and
zone-less timestamps, so results do not depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.schema import (
    CLOSING_HOUR,
    OPENING_HOUR,
    UNKNOWN_WEEKDAY,
    WEEKDAY_NAMES,
)

NTZ = "timestamp_ntz"
JST_OFFSET = dt.timedelta(hours=9)
SATURDAY = 6
FRIDAY = 5


def ntz(value: dt.datetime | dt.date | str | Column) -> Column:
    """A zone-less timestamp literal (a Python datetime would become a zoned one)."""
    if isinstance(value, Column):
        return value.cast(NTZ)
    return F.lit(str(value)).cast(NTZ)


def hour_start(c: Column) -> Column:
    return F.to_date(c).cast(NTZ) + F.make_dt_interval(F.lit(0), F.hour(c))


def day(c: Column) -> Column:
    return F.to_date(c)


def week_start(c: Column) -> Column:
    """Monday 00:00 of the week."""
    return F.trunc(F.to_date(c), "week").cast(NTZ)


def month_start(c: Column) -> Column:
    return F.trunc(F.to_date(c), "month").cast(NTZ)


def iso_weekday(c: Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(F.to_date(c)) + 1


def weekday_name(weekday: Column, first: int = 1) -> Column:
    """Name of a weekday number; ``first`` is the number of Monday.

    ISO numbers need ``first=1``. ``first=0`` looks ISO numbers up in a zero-based table:
    every name is one day late and Sunday is unknown.
    """
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.coalesce(F.get(names, weekday - first), F.lit(UNKNOWN_WEEKDAY))


def date_text(c: Column) -> Column:
    """``yyyy-MM-dd``."""
    return F.to_date(c).cast("string")


def hour_label(c: Column) -> Column:
    """``yyyy-MM-dd HH:00``."""
    return F.concat(date_text(c), F.lit(" "), F.lpad(F.hour(c).cast("string"), 2, "0"), F.lit(":00"))


def week_label(c: Column) -> Column:
    return F.concat(date_text(c), F.lit("〜"))


def month_key(year: Column, month: Column) -> Column:
    """``yyyy-MM``."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def month_label(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("年"), month.cast("string"), F.lit("月"))


def year_month(c: Column) -> Column:
    return month_key(F.year(c), F.month(c))


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days, truncated toward zero; null if either side is."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def is_weekend(c: Column, weekend_from: int = SATURDAY) -> Column:
    return iso_weekday(c) >= weekend_from


def is_business_hour(c: Column) -> Column:
    return business_hour_number(F.hour(c))


def business_hour_number(hour: Column) -> Column:
    return (hour >= OPENING_HOUR) & (hour < CLOSING_HOUR)


def is_off_hours(c: Column, weekend_from: int = SATURDAY) -> Column:
    """Before 9:00, from 18:00 on, or a weekend day.

    ``weekend_from=5`` counts Friday as weekend, which is what comparing ISO weekday
    numbers with a zero-based limit gives.
    """
    return ~is_business_hour(c) | is_weekend(c, weekend_from)


def is_late_night(c: Column) -> Column:
    return (F.hour(c) >= 22) | (F.hour(c) < 6)


def instant_to_jst(micros: Column) -> Column:
    """Microseconds since 1970 UTC to a zone-less UTC+9 timestamp."""
    return ntz("1970-01-01 09:00:00") + F.lit(dt.timedelta(microseconds=1)) * micros


def wall_clock_micros(c: Column) -> Column:
    """Microseconds from 1970-01-01 00:00 to a zone-less timestamp on the same clock."""
    seconds = F.unix_date(F.to_date(c)) * F.lit(86_400).cast("bigint") + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
