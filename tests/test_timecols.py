"""Time columns at their boundaries, under several session zones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailspark.functions import timecols as t
from trailspark.operators import series

MOMENTS = [
    dt.datetime(2024, 3, 10, 2, 30, 15, 123456),  # a gap in New York
    dt.datetime(2024, 11, 3, 1, 30),  # twice in New York
    dt.datetime(2024, 3, 31, 2, 0, 1),  # a gap in Berlin
    dt.datetime(2023, 12, 31, 23, 59, 59, 999999),
    dt.datetime(2024, 1, 1),
    dt.datetime(2021, 1, 3, 12),  # Sunday of ISO week 53
    dt.datetime(1969, 7, 20, 20, 17, 40),
]


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Tokyo"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def frame(spark, moments):
    rows = spark.createDataFrame([(str(moment),) for moment in moments], "text string")
    return rows.select(F.col("text").cast("timestamp_ntz").alias("date_jst"))


def test_columns_follow_the_wall_clock(spark, zone):
    c = F.col("date_jst")
    rows = frame(spark, MOMENTS).select(
        c.alias("c"), t.hour_start(c).alias("hour"), t.week_start(c).alias("week"), t.month_start(c).alias("month"),
        t.day(c).alias("day"), t.iso_weekday(c).alias("dow"), t.hour_label(c).alias("label"),
        t.date_text(c).alias("text"), t.wall_clock_micros(c).alias("micros"), t.year_month(c).alias("ym"),
    ).collect()
    assert {row.c for row in rows} == set(MOMENTS)
    for row in rows:
        assert row.hour == row.c.replace(minute=0, second=0, microsecond=0)
        assert row.week == dt.datetime.combine(row.c.date() - dt.timedelta(days=row.c.weekday()), dt.time())
        assert row.month == dt.datetime(row.c.year, row.c.month, 1)
        assert (row.day, row.dow) == (row.c.date(), row.c.isoweekday())
        assert row.label == row.c.strftime("%Y-%m-%d %H:00")
        assert (row.text, row.ym) == (row.c.strftime("%Y-%m-%d"), row.c.strftime("%Y-%m"))
        assert row.micros == (row.c - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_instants_become_utc_plus_nine(spark, zone):
    micros = [0, -1, 1710037815123456, 1730597400000000]
    rows = spark.createDataFrame([(m,) for m in micros], "m long").select("m", t.instant_to_jst(F.col("m")).alias("c"))
    for row in rows.collect():
        assert row.c == dt.datetime(1970, 1, 1, 9) + dt.timedelta(microseconds=row.m)


def test_whole_days_truncate(spark, zone):
    as_of = dt.datetime(2024, 3, 11)
    c = F.col("date_jst")
    rows = frame(spark, [as_of - dt.timedelta(days=1), as_of - dt.timedelta(hours=47, minutes=59),
                         as_of + dt.timedelta(hours=23), as_of + dt.timedelta(hours=25)])
    days = rows.orderBy("date_jst").select(t.days_between(c, t.ntz(as_of))).collect()
    assert [row[0] for row in days] == [1, 1, 0, -1]


@pytest.mark.parametrize("moment, normal, with_friday", [
    ("2024-01-03 08:59:59.999999", True, True),
    ("2024-01-03 09:00:00", False, False),
    ("2024-01-03 17:59:59", False, False),
    ("2024-01-03 18:00:00", True, True),
    ("2024-01-05 12:00:00", False, True),  # Friday
    ("2024-01-06 12:00:00", True, True),  # Saturday
    ("2024-01-07 12:00:00", True, True),  # Sunday
    ("2024-01-08 12:00:00", False, False),  # Monday
])
def test_off_hours(spark, moment, normal, with_friday):
    c = t.ntz(moment)
    row = spark.range(1).select(t.is_off_hours(c).alias("a"), t.is_off_hours(c, t.FRIDAY).alias("b")).first()
    assert (row.a, row.b) == (normal, with_friday)


def test_late_night(spark):
    moments = ["2024-01-01 05:59:59", "2024-01-01 06:00:00", "2024-01-01 21:59:59", "2024-01-01 22:00:00"]
    row = spark.range(1).select(*[t.is_late_night(t.ntz(m)) for m in moments]).first()
    assert tuple(row) == (True, False, False, True)


def test_weekday_names(spark):
    row = spark.range(1).select(*[t.weekday_name(F.lit(n)) for n in range(1, 8)],
                                *[t.weekday_name(F.lit(n), 0) for n in (1, 6, 7)]).first()
    assert tuple(row) == ("月", "火", "水", "木", "金", "土", "日", "火", "日", "不明")


def test_series(spark, zone):
    events = frame(spark, MOMENTS + [MOMENTS[0]])
    for name in series.GRANULARITIES:
        rows = series.activity_series(events, name).collect()
        assert sum(row["count"] for row in rows) == len(MOMENTS) + 1
        assert [row.period for row in rows] == sorted({row.period for row in rows})
    week = {row.period_str: row["count"] for row in series.weekly_series(events).collect()}
    assert week["2024-03-04〜"] == 2 and week["2020-12-28〜"] == 1
    month = {row.period: (row.period_str, row["count"]) for row in series.monthly_series(events).collect()}
    assert month["2024-03"] == ("2024年3月", 3) and month["2023-12"] == ("2023年12月", 1)
    with pytest.raises(ValueError):
        series.activity_series(events, "year")


def test_distributions(spark):
    events = frame(spark, [dt.datetime(2024, 1, 5, 9), dt.datetime(2024, 1, 5, 9, 30), dt.datetime(2024, 1, 7, 18)])
    hours = [tuple(row) for row in series.hour_distribution(events).collect()]
    assert hours == [(9, 2, True), (18, 1, False)]
    days = [tuple(row) for row in series.weekday_distribution(events).collect()]
    assert days == [(5, 2, "金", False), (7, 1, "日", True)]
    shifted = [tuple(row) for row in series.weekday_distribution(events, t.FRIDAY, 0).collect()]
    assert shifted == [(5, 2, "土", True), (7, 1, "不明", True)]
    assert tuple(series.peak_hour(events).first()) == (9, 2)
