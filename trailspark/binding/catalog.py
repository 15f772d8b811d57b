"""Every operator as a query on the benchmark tables, with its SQL twin.

Each query reads whole tables. Queries about files write them below the scratch folder and
read them back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.binding import tables as b
from trailspark.binding.views import CRITICAL, HIGH_RISK, IN_RANGE, OFF_HOURS, PROFILE_RISK, with_views
from trailspark.functions import labels, parsing
from trailspark.functions import timecols as t
from trailspark.operators import activity, addresses, anomaly, dormancy, filters, profile, series, sketches
from trailspark.plans import reports
from trailspark.session import scratch_path
from trailspark.sources import directory, postings, sinks
from trailspark.sources import events as event_source
from trailspark.streaming import detections, hourly, ingest

ACTIONS = ("git.push", "repo.destroy", "org.invite_member")
SEARCH = r"USER-1\d?$|repo-7"
DRILL_DOWN = "user-5"
TIME_RANGE = ("2023-11-20 08:15:00", "2024-01-03 00:00:00")


class Model:
    """The bound tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return b.table(self.spark, self.sf_dir, name)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)

    @cached_property
    def events(self) -> DataFrame:
        return b.events(self.spark, self.sf_dir)

    @cached_property
    def members(self) -> DataFrame:
        return b.members(self.spark, self.sf_dir)

    @cached_property
    def seats(self) -> DataFrame:
        return b.seats(self.spark, self.sf_dir)

    @cached_property
    def in_range(self) -> DataFrame:
        return filters.in_date_range(self.events, b.DATE_RANGE)

    @cached_property
    def activity(self) -> DataFrame:
        return dormancy.member_activity(filters.in_period(self.events, b.AS_OF, b.PERIOD_MONTHS))

    @cached_property
    def summary(self) -> DataFrame:
        return dormancy.member_summary(self.events, self.members, self.seats, b.AS_OF, b.PERIOD_MONTHS)

    @cached_property
    def counts(self) -> DataFrame:
        """Members with event counts; all that counting reports need."""
        return dormancy.join_activity(self.members, self.activity)

    @cached_property
    def counted_dormant(self) -> DataFrame:
        return dormancy.dormant_members(self.counts, b.DORMANT_THRESHOLD)

    @cached_property
    def dormant(self) -> DataFrame:
        return dormancy.dormant_members(self.summary, b.DORMANT_THRESHOLD)

    @cached_property
    def latest(self) -> DataFrame:
        return dormancy.latest_seats(self.seats)

    @cached_property
    def trend(self) -> DataFrame:
        return dormancy.monthly_trend(self.events, self.members, b.AS_OF, b.PERIOD_MONTHS, b.DORMANT_THRESHOLD)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Registers a function of a ``Model`` under its name, with its SQL twin."""

    def register(function: Callable[[Model], DataFrame]):
        key = name or function.__name__
        QUERIES[key] = lambda spark, sf_dir: function(Model(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return function

    return register


EVENT_COLUMNS = ("date_jst", "action", "actor", "org", "repo", "user", "team", "actor_ip", "country_code",
                 "actor_is_bot", "_source_path", "_source_file", "_source_bytes")
_EVENTS_SQL = ", ".join(f'"{name}"' for name in EVENT_COLUMNS)

_FIELDS = ("action", "actor", "org", "repo", "user", "team", "actor_ip", "country_code", "actor_is_bot")

# ---------------------------------------------------------------- sources and sinks

_BROKEN = "(event_id % 97 = 0 OR event_id % 107 = 0 OR event_id % 109 = 0)"
_NO_TIME = "(event_id % 101 = 0 OR event_id % 103 = 0)"


@query(f"""
  SELECT CASE WHEN event_id % 6 IN (0, 5) THEN date_trunc('millisecond', date_jst) ELSE date_jst END AS date_jst,
    CASE WHEN event_id % 17 = 0 THEN 'unknown' ELSE action END AS action,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 OR actor IS NULL THEN 'unknown' ELSE actor END AS actor,
    org, repo, "user", team, actor_ip, country_code, actor_is_bot, _source_path, _source_file, _source_bytes
  FROM ev WHERE NOT {_BROKEN} AND NOT {_NO_TIME}""")
def s01_load_events(m: Model) -> DataFrame:
    lines = b.raw_event_lines(m.events)
    return event_source.parse_events(lines).events


@query(f"""
  SELECT _source_file, CASE WHEN event_id % 97 = 0 OR event_id % 107 = 0 THEN 'malformed_json'
    WHEN event_id % 109 = 0 THEN 'not_an_object' ELSE 'bad_timestamp' END AS reject_reason, count(*) AS records
  FROM ev WHERE {_BROKEN} OR {_NO_TIME} GROUP BY 1, 2""")
def s01_rejected_records(m: Model) -> DataFrame:
    lines = b.raw_event_lines(m.events)
    rejects = event_source.parse_events(lines).rejects
    return activity.count_by(rejects, "_source_file", "reject_reason", name="records")


_ARRAYS_SQL = """
  SELECT date_trunc('millisecond', date_jst) AS date_jst, action, coalesce(actor, 'unknown') AS actor, org, repo,
    "user", team, actor_ip, country_code, actor_is_bot, _source_file FROM ev"""


def _array_files(m: Model, **limit: int) -> DataFrame:
    path = m.scratch("event-arrays")
    b.write_documents(b.raw_event_arrays(m.events), "_source_file", path)
    loaded = event_source.load_events(m.spark, path, **limit).events
    return loaded.select("date_jst", *_FIELDS, b.folder_name().alias("_source_file"))


@query(_ARRAYS_SQL)
def s02_array_documents(m: Model) -> DataFrame:
    return _array_files(m)


@query(_ARRAYS_SQL)
def s02_arrays_in_pieces(m: Model) -> DataFrame:
    return _array_files(m, max_bytes=1 << 16)


def _exported(events: DataFrame, *more: str) -> DataFrame:
    """Events under the keys of an export."""
    stamp = F.replace((F.col("date_jst") - F.make_dt_interval(F.lit(0), F.lit(9))).cast("string"), F.lit(" "), F.lit("T"))
    return events.select(F.concat(stamp, F.lit("Z")).alias("@timestamp"), *_FIELDS, *more)


@query("""
  SELECT date_jst, action, coalesce(actor, 'unknown') AS actor, org, repo, "user", team, actor_ip, country_code,
    actor_is_bot, _source_file AS folder FROM ev""")
def s03_multi_file_load(m: Model) -> DataFrame:
    path = m.scratch("events-json")
    _exported(m.events, "_source_file").withColumnRenamed("_source_file", "folder").write.partitionBy("folder").json(path)
    loaded = event_source.load_events(m.spark, [path]).events
    return loaded.select("date_jst", *_FIELDS, F.regexp_extract("_source_path", "/folder=([^/]*)/", 1).alias("folder"))


@query(f"""
  SELECT CASE WHEN event_id % 6 IN (0, 5) THEN date_trunc('millisecond', date_jst) ELSE date_jst END AS date_jst,
    date_jst::DATE AS event_date, CASE WHEN event_id % 17 = 0 THEN 'unknown' ELSE action END AS action,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 OR actor IS NULL THEN 'unknown' ELSE actor END AS actor,
    org, repo, "user", team, actor_ip, country_code, actor_is_bot
  FROM ev WHERE NOT {_BROKEN} AND NOT {_NO_TIME} AND {IN_RANGE}""")
def s03_ingested_store(m: Model) -> DataFrame:
    lines, store = m.scratch("event-lines"), m.scratch("event-store")
    b.raw_event_lines(m.events).select("raw").write.text(lines)
    event_source.ingest_events(m.spark, lines, store, layout="lines")
    stored = filters.in_date_range(event_source.read_events(m.spark, store), b.DATE_RANGE)
    return stored.select("date_jst", "event_date", *_FIELDS)


@query(f"""
  SELECT CASE WHEN event_id % 6 IN (0, 5) THEN date_trunc('millisecond', date_jst) ELSE date_jst END AS date_jst,
    date_jst::DATE AS event_date, CASE WHEN event_id % 17 = 0 THEN 'unknown' ELSE action END AS action,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 OR actor IS NULL THEN 'unknown' ELSE actor END AS actor,
    org, repo, "user", team, actor_ip, country_code, actor_is_bot
  FROM ev WHERE NOT {_BROKEN} AND NOT {_NO_TIME} AND {IN_RANGE}""")
def s03_incremental_ingest(m: Model) -> DataFrame:
    lines, store, checkpoint = m.scratch("arriving-lines"), m.scratch("ingested"), m.scratch("ingest-checkpoint")
    raw = b.raw_event_lines(m.events).select(F.col("_source_file").alias("folder"), "raw")
    for delivery in ("first", "again"):  # the same files a second time, under other names
        raw.repartition("folder").write.partitionBy("folder").text(f"{lines}/{delivery}")
        ingest.ingest_stream(m.spark, lines, store, checkpoint, layout="lines", max_files=4).awaitTermination()
    stored = filters.in_date_range(ingest.read_ingested(m.spark, store), b.DATE_RANGE)
    return stored.select("date_jst", "event_date", *_FIELDS)


@query("SELECT _source_path, _source_file, count(*) AS event_count FROM ev GROUP BY 1, 2")
def s04_file_counts(m: Model) -> DataFrame:
    return activity.file_counts(m.events)


@query("""
  SELECT 'user-' || c_custkey AS login, c_custkey AS id,
    CASE WHEN c_custkey % 5 = 0 THEN 'User' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'Bot' END AS type,
    CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 11 = 0 THEN NULL ELSE false END AS site_admin
  FROM customer""")
def s05_load_members(m: Model) -> DataFrame:
    path = m.scratch("member-arrays")
    b.write_documents(b.raw_member_arrays(m.table("customer")), "_source_file", path)
    return directory.load_members(m.spark, path)


def _seat_files(m: Model, orders: DataFrame) -> str:
    path = m.scratch("seat-files")
    b.write_documents(b.raw_seat_documents(orders), "_source_file", path)
    return path


@query("""
  SELECT 'user-' || o_custkey AS login, o_custkey AS user_id, o_orderpriority AS org_name,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 9 HOUR ELSE o_orderdate END AS created_at,
    CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(8200) + INTERVAL 18 HOUR
      ELSE o_orderdate + to_days(8200) + INTERVAL 9 HOUR END AS last_activity_at,
    CASE WHEN o_orderstatus <> 'P' THEN 'editor-' || (o_orderkey % 4) END AS last_activity_editor,
    CASE WHEN o_orderkey % 9 = 0 THEN TIMESTAMP '2024-03-01' END AS pending_cancellation_date
  FROM orders""")
def s06_load_seats(m: Model) -> DataFrame:
    return directory.load_seats(m.spark, _seat_files(m, m.table("orders")))


@query("""
  SELECT o_orderpriority || '-' || (o_orderkey // 20000) AS _source_file, o_orderpriority AS org_name, count(*) AS seat_count
  FROM orders GROUP BY 1, 2
  UNION ALL SELECT DISTINCT 'empty-' || o_orderstatus, 'unknown', 0 FROM orders""")
def s07_seat_file_summary(m: Model) -> DataFrame:
    documents = directory.read_seat_documents(m.spark, _seat_files(m, m.table("orders")))
    return directory.seat_file_summary(documents).select(b.folder_name().alias("_source_file"), "org_name", "seat_count")


@query("""
  SELECT 'timestamp_ntz' AS activity_type, 'string' AS editor_type, count(*) AS seats, 0::BIGINT AS used
  FROM orders""")
def s08_typed_null_columns(m: Model) -> DataFrame:
    unused = m.table("orders").withColumn("o_orderstatus", F.lit("P"))
    seats = directory.load_seats(m.spark, _seat_files(m, unused))
    return seats.groupBy(
        F.typeof("last_activity_at").alias("activity_type"), F.typeof("last_activity_editor").alias("editor_type")
    ).agg(F.count("*").alias("seats"), F.count("last_activity_at").alias("used"))


_EXPORT_SQL = """
  SELECT login, status, audit_event_count, unique_actions,
    coalesce(strftime(last_audit_activity, '%Y-%m-%d'), '') AS last_audit_activity,
    coalesce(strftime(copilot_last_activity, '%Y-%m-%d'), '') AS copilot_last_activity,
    coalesce(last_activity_editor, '') AS last_activity_editor, coalesce(days_inactive, -1) AS days_inactive
  FROM dormant"""


@query(_EXPORT_SQL)
def s09_csv_export(m: Model) -> DataFrame:
    path = m.scratch("dormant-csv")
    exported = dormancy.dormant_export(m.dormant)
    sinks.write_csv(exported, path)
    return m.spark.read.schema(exported.schema).option("header", True).csv(path).na.fill("")


@query("""
  SELECT login, user_id, org_name, created_at, last_activity_at, last_activity_editor, pending_cancellation_date
  FROM seat""")
def s10_seat_documents(m: Model) -> DataFrame:
    path = m.scratch("seats-json")
    sinks.write_seat_documents(m.seats, path, b.PAGE_SIZE)
    return directory.load_seats(m.spark, path, layout="lines")


@query("SELECT org_name, count(*) AS total_seats, count(*) AS seats FROM seat GROUP BY 1")
def s10_document_totals(m: Model) -> DataFrame:
    path = m.scratch("seats-json")
    sinks.write_seat_documents(m.seats, path, b.PAGE_SIZE)
    documents = directory.read_seat_documents(m.spark, path, layout="lines")
    named = documents.select(F.col("seats")[0]["organization"]["login"].alias("org_name"), "total_seats", F.size("seats").alias("n"))
    return named.groupBy("org_name", "total_seats").agg(F.sum("n").alias("seats"))


# ---------------------------------------------------------------- per-row derivations


@query("""
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 9 HOUR ELSE o_orderdate END AS seat_time
  FROM orders""")
def x02_seat_times(m: Model) -> DataFrame:
    written = b.seat_time_text(F.col("o_orderdate"), F.col("o_orderkey") % 4)
    return m.table("orders").select("o_orderkey", parsing.seat_time(written).alias("seat_time"))


@query("""
  SELECT event_id, date_trunc('hour', date_jst)::TIMESTAMP AS hour_start, date_jst::DATE AS day,
    date_trunc('week', date_jst)::TIMESTAMP AS week_start, date_trunc('month', date_jst)::TIMESTAMP AS month_start,
    year(date_jst)::INTEGER AS year, month(date_jst)::INTEGER AS month, hour(date_jst)::INTEGER AS hour,
    isodow(date_jst)::INTEGER AS weekday
  FROM ev""")
def x04_x08_time_columns(m: Model) -> DataFrame:
    time = F.col("date_jst")
    return m.events.select(
        "event_id", t.hour_start(time).alias("hour_start"), t.day(time).alias("day"),
        t.week_start(time).alias("week_start"), t.month_start(time).alias("month_start"),
        F.year(time).alias("year"), F.month(time).alias("month"), F.hour(time).alias("hour"),
        t.iso_weekday(time).alias("weekday"),
    )


@query("""
  SELECT event_id, strftime(date_jst, '%Y-%m-%d %H:00') AS hour_label, strftime(date_jst, '%Y-%m-%d') AS day_label,
    strftime(date_trunc('week', date_jst), '%Y-%m-%d') || '〜' AS week_label,
    year(date_jst) || '年' || month(date_jst) || '月' AS month_label, strftime(date_jst, '%Y-%m') AS month_key
  FROM ev""")
def x09_period_labels(m: Model) -> DataFrame:
    time = F.col("date_jst")
    return m.events.select(
        "event_id", t.hour_label(time).alias("hour_label"), t.date_text(time).alias("day_label"),
        t.week_label(t.week_start(time)).alias("week_label"),
        t.month_label(F.year(time), F.month(time)).alias("month_label"), t.year_month(time).alias("month_key"),
    )


@query("""
  SELECT event_id, ['月','火','水','木','金','土','日'][isodow(date_jst)] AS weekday_name,
    coalesce((['月','火','水','木','金','土','日'])[isodow(date_jst) + 1], '不明') AS zero_based_name
  FROM ev""")
def x10_weekday_names(m: Model) -> DataFrame:
    weekday = t.iso_weekday(F.col("date_jst"))
    return m.events.select(
        "event_id", t.weekday_name(weekday).alias("weekday_name"), t.weekday_name(weekday, 0).alias("zero_based_name")
    )


@query("SELECT login, last_activity, days_inactive FROM summary")
def x12_x13_last_activity(m: Model) -> DataFrame:
    return m.summary.select("login", "last_activity", "days_inactive")


@query("""
  SELECT login, status, CASE WHEN audit_event_count <= 36 THEN '休眠' ELSE 'アクティブ' END AS flag
  FROM (SELECT login, audit_event_count, CASE WHEN audit_event_count = 0 THEN '完全休眠'
    WHEN audit_event_count <= 18 THEN '低活動' ELSE '要観察' END AS status FROM summary)""")
def x15_x16_dormancy_labels(m: Model) -> DataFrame:
    count = F.col("audit_event_count")
    return m.counts.select(
        "login",
        labels.dormancy_status(count, b.DORMANT_THRESHOLD).alias("status"),
        labels.activity_flag(count, b.DORMANT_THRESHOLD).alias("flag"),
    )


_SUFFIXES = ("", ".rename", ".config_changed", ".uninstall", ".delete", ".transfer")


@query("""
  SELECT operation_type, name, count(*) AS count FROM (
    SELECT name, CASE WHEN regexp_matches(name, 'create|add|invite|install') THEN 'create'
      WHEN regexp_matches(name, 'destroy|remove|delete|uninstall') THEN 'remove'
      WHEN regexp_matches(name, 'update|change|rename|transfer|config') THEN 'modify' ELSE 'access' END AS operation_type
    FROM (SELECT action || (['','.rename','.config_changed','.uninstall','.delete','.transfer'])[event_id % 6 + 1] AS name
          FROM ev)) GROUP BY 1, 2""")
def x18_operation_types(m: Model) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("event_id") % 6).cast("int"))
    named = m.events.select(F.concat("action", suffix).alias("name"))
    return named.groupBy(labels.operation_type(F.col("name")).alias("operation_type"), "name").agg(
        F.count("*").alias("count")
    )


_CATEGORY_SQL = """CASE event_id % 3 WHEN 0 THEN 'low-' || actor WHEN 1 THEN 'former-' || actor ELSE actor END"""


def _with_categories(events: DataFrame) -> DataFrame:
    n = F.col("event_id") % 3
    prefix = F.when(n == 0, F.lit("low-")).when(n == 1, F.lit("former-")).otherwise(F.lit(""))
    return events.withColumn("actor", F.concat(prefix, "actor"))


@query(f"""
  SELECT is_bot, is_late_night, is_suspicious, is_low, is_former, count(*) AS count FROM (
    SELECT actor LIKE '%[bot]' AS is_bot, hour(date_jst) >= 22 OR hour(date_jst) < 6 AS is_late_night,
      coalesce(country_code IN ('RU','CN','KP'), false) AS is_suspicious,
      coalesce(category LIKE 'low-%', false) AS is_low, coalesce(category LIKE 'former-%', false) AS is_former
    FROM (SELECT *, {_CATEGORY_SQL} AS category FROM ev)) GROUP BY ALL""")
def x19_x22_event_flags(m: Model) -> DataFrame:
    actor = F.col("actor")
    return (
        _with_categories(m.events)
        .groupBy(
            labels.ends_with_bot_mark(actor).alias("is_bot"),
            t.is_late_night(F.col("date_jst")).alias("is_late_night"),
            labels.is_suspicious_country(F.col("country_code")).alias("is_suspicious"),
            labels.in_category(actor, "low-").alias("is_low"),
            labels.in_category(actor, "former-").alias("is_former"),
        )
        .agg(F.count("*").alias("count"))
    )


# ---------------------------------------------------------------- filters


@query(f"SELECT {_EVENTS_SQL}, event_id FROM ev WHERE {IN_RANGE}")
def f01_date_range(m: Model) -> DataFrame:
    return m.in_range


@query(f"""
  SELECT event_id, date_jst FROM ev
  WHERE date_jst BETWEEN TIMESTAMP '{TIME_RANGE[0]}' AND TIMESTAMP '{TIME_RANGE[1]}'""")
def f02_time_range(m: Model) -> DataFrame:
    return filters.in_time_range(m.events, *TIME_RANGE).select("event_id", "date_jst")


@query("SELECT event_id, date_jst FROM period")
def f03_trailing_period(m: Model) -> DataFrame:
    return filters.in_period(m.events, b.AS_OF, b.PERIOD_MONTHS).select("event_id", "date_jst")


@query(f"SELECT event_id, action FROM ev WHERE action IN {ACTIONS}")
def f04_action_list(m: Model) -> DataFrame:
    return filters.with_actions(m.events, ACTIONS).select("event_id", "action")


_SEARCH_SQL = rf"""regexp_matches(lower(action), '{SEARCH.lower()}') OR regexp_matches(lower(actor), '{SEARCH.lower()}')
  OR regexp_matches(lower(repo), '{SEARCH.lower()}')"""


@query(f"SELECT event_id, action, actor, repo FROM ev WHERE {_SEARCH_SQL}")
def f05_text_search(m: Model) -> DataFrame:
    return filters.matching(m.events, SEARCH).select("event_id", "action", "actor", "repo")


@query("""
  SELECT event_id, action, actor, repo FROM ev
  WHERE contains(lower(action), '3[bot]') OR contains(lower(actor), '3[bot]') OR contains(lower(repo), '3[bot]')""")
def f05_literal_search(m: Model) -> DataFrame:
    return filters.matching(m.events, "3[BOT]", literal=True).select("event_id", "action", "actor", "repo")


@query(f"SELECT action, count(*) AS count FROM ev WHERE actor = '{DRILL_DOWN}' GROUP BY 1")
def f06_actor_drill_down(m: Model) -> DataFrame:
    return filters.of_actor(activity.actor_actions(m.events), DRILL_DOWN).drop("actor")


@query("SELECT event_id, actor FROM ev WHERE NOT contains(actor, '[bot]')")
def f07_without_bots(m: Model) -> DataFrame:
    return filters.without_bots(m.events).select("event_id", "actor")


@query("SELECT event_id, actor FROM ev WHERE ends_with(actor, '[bot]')")
def f08_bot_suffix(m: Model) -> DataFrame:
    return m.events.where(labels.ends_with_bot_mark(F.col("actor"))).select("event_id", "actor")


@query(f"SELECT {_EVENTS_SQL}, event_id FROM ev WHERE action IN {CRITICAL}")
def f09_critical_events(m: Model) -> DataFrame:
    return filters.critical_events(m.events)


@query(f"SELECT {_EVENTS_SQL}, event_id FROM ev WHERE action IN {HIGH_RISK}")
def f10_high_risk_events(m: Model) -> DataFrame:
    return filters.high_risk_events(m.events)


@query(f"SELECT event_id, date_jst FROM ev WHERE {OFF_HOURS.format(6)}")
def f11_off_hours(m: Model) -> DataFrame:
    return filters.off_hours_events(m.events).select("event_id", "date_jst")


@query(f"SELECT event_id, date_jst FROM ev WHERE {OFF_HOURS.format(5)}")
def f11_off_hours_with_friday(m: Model) -> DataFrame:
    return filters.off_hours_events(m.events, t.FRIDAY).select("event_id", "date_jst")


@query("""
  SELECT count(*) AS events, count(repo) AS with_repo, count(actor_ip) AS with_ip,
    count(*) FILTER (WHERE repo IS NOT NULL AND actor_ip IS NOT NULL) AS with_both FROM ev""")
def f12_present_values(m: Model) -> DataFrame:
    both = F.col("repo").isNotNull() & F.col("actor_ip").isNotNull()
    return m.events.agg(
        F.count("*").alias("events"), F.count("repo").alias("with_repo"), F.count("actor_ip").alias("with_ip"),
        F.count_if(both).alias("with_both"),
    )


@query("SELECT login, audit_event_count FROM dormant")
def f14_dormant_members(m: Model) -> DataFrame:
    return m.counted_dormant.select("login", "audit_event_count")


@query("""
  SELECT login AS "ユーザー名", status AS "ステータス", audit_event_count AS "監査ログイベント数",
    unique_actions AS "ユニークアクション数", coalesce(strftime(last_audit_activity, '%Y-%m-%d'), '-') AS "最終監査ログ",
    coalesce(strftime(copilot_last_activity, '%Y-%m-%d'), '-') AS "最終Copilot利用",
    coalesce(last_activity_editor, '-') AS "エディタ", coalesce(days_inactive::VARCHAR, 'N/A') AS "非アクティブ日数"
  FROM dormant""")
def f15_dormant_table(m: Model) -> DataFrame:
    return dormancy.dormant_table(m.dormant)


@query("SELECT login, copilot_last_activity, last_activity_editor, pending_cancellation_date FROM summary")
def f16_report_columns(m: Model) -> DataFrame:
    return m.summary.select("login", *dormancy.SEAT_COLUMNS)


# ---------------------------------------------------------------- joins


@query("""
  SELECT m.login, m.id, m.type, coalesce(a.audit_event_count, 0) AS audit_event_count, a.last_audit_activity,
    coalesce(a.unique_actions, 0) AS unique_actions FROM mem m LEFT JOIN activity a ON a.login = m.login""")
def j01_members_with_activity(m: Model) -> DataFrame:
    return dormancy.join_activity(m.members, m.activity)


_SUMMARY_SQL = """
  SELECT login, id, type, audit_event_count, last_audit_activity, unique_actions, {}, last_activity, days_inactive"""


@query(_SUMMARY_SQL.format("copilot_last_activity, last_activity_editor, pending_cancellation_date") + " FROM summary")
def j02_summary_with_seats(m: Model) -> DataFrame:
    return m.summary


@query(f"""
  SELECT m.login, m.id, m.type, coalesce(a.audit_event_count, 0) AS audit_event_count, a.last_audit_activity,
    coalesce(a.unique_actions, 0) AS unique_actions, CAST(NULL AS TIMESTAMP) AS copilot_last_activity,
    CAST(NULL AS VARCHAR) AS last_activity_editor, CAST(NULL AS TIMESTAMP) AS pending_cancellation_date,
    a.last_audit_activity AS last_activity,
    date_sub('day', a.last_audit_activity, TIMESTAMP '{b.AS_OF}') AS days_inactive
  FROM mem m LEFT JOIN activity a ON a.login = m.login""")
def j02_summary_without_seats(m: Model) -> DataFrame:
    return dormancy.member_summary(m.events, m.members, None, b.AS_OF, b.PERIOD_MONTHS)


@query("SELECT event_id, actor FROM ev WHERE actor IN (SELECT login FROM mem)")
def j03_member_events(m: Model) -> DataFrame:
    return dormancy.member_events(m.events, m.members).select("event_id", "actor")


@query("SELECT actor FROM former")
def j04_former_users(m: Model) -> DataFrame:
    return dormancy.former_users(m.events, m.members)


@query("""
  SELECT login, user_id, org_name, created_at, last_activity_at, last_activity_editor, pending_cancellation_date
  FROM latest WHERE login IN (SELECT login FROM dormant)""")
def j05_dormant_seats(m: Model) -> DataFrame:
    return dormancy.dormant_seats(m.counted_dormant, m.latest)


# ---------------------------------------------------------------- aggregations


@query("""
  SELECT count(*) AS event_count, count(DISTINCT _source_path) AS file_count,
    (SELECT sum(_source_bytes)::BIGINT FROM (SELECT DISTINCT _source_path, _source_bytes FROM ev)) AS total_bytes,
    min(date_jst) AS first_event, max(date_jst) AS last_event,
    count(DISTINCT actor) + max(CASE WHEN actor IS NULL THEN 1 ELSE 0 END) AS unique_actors,
    count(DISTINCT action) AS unique_actions FROM ev""")
def a01_dataset_summary(m: Model) -> DataFrame:
    return activity.dataset_summary(m.events)


@query("""
  SELECT min(date_jst)::DATE AS first_date, max(date_jst)::DATE AS last_date,
    date_sub('day', min(date_jst), max(date_jst)) AS days FROM ev""")
def a02_data_span(m: Model) -> DataFrame:
    return activity.data_span(m.events)


@query(f"SELECT count(*) FILTER (WHERE {IN_RANGE}) AS selected_events, count(*) AS total_events FROM ev")
def a03_selected_counts(m: Model) -> DataFrame:
    return activity.selected_counts(m.events, b.DATE_RANGE)


@query(f"SELECT DISTINCT action FROM ev WHERE {IN_RANGE}")
def a04_distinct_actions(m: Model) -> DataFrame:
    return activity.distinct_actions(m.in_range)


@query(f"SELECT actor, count(*) AS event_count FROM ev WHERE {IN_RANGE} GROUP BY 1")
def a05_events_per_actor(m: Model) -> DataFrame:
    return activity.events_per_actor(m.in_range)


@query(f"""
  SELECT count(*) AS users, sum(n)::BIGINT AS events, sum(n) / greatest(count(*), 1) AS events_per_user
  FROM (SELECT actor, count(*) AS n FROM ev WHERE {IN_RANGE} GROUP BY 1)""")
def a06_user_totals(m: Model) -> DataFrame:
    return activity.user_totals(m.in_range)


@query(f"""
  SELECT actor, count(*) AS event_count FROM ev WHERE {IN_RANGE} AND NOT contains(actor, '[bot]')
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a07_top_actors(m: Model) -> DataFrame:
    return activity.top_actors(m.in_range, 10)


@query("SELECT actor, count(*) AS event_count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 25")
def a07_top_actors_with_bots(m: Model) -> DataFrame:
    return activity.top_actors(m.events, 25, exclude_bots=False)


@query("SELECT actor, action, count(*) AS count FROM ev GROUP BY 1, 2")
def a08_actor_actions(m: Model) -> DataFrame:
    return activity.actor_actions(m.events)


@query("SELECT action, count(*) AS count FROM ev GROUP BY 1")
def a09_action_distribution(m: Model) -> DataFrame:
    return activity.action_distribution(m.events)


@query("SELECT action, count(*) AS count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def a09_top_actions(m: Model) -> DataFrame:
    return activity.action_distribution(m.events, 20)


@query("SELECT repo, count(*) AS count FROM ev WHERE repo IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def a10_top_repos(m: Model) -> DataFrame:
    return activity.top_repos(m.events)


_SHARE_SQL = """
  SELECT count(*) FILTER (WHERE {0}) AS off_hours_events, count(*) AS total_events,
    count(*) FILTER (WHERE {0}) / greatest(count(*), 1) * 100 AS off_hours_pct FROM ev"""


@query(_SHARE_SQL.format(OFF_HOURS.format(6)))
def a11_off_hours_share(m: Model) -> DataFrame:
    return anomaly.off_hours_share(m.events)


@query(_SHARE_SQL.format(OFF_HOURS.format(5)) + f" WHERE {IN_RANGE}")
def a11_off_hours_share_with_friday(m: Model) -> DataFrame:
    return anomaly.off_hours_share(m.in_range, t.FRIDAY)


@query(f"""
  SELECT actor, count(*) AS off_hours_count FROM ev WHERE {OFF_HOURS.format(6)} AND NOT contains(actor, '[bot]')
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a12_off_hours_by_actor(m: Model) -> DataFrame:
    return anomaly.off_hours_by_actor(m.events)


_BULK_SQL = f"""
  SELECT actor, action, date_trunc('hour', date_jst)::TIMESTAMP AS hour_window, count(*) AS count FROM ev
  GROUP BY 1, 2, 3 HAVING count(*) > {b.BULK_THRESHOLD}"""


@query(_BULK_SQL)
def a13_bulk_operations(m: Model) -> DataFrame:
    return anomaly.bulk_operations(m.events, b.BULK_THRESHOLD)


@query("SELECT actor, count(DISTINCT actor_ip) AS unique_ips FROM ev GROUP BY 1 HAVING count(DISTINCT actor_ip) > 2")
def a14_multi_ip_actors(m: Model) -> DataFrame:
    return anomaly.multi_ip_actors(m.events)


@query("""
  SELECT DISTINCT actor, unique_ips, actor_ip FROM (
    SELECT actor, count(DISTINCT actor_ip) AS unique_ips FROM ev GROUP BY 1 HAVING count(DISTINCT actor_ip) > 2) n
  JOIN (SELECT actor AS of, actor_ip FROM ev WHERE actor_ip IS NOT NULL) a ON a.of IS NOT DISTINCT FROM n.actor""")
def a14_multi_ip_lists(m: Model) -> DataFrame:
    return anomaly.multi_ip_lists(m.events)


def _risk_sql(listed: str, rest: str, weekend: int) -> str:
    return f"""
      SELECT CASE WHEN risk_score = 0 THEN '低リスク' WHEN risk_score < 50 THEN '中リスク'
        WHEN risk_score < 100 THEN '高リスク' ELSE '重大リスク' END AS risk_level, * FROM (
      SELECT critical_events * 10 + (high_risk_events + bulk_operations) * 5 + off_hours_events // 100 AS risk_score, *
      FROM (SELECT
        (SELECT count(*) FROM ev WHERE action IN {CRITICAL} AND {listed}) AS critical_events,
        (SELECT count(*) FROM ev WHERE action IN {HIGH_RISK} AND {listed}) AS high_risk_events,
        (SELECT count(*) FROM (SELECT 1 FROM ev WHERE {rest} GROUP BY actor, action, date_trunc('hour', date_jst)
          HAVING count(*) > {b.BULK_THRESHOLD})) AS bulk_operations,
        (SELECT count(*) FROM ev WHERE {rest} AND {OFF_HOURS.format(weekend)}) AS off_hours_events,
        (SELECT count(*) FROM (SELECT 1 FROM ev WHERE {rest} GROUP BY actor
          HAVING count(DISTINCT actor_ip) > 2)) AS multi_ip_actors))"""


@query(_risk_sql("true", "true", 5))
def a15_risk_summary_whole_log(m: Model) -> DataFrame:
    return anomaly.risk_summary(m.events, None, b.BULK_THRESHOLD, weekend_from=t.FRIDAY)


@query(_risk_sql(IN_RANGE, IN_RANGE, 6))
def a15_risk_summary_filtered(m: Model) -> DataFrame:
    return anomaly.risk_summary(m.events, b.DATE_RANGE, b.BULK_THRESHOLD, scope="filtered")


@query("SELECT login, audit_event_count, last_audit_activity, unique_actions FROM activity")
def a16_member_activity(m: Model) -> DataFrame:
    return m.activity


@query("""
  SELECT count(*) AS total_members, count(*) FILTER (WHERE audit_event_count <= 36) AS dormant_count,
    count(*) FILTER (WHERE audit_event_count = 0) AS complete_dormant,
    count(*) FILTER (WHERE audit_event_count BETWEEN 1 AND 18) AS low_activity,
    count(*) FILTER (WHERE audit_event_count BETWEEN 19 AND 36) AS watch_needed,
    count(*) FILTER (WHERE audit_event_count <= 36) / count(*) * 100 AS dormant_ratio FROM summary""")
def a17_dormancy_kpis(m: Model) -> DataFrame:
    return dormancy.dormancy_kpis(m.counts, b.DORMANT_THRESHOLD)


@query("""
  SELECT count(*) FILTER (WHERE bot) AS bot_actor_count, count(*) FILTER (WHERE NOT bot) AS human_actor_count,
    coalesce(sum(n) FILTER (WHERE bot), 0)::BIGINT AS bot_event_count,
    coalesce(sum(n) FILTER (WHERE NOT bot), 0)::BIGINT AS human_event_count
  FROM (SELECT actor, coalesce(ends_with(actor, '[bot]'), false) AS bot, count(*) AS n FROM period GROUP BY ALL)""")
def a18_bot_human_split(m: Model) -> DataFrame:
    return dormancy.bot_human_split(m.events, b.AS_OF, b.PERIOD_MONTHS)


@query("SELECT status, count(*) AS count FROM dormant GROUP BY 1")
def a19_status_counts(m: Model) -> DataFrame:
    return dormancy.status_counts(m.counted_dormant)


@query("SELECT month, total_events, dormant_events FROM trend")
def a20_monthly_trend(m: Model) -> DataFrame:
    return m.trend


_PROFILE_SQL = """
  SELECT count(*) AS {}, count(last_activity_at) AS {}, count(*) FILTER (WHERE last_activity_at IS NULL) AS never_used,
    count(pending_cancellation_date) AS pending"""


@query(_PROFILE_SQL.format("holders", "used") + " FROM latest WHERE login IN (SELECT login FROM dormant)")
def a21_seat_usage(m: Model) -> DataFrame:
    return dormancy.seat_usage(m.counted_dormant, m.latest)


@query("""
  SELECT last_activity_editor, count(*) AS count FROM latest
  WHERE login IN (SELECT login FROM dormant) AND last_activity_editor IS NOT NULL GROUP BY 1""")
def a22_editor_distribution(m: Model) -> DataFrame:
    return dormancy.editor_distribution(m.counted_dormant, m.latest)


@query("""
  , bounds AS (SELECT min(audit_event_count) AS lo, max(audit_event_count) AS hi FROM summary),
  width0 AS (SELECT CASE WHEN hi > lo THEN (hi - lo)::DOUBLE ELSE 1.0 END AS span FROM bounds),
  width1 AS (SELECT span, pow(10.0, round(log10(span)) - 2) AS step FROM width0),
  width2 AS (SELECT span, CASE WHEN ceil(span / step) > 30 THEN step * 10 ELSE step END AS step FROM width1),
  width3 AS (SELECT span, CASE WHEN ceil(span / step) > 30 THEN step * 10 ELSE step END AS step FROM width2),
  width4 AS (SELECT span, CASE WHEN span / (step / 5) <= 30 THEN step / 5 ELSE step END AS step FROM width3),
  width5 AS (SELECT CASE WHEN span / (step / 2) <= 30 THEN step / 2 ELSE step END AS step FROM width4)
  SELECT floor(audit_event_count / step) * step AS bin_start, step AS bin_step,
    CASE WHEN audit_event_count <= 36 THEN '休眠' ELSE 'アクティブ' END AS status, count(*) AS members
  FROM summary, width5 GROUP BY 1, 2, 3""")
def a23_activity_histogram(m: Model) -> DataFrame:
    return dormancy.activity_histogram(m.counts, b.DORMANT_THRESHOLD)


@query("""
  SELECT count(*) AS former_count,
    (SELECT string_agg(actor, ', ' ORDER BY actor) FROM (SELECT actor FROM former ORDER BY 1 LIMIT 10)) AS first_names,
    greatest(count(*) - 10, 0) AS more FROM former""")
def a24_former_user_report(m: Model) -> DataFrame:
    return dormancy.former_user_report(m.events, m.members)


# ---------------------------------------------------------------- series


def _series_sql(period: str, label: str, where: str = "true") -> str:
    return f"""
      SELECT period, {label} AS period_str, count FROM (
        SELECT {period} AS period, count(*) AS count FROM ev WHERE {where} GROUP BY 1)"""


_HOUR_SQL = ("date_trunc('hour', date_jst)::TIMESTAMP", "strftime(period, '%Y-%m-%d %H:00')")
_DAY_SQL = ("date_jst::DATE", "strftime(period, '%Y-%m-%d')")
_WEEK_SQL = ("date_trunc('week', date_jst)::TIMESTAMP", "strftime(period, '%Y-%m-%d') || '〜'")
_MONTH_SQL = """
  SELECT year(date_jst)::INTEGER AS year, month(date_jst)::INTEGER AS month,
    strftime(min(date_jst), '%Y-%m') AS period, year(min(date_jst)) || '年' || month(min(date_jst)) || '月' AS period_str,
    count(*) AS count FROM ev WHERE {} GROUP BY 1, 2"""


@query(_series_sql(*_HOUR_SQL))
def t1_hourly_series(m: Model) -> DataFrame:
    return series.hourly_series(m.events)


@query(_series_sql(*_DAY_SQL))
def t2_daily_series(m: Model) -> DataFrame:
    return series.daily_series(m.events)


@query(_series_sql(*_WEEK_SQL))
def t3_weekly_series(m: Model) -> DataFrame:
    return series.weekly_series(m.events)


@query(_MONTH_SQL.format("true"))
def t4_monthly_series(m: Model) -> DataFrame:
    return series.monthly_series(m.events)


@query("""
  SELECT hour(date_jst)::INTEGER AS hour, count(*) AS count, hour(date_jst) BETWEEN 9 AND 17 AS is_business_hour
  FROM ev GROUP BY ALL""")
def t5_hour_distribution(m: Model) -> DataFrame:
    return series.hour_distribution(m.events)


_WEEKDAY_SQL = """
  SELECT weekday::INTEGER AS weekday, count(*) AS count,
    coalesce((['月','火','水','木','金','土','日'])[weekday + {}], '不明') AS weekday_name, weekday >= {} AS is_weekend
  FROM (SELECT isodow(date_jst) AS weekday FROM ev) GROUP BY ALL"""


@query(_WEEKDAY_SQL.format(0, 6))
def t6_weekday_distribution(m: Model) -> DataFrame:
    return series.weekday_distribution(m.events)


@query(_WEEKDAY_SQL.format(1, 5))
def t6_weekday_distribution_zero_based(m: Model) -> DataFrame:
    return series.weekday_distribution(m.events, weekend_from=t.FRIDAY, first_weekday=0)


# ---------------------------------------------------------------- window, top-k, reshape


@query("""
  SELECT login, user_id, org_name, created_at, last_activity_at, last_activity_editor, pending_cancellation_date
  FROM latest""")
def w1_latest_seats(m: Model) -> DataFrame:
    return m.latest


@query(f"""
  SELECT {_EVENTS_SQL}, event_id FROM ev
  ORDER BY date_jst DESC, action, actor NULLS LAST, repo NULLS LAST, org, _source_file, event_id LIMIT 100""")
def o3_latest_events(m: Model) -> DataFrame:
    return filters.latest_events(m.events, 100)


_LONG_SQL = """
  SELECT month, total_events AS events, '全ユーザー' AS category, strftime(month, '%Y-%m') AS month_label FROM trend
  UNION ALL
  SELECT month, dormant_events, '休眠ユーザー', strftime(month, '%Y-%m') FROM trend"""


@query(_LONG_SQL)
def u1_trend_long(m: Model) -> DataFrame:
    return dormancy.trend_long(m.trend)


# ---------------------------------------------------------------- profile


@query("""
  SELECT count(*) AS event_count, min(date_jst)::DATE AS first_date, max(date_jst)::DATE AS last_date,
    count(DISTINCT action) AS unique_actions,
    count(DISTINCT actor) + max(CASE WHEN actor IS NULL THEN 1 ELSE 0 END) AS unique_actors FROM ev""")
def p1_event_profile(m: Model) -> DataFrame:
    return profile.event_profile(m.events)


@query("SELECT action, count(*) AS count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def p1_top_actions(m: Model) -> DataFrame:
    return profile.top_values(m.events, "action")


@query("SELECT actor, count(*) AS count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10")
def p1_top_actors(m: Model) -> DataFrame:
    return profile.top_values(m.events, "actor")


@query(f"""
  SELECT count(DISTINCT category) FILTER (WHERE category LIKE 'low-%') AS low_activity_actors,
    count(DISTINCT category) FILTER (WHERE category LIKE 'former-%') AS former_actors
  FROM (SELECT {_CATEGORY_SQL} AS category FROM ev)""")
def p2_category_coverage(m: Model) -> DataFrame:
    return profile.category_coverage(_with_categories(m.events))


@query(f"""
  SELECT count(*) FILTER (WHERE hour(date_jst) >= 22 OR hour(date_jst) < 6) AS late_night,
    count(*) FILTER (WHERE action IN {PROFILE_RISK}) AS dangerous,
    count(*) FILTER (WHERE isodow(date_jst) >= 6) AS weekend,
    count(*) FILTER (WHERE country_code IN ('RU','CN','KP')) AS suspicious_country FROM ev""")
def p3_anomaly_indicators(m: Model) -> DataFrame:
    return profile.anomaly_indicators(m.events)


@query(_PROFILE_SQL.format("total_seats", "active") + " FROM seat")
def p4_seat_profile(m: Model) -> DataFrame:
    return dormancy.seat_profile(m.seats)


# ---------------------------------------------------------------- reports


@query(_SUMMARY_SQL.format("copilot_last_activity, last_activity_editor, pending_cancellation_date")
       + ", status FROM dormant")
def c1_dormancy_report(m: Model) -> DataFrame:
    return reports.dormancy_report(m.events, m.members, m.seats, b.AS_OF, b.PERIOD_MONTHS, b.DORMANT_THRESHOLD)


@query(_risk_sql(IN_RANGE, "true", 6))
def c2_risk_report(m: Model) -> DataFrame:
    return reports.risk_report(m.events, b.DATE_RANGE, b.BULK_THRESHOLD).summary


@query(_series_sql(*_DAY_SQL, IN_RANGE))
def c3_activity_series_day(m: Model) -> DataFrame:
    return reports.activity_series(m.events, "day", b.DATE_RANGE)


@query(_MONTH_SQL.format(IN_RANGE))
def c3_activity_series_month(m: Model) -> DataFrame:
    return reports.activity_series(m.events, "month", b.DATE_RANGE)


_TRACKED = f"{IN_RANGE} AND action IN {ACTIONS} AND ({_SEARCH_SQL})"


def _tracked(m: Model) -> reports.ActionReport:
    return reports.track_actions(m.events, b.DATE_RANGE, ACTIONS, SEARCH)


@query(f"SELECT count(*) AS matched_events, count(DISTINCT action) AS matched_actions FROM ev WHERE {_TRACKED}")
def c4_track_actions_totals(m: Model) -> DataFrame:
    return _tracked(m).totals


@query(f"SELECT action, count(*) AS count FROM ev WHERE {_TRACKED} GROUP BY 1")
def c4_track_actions_ranking(m: Model) -> DataFrame:
    return _tracked(m).actions


@query(f"""
  SELECT repo, count(*) AS count FROM ev WHERE {_TRACKED} AND repo IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def c4_track_actions_repos(m: Model) -> DataFrame:
    return _tracked(m).repos


@query(f"""
  SELECT {_EVENTS_SQL}, event_id FROM ev WHERE {_TRACKED}
  ORDER BY date_jst DESC, action, actor NULLS LAST, repo NULLS LAST, org, _source_file, event_id LIMIT 100""")
def c4_track_actions_latest(m: Model) -> DataFrame:
    return _tracked(m).latest


def _users(m: Model) -> reports.UserReport:
    return reports.user_report(m.events, b.DATE_RANGE, 15, True, DRILL_DOWN)


@query(f"""
  SELECT actor, count(*) AS event_count FROM ev WHERE {IN_RANGE} AND NOT contains(actor, '[bot]')
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def c5_user_report_top(m: Model) -> DataFrame:
    return _users(m).top_actors


@query(f"""
  SELECT actor, action, count(*) AS count FROM ev WHERE {IN_RANGE} AND actor = '{DRILL_DOWN}' GROUP BY 1, 2""")
def c5_user_report_one_user(m: Model) -> DataFrame:
    return _users(m).user_actions


@query(_LONG_SQL)
def c6_dormant_trend(m: Model) -> DataFrame:
    return reports.dormant_trend(m.events, m.members, b.AS_OF, b.PERIOD_MONTHS, b.DORMANT_THRESHOLD)


# ---------------------------------------------------------------- streams and announced analyses


def _event_stream(m: Model) -> DataFrame:
    # A pattern serves a table of one file and one of many alike.
    reader = m.spark.readStream.schema(b.SCHEMAS["events"])
    return b.bind_events(reader.parquet(f"{m.sf_dir}/events.parque[t]"))


def _drained(m: Model, rows: DataFrame, name: str) -> DataFrame:
    """The stream run until everything there is has been processed, read back from its sink."""
    path, checkpoint = m.scratch(name), m.scratch(f"{name}-checkpoint")
    detections.write_stream(rows, path, checkpoint).awaitTermination()
    return m.spark.read.schema(rows.schema).parquet(path)


def _batches(m: Model, parts: int = 4) -> DataFrame:
    """The events as a stream of several batches."""
    path = m.scratch("event-parts")
    m.table("events").repartition(parts, "event_id").write.parquet(path)
    return b.bind_events(m.spark.readStream.schema(b.SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path))


def _hours(m: Model) -> DataFrame:
    """Hourly counts kept from a stream, runs merged by twos."""
    counts = m.scratch("hours")
    hourly.maintain_hourly(_batches(m), counts, m.scratch("hours-checkpoint"), fan=2).awaitTermination()
    return hourly.hourly_counts(m.spark, counts)


@query(_BULK_SQL)
def e1_bulk_operation_stream(m: Model) -> DataFrame:
    counts, checkpoint = m.scratch("bulk-counts"), m.scratch("bulk-checkpoint")
    detections.count_stream(_batches(m), counts, checkpoint).awaitTermination()
    return detections.bulk_alerts(m.spark, counts, b.BULK_THRESHOLD)


@query("SELECT actor, count(*) AS event_count FROM ev GROUP BY 1")
def a05_actor_totals_from_hours(m: Model) -> DataFrame:
    return hourly.actor_totals(_hours(m))


@query("""
  SELECT 'hour' AS grain, strftime(date_trunc('hour', date_jst), '%Y-%m-%d %H:%M:%S') AS period, count(*) AS count FROM ev GROUP BY ALL
  UNION ALL SELECT 'day', strftime(date_jst, '%Y-%m-%d'), count(*) FROM ev GROUP BY ALL
  UNION ALL SELECT 'week', strftime(date_trunc('week', date_jst), '%Y-%m-%d %H:%M:%S'), count(*) FROM ev GROUP BY ALL
  UNION ALL SELECT 'month', strftime(date_trunc('month', date_jst), '%Y-%m-%d %H:%M:%S'), count(*) FROM ev GROUP BY ALL
  UNION ALL SELECT 'hour of day', hour(date_jst)::VARCHAR, count(*) FROM ev GROUP BY ALL
  UNION ALL SELECT 'weekday', isodow(date_jst)::VARCHAR, count(*) FROM ev GROUP BY ALL""")
def t1_t6_series_from_hours(m: Model) -> DataFrame:
    hours = _hours(m)
    parts = [hourly.period_totals(hours, grain).withColumn("grain", F.lit(grain)) for grain in ("hour", "day", "week", "month")]
    parts += [hourly.hour_totals(hours).select(F.col("hour").alias("period"), "count", F.lit("hour of day").alias("grain"))]
    parts += [hourly.weekday_totals(hours).select(F.col("weekday").alias("period"), "count", F.lit("weekday").alias("grain"))]
    out = [part.select("grain", F.col("period").cast("string").alias("period"), "count") for part in parts]
    return reduce(DataFrame.unionByName, out)


@query("""
  , hours AS (SELECT actor, action, date_trunc('hour', date_jst)::TIMESTAMP AS hour_window, count(*) AS count FROM ev GROUP BY ALL)
  SELECT * FROM hours WHERE hour_window <= (
    SELECT max(hour_window) FROM hours WHERE hour_window + INTERVAL 1 HOUR <= (SELECT max(date_jst) - INTERVAL 2 DAY FROM ev))""")
def e1_windows_with_late_rows(m: Model) -> DataFrame:
    given = _drained(m, detections.windowed_counts(_batches(m), "2 days"), "windows")
    late = detections.late_corrections(given, _hours(m)).drop("given")
    named = late.select(*[F.col(c).alias(f"_{c}") for c in late.columns])
    same = [given[c].eqNullSafe(named[f"_{c}"]) for c in ("actor", "action", "hour_window")]
    return given.join(named, reduce(Column.__and__, same), "left_anti").unionByName(late)


@query(f"SELECT {_EVENTS_SQL}, event_id FROM ev WHERE action IN {CRITICAL}")
def e2_critical_event_stream(m: Model) -> DataFrame:
    return _drained(m, detections.critical_event_stream(_event_stream(m)), "critical-stream")


@query(f"SELECT {_EVENTS_SQL}, event_id FROM ev WHERE action IN {CRITICAL}")
def e2_alert_feed(m: Model) -> DataFrame:
    source, out, checkpoint = m.scratch("delivered"), m.scratch("alerts"), m.scratch("alerts-checkpoint")
    for _ in range(2):  # all events are delivered twice
        m.table("events").write.mode("append").parquet(source)
        stream = b.bind_events(m.spark.readStream.schema(b.SCHEMAS["events"]).parquet(source))
        feed = detections.critical_alert_feed(stream, ["event_id"])
        detections.write_stream(feed, out, checkpoint).awaitTermination()
    return m.spark.read.schema(feed.schema).parquet(out)


@query("SELECT team, count(*) AS count FROM ev WHERE team IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def e3_top_teams(m: Model) -> DataFrame:
    return activity.top_teams(m.events)


@query("SELECT hour(date_jst)::INTEGER AS hour, count(*) AS count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def e4_peak_hour(m: Model) -> DataFrame:
    return series.peak_hour(m.events)


@query("""
  SELECT login, user_id, org_name, created_at, last_activity_at, last_activity_editor, pending_cancellation_date
  FROM seat WHERE login IN (SELECT actor FROM former)""")
def e5_former_user_seats(m: Model) -> DataFrame:
    return dormancy.former_user_seats(m.events, m.members, m.seats)


@query("""
  , days AS (
    SELECT actor, actor_ip, date_jst::DATE AS day, count(*) AS event_count, min(date_jst) AS first_event
    FROM ev WHERE actor_ip IS NOT NULL GROUP BY 1, 2, 3),
  before AS (
    SELECT d.actor, d.actor_ip, d.day, d.event_count, d.first_event, max(p.day) FILTER (p.actor_ip = d.actor_ip) AS last_seen,
      count(DISTINCT p.actor_ip) FILTER (p.day >= d.day - 30) AS known_addresses,
      count(DISTINCT p.day) FILTER (p.day >= d.day - 30) AS active_days
    FROM days d LEFT JOIN days p ON p.actor IS NOT DISTINCT FROM d.actor AND p.day < d.day GROUP BY ALL)
  SELECT * FROM before WHERE active_days >= 3 AND (last_seen IS NULL OR last_seen < day - 30)""")
def e6_unusual_addresses(m: Model) -> DataFrame:
    return addresses.unusual_addresses(m.events)


# ---------------------------------------------------------------- answers from stored events


def _event_store(m: Model) -> str:
    store = m.scratch("event-store")
    event_source.write_events(m.events, store)
    return store


@query(f"SELECT {_EVENTS_SQL} FROM ev WHERE {_SEARCH_SQL}")
def f05_search_in_store(m: Model) -> DataFrame:
    store, index = _event_store(m), m.scratch("postings")
    postings.index_store(m.spark, store, index)
    return postings.search_store(m.spark, store, index, SEARCH).select(*EVENT_COLUMNS)


@query(f"""
  SELECT {_EVENTS_SQL} FROM ev
  ORDER BY date_jst DESC, action NULLS LAST, actor NULLS LAST, repo NULLS LAST, org NULLS LAST, _source_file LIMIT 100""")
def o3_latest_from_store(m: Model) -> DataFrame:
    return postings.latest_stored(m.spark, _event_store(m)).select(*EVENT_COLUMNS)


@query(f"""
  SELECT contains(coalesce(actor, ''), '[bot]') AS is_bot, count(*) AS event_count,
    count(DISTINCT actor) + max(CASE WHEN actor IS NULL THEN 1 ELSE 0 END) AS unique_actors, count(DISTINCT action) AS unique_actions,
    count(DISTINCT actor_ip) AS unique_addresses
  FROM ev WHERE {IN_RANGE} GROUP BY 1""")
def a18_distinct_counts_from_sketches(m: Model) -> DataFrame:
    return sketches.range_counts(sketches.day_sketches(m.events), b.DATE_RANGE, "is_bot")


_EARLIER = ("2023-06-01", "2023-09-30")


@query(f"""
  , first AS (SELECT DISTINCT actor FROM ev WHERE date_jst::DATE BETWEEN '{_EARLIER[0]}' AND '{_EARLIER[1]}' AND actor IS NOT NULL),
  second AS (SELECT DISTINCT actor FROM ev WHERE {IN_RANGE} AND actor IS NOT NULL)
  SELECT (SELECT count(*) FROM ev WHERE date_jst::DATE BETWEEN '{_EARLIER[0]}' AND '{_EARLIER[1]}') AS first_events,
    (SELECT count(*) FROM ev WHERE {IN_RANGE}) AS second_events, (SELECT count(*) FROM first) AS first_actors,
    (SELECT count(*) FROM second) AS second_actors, (SELECT count(*) FROM first JOIN second USING (actor)) AS in_both,
    (SELECT count(*) FROM first WHERE actor NOT IN (SELECT actor FROM second)) AS only_first,
    (SELECT count(*) FROM second WHERE actor NOT IN (SELECT actor FROM first)) AS only_second""")
def a25_period_comparison(m: Model) -> DataFrame:
    return sketches.compare_periods(sketches.day_sketches(m.events), _EARLIER, b.DATE_RANGE)
