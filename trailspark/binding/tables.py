"""Audit events, members and seats derived from the tables ``events``, ``customer``, ``orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.functions import timecols as t
from trailspark.operators.lists import paged_lists

AS_OF = "2024-02-01 00:00:00"
PERIOD_MONTHS = 3
DORMANT_THRESHOLD = 36
BULK_THRESHOLD = 1
DATE_RANGE = ("2023-09-05", "2024-01-20")
PAGE_SIZE = 1_000
KEYS_PER_FILE = 20_000  # order keys to a seat document


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
}

_EVENT_COLUMNS = (
    "ts - make_dt_interval(30 * if(user_id % 4 = 1, k % 12, k % 6)) + INTERVAL 9 HOURS AS date_jst",
    """CASE event_type
         WHEN 'click' THEN 'git.clone'
         WHEN 'view' THEN 'git.fetch'
         WHEN 'purchase' THEN
           CASE k % 20 WHEN 0 THEN 'repo.destroy' WHEN 1 THEN 'protected_branch.destroy' ELSE 'pull_request.create' END
         WHEN 'signup' THEN
           CASE k % 20 WHEN 0 THEN 'org.promote_member_to_owner' WHEN 1 THEN 'deploy_key.create'
                       ELSE 'org.invite_member' END
         ELSE CASE k % 20 WHEN 0 THEN 'hook.create' ELSE 'git.push' END
       END AS action""",
    """CASE WHEN event_type = 'error' AND k = 99 THEN NULL
            WHEN user_id % 10 = 3 THEN 'user-' || user_id || '[bot]'
            ELSE 'user-' || user_id END AS actor""",
    "'org-' || (user_id % 3) AS org",
    "CASE WHEN k % 4 <> 0 THEN 'repo-' || (k % 40) END AS repo",
    "CASE WHEN event_type = 'signup' THEN 'user-' || k END AS user",
    "CASE WHEN k % 6 = 0 THEN 'team-' || (k % 5) END AS team",
    """CASE WHEN k % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN '10.0.0.' || (k % 4)
            ELSE '10.0.1.' || (user_id % 200) END AS actor_ip""",
    """CASE WHEN k % 5 = 0 THEN NULL WHEN k % 17 = 1 THEN 'RU' WHEN k % 19 = 1 THEN 'CN'
            ELSE 'JP' END AS country_code""",
    "user_id % 10 = 3 AS actor_is_bot",
    "'logs-' || (user_id % 2) || '/audit-' || (user_id % 7) || '.ndjson' AS _source_path",
    "'audit-' || (user_id % 7) || '.ndjson' AS _source_file",
    "user_id % 7 * 1000 + 500 AS _source_bytes",
    "event_id",
)
_MEMBER_COLUMNS = (
    # A tenth of the customers go by another name: the events of their old one are a former user's.
    "if(c_custkey % 10 = 7, 'renamed-', 'user-') || c_custkey AS login", "c_custkey AS id", "'User' AS type", "c_custkey % 50 = 0 AS site_admin",
)
_SEAT_COLUMNS = (
    # Every third customer's seats are the next one's, so some members have none.
    "'user-' || (o_custkey + if(o_custkey % 3 = 0, 1, 0)) AS login",
    "o_custkey AS user_id",
    "o_orderpriority AS org_name",
    "o_orderdate AS created_at",
    "if(o_orderstatus <> 'P', o_orderdate + INTERVAL '8200 09' DAY TO HOUR, NULL) AS last_activity_at",
    "if(o_orderstatus <> 'P', 'editor-' || (o_orderkey % 4), NULL) AS last_activity_editor",
    "if(o_orderkey % 9 = 0, TIMESTAMP_NTZ'2024-03-01', NULL) AS pending_cancellation_date",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its declared schema: opening it reads no file."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def bind_events(source: DataFrame) -> DataFrame:
    """Event rows in the canonical schema, plus ``event_id``.

    The number in ``props`` comes out of a generator: as a plain column, every filter on a
    derived column would be pushed below it and read the JSON text again per use.
    """
    number = "explode(array(cast(get_json_object(props, '$.k') AS int))) AS k"
    return source.selectExpr("*", number).selectExpr(*_EVENT_COLUMNS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_events(table(spark, sf_dir, "events"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_MEMBER_COLUMNS)


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_SEAT_COLUMNS)


def raw_event_lines(source: DataFrame) -> DataFrame:
    """The events as raw JSON text in the forms exports come in, some of them unusable.

    The form depends on ``event_id``: epoch milliseconds or seconds, ISO text with and
    without zone, the second timestamp key; missing and null keys; broken records.
    """
    n, micros, utc_text = F.col("event_id"), F.col("_micros"), F.col("_utc_text")

    def iso(time: Column) -> Column:
        return F.replace(time.cast("string"), F.lit(" "), F.lit("T"))

    def pair(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{key}":'), value)

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    def text(key: str) -> Column:
        return pair(key, quoted(F.col(key)))

    millis = F.expr("_micros div 1000").cast("string")
    fraction = F.lpad((micros % 1_000_000).cast("string"), 6, "0")
    seconds = F.concat(F.expr("_micros div 1000000").cast("string"), F.lit("."), fraction)
    stamp = (
        F.when(n % 101 == 0, F.lit('"@timestamp":"not a date"'))
        .when(n % 103 == 0, F.lit('"@timestamp":null,"timestamp":1700000000'))
        .when(n % 6 == 0, pair("@timestamp", millis))
        .when(n % 6 == 1, pair("@timestamp", seconds))
        .when(n % 6 == 2, pair("@timestamp", quoted(utc_text)))
        .when(n % 6 == 3, pair("@timestamp", quoted(F.concat(utc_text, F.lit("Z")))))
        .when(n % 6 == 4, pair("@timestamp", quoted(F.concat(iso(F.col("date_jst")), F.lit("+09:00")))))
        .otherwise(pair("timestamp", millis))
    )
    actor = F.when(n % 13 == 0, F.lit('"actor":null')).when(n % 11 != 0, text("actor"))
    rest = F.to_json(F.struct("org", "repo", "user", "team", "actor_ip", "country_code", "actor_is_bot"))
    body = F.concat_ws(",", stamp, F.when(n % 17 != 0, text("action")), actor, F.expr("substring(_rest, 2)"))
    raw = (
        F.when(n % 97 == 0, F.regexp_replace("_body", r"\}$", ""))
        .when(n % 107 == 0, F.concat(F.col("_body"), F.lit(" x")))
        .when(n % 109 == 0, F.lit("17"))
        .otherwise(F.col("_body"))
    )
    return (
        source.withColumn("_micros", t.wall_clock_micros(F.col("date_jst")) - 9 * 3600 * 1_000_000)
        .withColumn("_utc_text", iso(F.col("date_jst") - F.make_dt_interval(F.lit(0), F.lit(9))))
        .withColumn("_rest", rest)
        .withColumn("_body", F.concat(F.lit("{"), body))
        .select("_source_path", "_source_file", "_source_bytes", raw.alias("raw"))
    )


def write_documents(documents: DataFrame, name: str, path: str) -> None:
    """Each text of the column ``raw`` as one file, below a folder called by the column ``name``."""
    named = documents.select(F.col(name).alias("folder"), "raw")
    named.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)


def folder_name() -> Column:
    return F.regexp_extract("_source_path", "/folder=([^/]*)/", 1)


def raw_member_records(source: DataFrame) -> DataFrame:
    """Customers as raw member records; some lack keys, some hold nulls."""
    n = F.col("c_custkey")
    raw = F.concat_ws(
        ",",
        F.concat(F.lit('"login":"user-'), n.cast("string"), F.lit('"')),
        F.concat(F.lit('"id":'), n.cast("string")),
        F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, F.lit('"type":null')).otherwise(F.lit('"type":"Bot"')),
        F.when(n % 3 == 0, F.lit('"site_admin":true')).when(n % 11 == 0, F.lit('"site_admin":null')),
    )
    return source.select(
        F.lit("members.json").alias("_source_file"),
        F.lit(0).cast("bigint").alias("_source_bytes"),
        F.concat(F.lit("{"), raw, F.lit("}")).alias("raw"),
    )


def raw_member_arrays(source: DataFrame) -> DataFrame:
    """Members as raw JSON arrays of about 1,000 members each."""
    records = raw_member_records(source)
    document = F.concat(F.lit("["), F.array_join("items", ",\n "), F.lit("]\n"))
    return paged_lists(records, "_source_file", "raw", PAGE_SIZE).select("_source_file", document.alias("raw"))


def seat_time_text(time: Column, form: Column) -> Column:
    """A time in one of the ways seat exports write it."""
    text = F.replace(time.cast("string"), F.lit(" "), F.lit("T"))
    return (
        F.when(form == 0, F.concat(text, F.lit("Z")))
        .when(form == 1, F.concat(text, F.lit("+09:00")))
        .when(form == 2, text)
        .otherwise(t.date_text(time))
    )


def raw_seat_documents(source: DataFrame) -> DataFrame:
    """Orders as raw seat documents, by organisation and range of order keys; one per order status is empty."""
    key = F.col("o_orderkey")
    used = F.col("o_orderstatus") != "P"
    seat = F.struct(
        seat_time_text(F.col("o_orderdate"), key % 4).alias("created_at"),
        F.when(key % 9 == 0, F.lit("2024-03-01")).alias("pending_cancellation_date"),
        F.when(used, seat_time_text(F.col("o_orderdate") + F.make_dt_interval(F.lit(8200), F.lit(9)), key % 3))
        .otherwise(F.when(key % 2 == 0, F.lit(""))).alias("last_activity_at"),
        F.when(used, F.concat(F.lit("editor-"), (key % 4).cast("string"))).alias("last_activity_editor"),
        F.struct(F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("login"),
                 F.col("o_custkey").alias("id")).alias("assignee"),
        F.struct(F.col("o_orderpriority").alias("login"), F.lit(1).alias("id")).alias("organization"),
    )
    number = F.expr(f"o_orderkey div {KEYS_PER_FILE}")
    name = F.concat_ws("-", "o_orderpriority", number.cast("string"))
    seats = source.groupBy(name.alias("name")).agg(F.sort_array(F.collect_list(seat)).alias("seats"))
    empty = source.select(F.concat(F.lit("empty-"), "o_orderstatus").alias("name")).distinct()
    empty = empty.join(seats.select("seats").limit(0), F.lit(False), "left").select("name", F.coalesce("seats", F.array()).alias("seats"))
    document = F.to_json(F.struct(F.size("seats").alias("total_seats"), "seats"), {"ignoreNullFields": "false"})
    return seats.unionByName(empty).select(
        F.col("name").alias("_source_file"), F.length(document).cast("bigint").alias("_source_bytes"), document.alias("raw")
    )


def raw_event_arrays(source: DataFrame) -> DataFrame:
    """Events as raw JSON arrays of about 1,000 events each."""
    record = F.to_json(F.struct(
        F.expr("_micros div 1000").alias("@timestamp"), "action", "actor", "org", "repo", "user", "team", "actor_ip",
        "country_code", "actor_is_bot", F.struct(F.col("country_code"), F.lit("}],[{").alias("country_name")).alias("actor_location"),
    ))
    records = source.withColumn("_micros", t.wall_clock_micros(F.col("date_jst")) - 9 * 3600 * 1_000_000).select(
        "_source_file", record.alias("record")
    )
    document = F.concat(F.lit("[\n"), F.array_join("items", ",\n"), F.lit("\n]"))
    return paged_lists(records, "_source_file", "record", PAGE_SIZE).select(
        "_source_file", F.length(document).cast("bigint").alias("_source_bytes"), document.alias("raw")
    )
