"""Physical plans: what must hold at any data size."""

import pytest
from pyspark.sql import functions as F

from trailspark.binding import tables as b
from trailspark.binding.catalog import QUERIES
from trailspark.operators import anomaly, dormancy, filters
from trailspark.session import scratch_path
from trailspark.sources import events as event_source

EAGER = {"s03_multi_file_load", "s03_ingested_store", "s09_csv_export", "s10_seat_documents", "s10_document_totals", "s02_array_documents",
         "s02_arrays_in_pieces", "s05_load_members", "s06_load_seats", "s07_seat_file_summary", "s08_typed_null_columns", "e1_bulk_operation_stream",
         "e2_critical_event_stream", "s03_incremental_ingest", "a05_actor_totals_from_hours", "t1_t6_series_from_hours",
         "e1_windows_with_late_rows", "e2_alert_feed", "f05_search_in_store", "o3_latest_from_store"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
             "PythonUDF", "Scan ExistingRDD", "LocalTableScan")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_has_no_product_or_python(spark, sf_dir, name):
    plan = planned(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in plan]


@pytest.mark.parametrize("name", ["a07_top_actors", "a10_top_repos", "o3_latest_events", "e4_peak_hour", "p1_top_actions"])
def test_top_k_keeps_k_rows_per_task(spark, sf_dir, name):
    assert "TakeOrderedAndProject" in planned(QUERIES[name](spark, sf_dir))


def test_latest_seat_is_cut_before_the_shuffle(spark, sf_dir):
    plan = planned(QUERIES["w1_latest_seats"](spark, sf_dir))
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_scans_read_needed_columns_and_push_ranges(spark, sf_dir):
    store = scratch_path(spark, "plan-store")
    event_source.write_events(b.events(spark, sf_dir), store)
    events = event_source.read_events(spark, store)
    plan = planned(anomaly.bulk_operations(filters.in_date_range(events, b.DATE_RANGE), 1))
    scan = plan[plan.index("FileScan"):]
    assert "ReadSchema: struct<date_jst:timestamp_ntz,action:string,actor:string>" in scan
    assert "PushedFilters: [IsNotNull(date_jst), GreaterThanOrEqual(date_jst" in scan
    assert "event_date" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        # Merged into one task, the little data here could not be split by map task.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def finished(df):
    """The final adaptive plan of a run."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def hot_events(spark):
    """A third of the events belong to one actor, each from an address of its own."""
    ids = spark.range(60_000).repartition(16)
    hot = F.col("id") % 3 == 0
    return ids.select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 5_000).cast("string"))).alias("actor"),
        F.concat(F.lit("ip"), F.when(hot, F.col("id")).otherwise(F.col("id") % 7).cast("string")).alias("actor_ip"),
        F.sha2(F.col("id").cast("string"), 256).alias("action"),
    )


def test_hot_actor_is_split_in_the_member_join(spark, no_broadcast):
    members = spark.range(5_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("login"))
    members = members.union(spark.range(1).select(F.lit("hot")))
    rows, plan = finished(dormancy.member_events(hot_events(spark), members))
    assert len(rows) == 60_000
    assert "skew=true" in plan


def test_hot_actor_is_split_in_address_lists(spark, no_broadcast):
    rows, plan = finished(anomaly.multi_ip_lists(hot_events(spark)))
    hot = {row.actor_ip for row in rows if row.actor == "hot"}
    assert len(hot) == 20_000 and {row.unique_ips for row in rows if row.actor == "hot"} == {20_000}
    assert "skew=true" in plan


def test_events_shrink_before_they_meet_members(spark, no_broadcast, sf_dir):
    """Without broadcasts both inputs of the join are aggregates or dimensions."""
    rows, plan = finished(QUERIES["c1_dormancy_report"](spark, sf_dir))
    assert len(rows) == 148 and "Broadcast" not in plan
    # Events pass an aggregate before the first shuffle and reach the join as its result.
    scan = plan.index("FileScan parquet [ts")
    events_side = plan[plan.rindex(" Sort [", 0, scan):scan]
    assert events_side.count("HashAggregate") == 4 and "Join" not in events_side
