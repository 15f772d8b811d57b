"""Times the reports on a multiplied event table in which one actor holds a third of all rows.

    python bench_scale.py [copies] [folder]

The events of $BENCH_SF_DIR are multiplied ``copies`` times (34 gives 3.4 million at sf0.1),
every third copy is given to one actor and copies are moved by minutes. The table is stored
as JSON lines, loaded from those into Parquet by date, and each report reads that. Prints one
JSON line with the seconds of each step.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from trailspark.binding import tables as b  # noqa: E402
from trailspark.operators import activity, anomaly, dormancy, filters  # noqa: E402
from trailspark.plans import reports  # noqa: E402
from trailspark.session import local_session  # noqa: E402
from trailspark.sources import events as event_source  # noqa: E402
from trailspark.sources import sinks  # noqa: E402


def multiplied(spark, sf_dir: str, copies: int):
    source = b.events(spark, sf_dir).repartition(64)
    rows = source.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    hot = F.col("copy") % 3 == 0
    return rows.select(
        (F.col("date_jst") + F.make_dt_interval(mins=F.col("copy"))).alias("date_jst"),
        *[name for name in ("action", "org", "repo", "user", "team", "country_code", "actor_is_bot",
                            "_source_file", "_source_bytes")],
        F.when(hot, F.lit("user-1")).otherwise(F.col("actor")).alias("actor"),
        F.when(hot, F.concat(F.lit("172.16."), (F.col("event_id") % 250).cast("string"), F.lit("."),
                             (F.col("copy") % 250).cast("string"))).otherwise(F.col("actor_ip")).alias("actor_ip"),
    )


def exported(events):
    stamp = F.replace((F.col("date_jst") - F.make_dt_interval(hours=F.lit(9))).cast("string"), F.lit(" "), F.lit("T"))
    return events.select(F.concat(stamp, F.lit("Z")).alias("@timestamp"), "action", "actor", "org", "repo", "user",
                         "team", "actor_ip", "country_code", "actor_is_bot")


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 34
    folder = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cpus, "bench-scale", spark__checkpoint__dir=f"{folder}/scratch", spark__driver__memory="12g",
        spark__sql__shuffle__partitions="64", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        times[name] = round(time.perf_counter() - start, 2)
        print(name, times[name], file=sys.stderr, flush=True)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    raw, store = f"{folder}/raw", f"{folder}/store"
    timed("write_json", lambda: sinks.write_ndjson(exported(multiplied(spark, sf_dir, copies)), raw))
    timed("load_and_store", lambda: event_source.ingest_events(spark, raw, store, "lines"))
    events = event_source.read_events(spark, store)
    members, seats = b.members(spark, sf_dir), b.seats(spark, sf_dir)
    args = (events, members, seats, b.AS_OF, b.PERIOD_MONTHS, b.DORMANT_THRESHOLD)
    timed("warm_up", lambda: drain(reports.dormancy_report(*args)))
    timed("c1_dormancy_report", lambda: drain(reports.dormancy_report(*args)))
    timed("c2_risk_report", lambda: drain(reports.risk_report(events, b.DATE_RANGE, 50).summary))
    for granularity in ("hour", "day", "week", "month"):
        timed(f"c3_series_{granularity}", lambda: drain(reports.activity_series(events, granularity, b.DATE_RANGE)))
    timed("c4_search_latest", lambda: drain(reports.track_actions(events, b.DATE_RANGE, None, "repo-7").latest))
    timed("c5_top_actors", lambda: drain(reports.user_report(events, b.DATE_RANGE).top_actors))
    timed("c6_dormant_trend", lambda: drain(reports.dormant_trend(events, members, b.AS_OF, 3, b.DORMANT_THRESHOLD)))
    timed("a01_dataset_summary", lambda: drain(activity.dataset_summary(events)))
    timed("a13_bulk_operations", lambda: drain(anomaly.bulk_operations(events, 50)))
    timed("a14_multi_ip_lists", lambda: drain(anomaly.multi_ip_lists(events)))
    timed("a24_former_users", lambda: drain(dormancy.former_user_report(events, members)))
    timed("f09_critical_events", lambda: drain(filters.critical_events(events)))
    timed("j03_member_events", lambda: drain(dormancy.member_events(events, members)))
    rows = events.count()
    spark.stop()
    print(json.dumps({"metric": "scale run", "events": rows, "cpus": int(cpus), "unit": "sec", "steps": times}))


if __name__ == "__main__":
    main()
