"""Incremental ingest, the maintained hourly table and event-time windows: re-delivery, failures, late rows."""

import datetime as dt
import json
import random
from collections import Counter

import pytest

from trailspark.operators import activity, anomaly, series
from trailspark.schema import EVENT_SCHEMA
from trailspark.session import scratch_path
from trailspark.sources import versions
from trailspark.sources.events import load_events
from trailspark.streaming import detections, hourly, ingest


def export(folder, name, actors, array=False):
    folder.mkdir(exist_ok=True, parents=True)
    records = [json.dumps({"@timestamp": 1736899200123 + i * 86_400_000, "action": "git.push", "actor": a, "org": "o"}) for i, a in enumerate(actors)]
    (folder / name).write_text("[" + ",".join(records) + "]" if array else "".join(r + "\n" for r in records))


class Ingest:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.store, self.checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")

    def run(self, **options):
        ingest.ingest_stream(self.spark, str(self.folder), self.store, self.checkpoint, **options).awaitTermination()
        return self.actors()

    def actors(self):
        return sorted(row.actor for row in ingest.read_ingested(self.spark, self.store).collect())


def test_new_files_are_taken_once(spark, tmp_path):
    job = Ingest(spark, tmp_path / "in")
    export(job.folder, "a.ndjson", ["a1", "a2"])
    export(job.folder / "deep", "b [1]{x}.json", ["b1"], array=True)
    assert job.run() == ["a1", "a2", "b1"]
    assert job.run() == ["a1", "a2", "b1"]
    export(job.folder, "again.ndjson", ["a1", "a2"])  # the same records under another name
    export(job.folder, "c.ndjson", ["c1", "c1"])
    export(job.folder, "c-copy.ndjson", ["c1", "c1"])  # two at once
    export(job.folder, "blank.json", [])
    assert job.run() == ["a1", "a2", "b1", "c1", "c1"]
    seen = {row.name: row.taken for row in ingest.ingested_files(spark, job.store).collect()}
    assert seen["a.ndjson"] and seen["b [1]{x}.json"] and not seen["again.ndjson"]
    assert seen["c.ndjson"] + seen["c-copy.ndjson"] == 1 and "blank.json" not in seen


def test_failure_between_write_and_commit(spark, tmp_path):
    job = Ingest(spark, tmp_path / "in")
    export(job.folder, "a.ndjson", ["a1"])
    job.run()
    export(job.folder, "b.ndjson", ["b1", "b2"])

    def fail(number):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        job.run(before_commit=fail)
    assert job.actors() == ["a1"]  # written, but not committed
    assert job.run() == ["a1", "b1", "b2"]


def test_lost_checkpoint_lists_all_files_again(spark, tmp_path):
    job = Ingest(spark, tmp_path / "in")
    export(job.folder, "a.ndjson", ["a1", "a2"])
    job.run()
    job.checkpoint = scratch_path(spark, "ingest-state")
    export(job.folder, "b.ndjson", ["b1"])
    assert job.run(max_files=1) == ["a1", "a2", "b1"]


def test_ingested_equals_loaded_and_prunes_dates(spark, tmp_path):
    job = Ingest(spark, tmp_path / "in")
    for n in range(5):
        export(job.folder, f"{n}.ndjson", [f"a{n}-{i}" for i in range(n + 1)])
    (job.folder / "bad.ndjson").write_text("{oops\n")
    job.run(max_files=2)
    loaded = load_events(spark, str(job.folder))
    names = EVENT_SCHEMA.names
    assert sorted(map(str, ingest.read_ingested(spark, job.store).select(*names).collect())) == sorted(map(str, loaded.events.select(*names).collect()))
    assert [r.reject_reason for r in ingest.read_ingest_rejects(spark, job.store).collect()] == ["malformed_json"]
    plan = ingest.read_ingested(spark, job.store).where("event_date = DATE'2025-01-16'")._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]


def test_nothing_ingested(spark):
    store = scratch_path(spark, "ingested")
    assert ingest.read_ingested(spark, store).count() == 0 and ingest.read_ingest_rejects(spark, store).count() == 0


def events(spark, rows):
    full = [tuple({"actor": a, "action": x, "date_jst": d}.get(n) for n in EVENT_SCHEMA.names) for a, x, d in rows]
    return spark.createDataFrame(full, EVENT_SCHEMA)


def random_rows(seed, many):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(rng.choice(["a", "b", None, "bot[bot]"]), rng.choice(["x", "y", None]), start + dt.timedelta(minutes=rng.randint(0, 60 * 40))) for _ in range(many)]


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_hourly_table_answers_like_events(spark):
    store = scratch_path(spark, "hours")
    rows = random_rows(1, 600)
    for number in range(11):  # out of order in time; each batch twice
        batch = events(spark, rows[number::11])
        hourly.add_counts(batch, store, "s", number, fan=3)
        hourly.add_counts(batch, store, "s", number, fan=3)
        if number == 5:
            hourly.add_counts(events(spark, rows[2::11]), store, "s", 2, fan=3)  # an old batch again
    counts, whole = hourly.hourly_counts(spark, store), events(spark, rows)
    assert rows_of(counts, "actor", "action", "hour_window", "count") == rows_of(anomaly.hourly_action_counts(whole), "actor", "action", "hour_window", "count")
    assert hourly.bulk_hours(counts, 8).collect() == anomaly.bulk_operations(whole, 8).select("actor", "action", "hour_window", "count").collect()
    assert hourly.actor_totals(counts).collect() == activity.events_per_actor(whole).collect()
    for grain in series.GRANULARITIES[:3]:
        assert hourly.period_totals(counts, grain).collect() == series.activity_series(whole, grain).select("period", "count").collect()
    assert [r["count"] for r in hourly.period_totals(counts, "month").collect()] == [r["count"] for r in series.monthly_series(whole).collect()]
    assert hourly.hour_totals(counts).collect() == series.hour_distribution(whole).select("hour", "count").collect()
    assert hourly.weekday_totals(counts).collect() == series.weekday_distribution(whole).select("weekday", "count").collect()
    with pytest.raises(ValueError):
        hourly.period_totals(counts, "year")


def test_runs_read_do_not_grow_with_batches(spark):
    store, most = scratch_path(spark, "hours"), []
    for number in range(20):
        hourly.add_counts(events(spark, random_rows(number, 5)), store, "s", number, fan=3)
        most.append(len(hourly.live_runs(spark, store)))
    # In base three, 20 batches have at most three levels of at most two runs.
    assert max(most) <= 6 and hourly.hourly_counts(spark, store).groupBy().sum("count").first()[0] == 100
    before = rows_of(hourly.hourly_counts(spark, store), "actor", "action", "hour_window", "count")
    hourly.clean(spark, store)
    assert rows_of(hourly.hourly_counts(spark, store), "actor", "action", "hour_window", "count") == before
    assert versions.complete(spark, f"{store}/live", "version") == [20]


def test_half_written_run_is_written_over(spark, monkeypatch):
    store = scratch_path(spark, "hours")
    hourly.add_counts(events(spark, random_rows(1, 10)), store, "s", 0)
    kept = versions.write_version
    monkeypatch.setattr(versions, "write_version", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        hourly.add_counts(events(spark, random_rows(2, 10)), store, "s", 1)
    monkeypatch.setattr(versions, "write_version", kept)
    assert hourly.hourly_counts(spark, store).groupBy().sum("count").first()[0] == 10
    hourly.add_counts(events(spark, random_rows(2, 10)), store, "s", 1)
    assert hourly.hourly_counts(spark, store).groupBy().sum("count").first()[0] == 20


def test_maintained_by_a_stream_over_restarts(spark):
    source, store, state = (scratch_path(spark, n) for n in ("in", "hours", "state"))
    rows = random_rows(4, 90)
    for number in range(3):
        events(spark, rows[number::3]).coalesce(1).write.mode("append").parquet(source)
        hourly.maintain_hourly(spark.readStream.schema(EVENT_SCHEMA).parquet(source), store, state, fan=2).awaitTermination()
    got = Counter({(r.actor, r.action, r.hour_window): r["count"] for r in hourly.hourly_counts(spark, store).collect()})
    assert got == Counter((a, x, d.replace(minute=0)) for a, x, d in rows)


def test_windows_and_late_corrections_give_all_counts(spark):
    source, out, state, store, table = (scratch_path(spark, n) for n in ("in", "windows", "w-state", "hours", "h-state"))
    rows = sorted(random_rows(5, 400), key=lambda r: r[2])
    rng = random.Random(6)
    # Shuffled within four hours, and one row in ten comes at the very end.
    late = [r for i, r in enumerate(rows) if i % 10 == 0]
    timely = sorted((r for i, r in enumerate(rows) if i % 10), key=lambda r: r[2] + dt.timedelta(minutes=rng.randint(0, 60 * 4)))
    batches = [timely[i : i + 60] for i in range(0, len(timely), 60)] + [late, [("end", "z", dt.datetime(2024, 2, 1))], [("end", "z", dt.datetime(2024, 2, 1))]]
    states = []
    for batch in batches:  # a restart after each
        events(spark, batch).coalesce(1).write.mode("append").parquet(source)
        stream = detections.windowed_counts(spark.readStream.schema(EVENT_SCHEMA).parquet(source), "5 hours")
        query = detections.write_stream(stream, out, state)
        query.awaitTermination()
        states.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
        hourly.maintain_hourly(spark.readStream.schema(EVENT_SCHEMA).parquet(source), store, table).awaitTermination()
    windows = spark.read.schema("actor string, action string, hour_window timestamp_ntz, count long").parquet(out)
    given = {(r.actor, r.action, r.hour_window): r["count"] for r in windows.collect()}
    assert len(given) == windows.count()  # each hour is given out once
    corrected = detections.late_corrections(windows, hourly.hourly_counts(spark, store)).collect()
    assert corrected and all(r["count"] > r.given for r in corrected)
    given.update({(r.actor, r.action, r.hour_window): r["count"] for r in corrected})
    assert given == Counter((a, x, d.replace(minute=0)) for a, x, d in rows)
    # The state holds hours inside the delay only, not all that have been seen.
    assert max(states) < len(set(given)) / 2


def test_alerts_come_once(spark):
    source, out, state = (scratch_path(spark, n) for n in ("in", "alerts", "a-state"))
    nine = dt.datetime(2024, 1, 3, 9)

    def run(*rows):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(source)
        feed = detections.critical_alert_feed(stream, ["actor", "action", "date_jst"])
        detections.write_stream(feed, out, state).awaitTermination()
        return sorted(r.actor for r in spark.read.schema(EVENT_SCHEMA).parquet(out).collect())

    first = ("a", "repo.destroy", nine)
    assert run(first, first, ("b", "repo.destroy", nine), ("c", "git.push", nine)) == ["a", "b"]
    assert run(first) == ["a", "b"]  # delivered again, after a restart
    assert run(("a", "repo.destroy", nine + dt.timedelta(minutes=1)), ("b", "repo.destroy", nine)) == ["a", "a", "b"]
