"""Answers from stored events: unusual addresses, search by postings, newest folders, sketches."""

import datetime as dt
import random

import pytest

from trailspark.operators import activity, addresses, filters, sketches
from trailspark.schema import EVENT_SCHEMA
from trailspark.session import scratch_path
from trailspark.sources import postings
from trailspark.sources.events import read_events, write_events


def events(spark, rows):
    full = [tuple(row.get(n) for n in EVENT_SCHEMA.names) for row in rows]
    return spark.createDataFrame(full, EVENT_SCHEMA)


def random_rows(seed, many, days=120):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [{
        "date_jst": start + dt.timedelta(days=rng.randrange(days), seconds=rng.randrange(86_400)), "actor": rng.choice(["a", "b", "c", "d[bot]", None]),
        "action": rng.choice(["git.push", "repo.destroy", "Team.add"]), "repo": rng.choice([None, "prod-1", "Test"]),
        "actor_ip": rng.choice([None, *[f"10.0.0.{i}" for i in range(6)]]), "_source_file": f"f{i}",
    } for i, _ in enumerate(range(many))]


def brute_unusual(rows, baseline, least):
    days = {}
    for r in rows:
        if r["actor_ip"] is not None:
            days.setdefault((r["actor"], r["actor_ip"], r["date_jst"].date()), []).append(r["date_jst"])
    out = set()
    for (actor, ip, day), times in days.items():
        past = [(p, d) for a, p, d in days if a == actor and d < day]
        recent = [(p, d) for p, d in past if (day - d).days <= baseline]
        active = len({d for _, d in recent})
        if ip not in {p for p, _ in recent} and active >= least:
            last = max((d for p, d in past if p == ip), default=None)
            out.add((actor, ip, day, len(times), min(times), last, len({p for p, _ in recent}), active))
    return out


@pytest.mark.parametrize("baseline, least", [(5, 1), (12, 3), (1, 1), (60, 4)])
def test_unusual_addresses(spark, baseline, least):
    rows = random_rows(baseline, 300)
    found = addresses.unusual_addresses(events(spark, rows), baseline, least)
    names = ("actor", "actor_ip", "day", "event_count", "first_event", "last_seen", "known_addresses", "active_days")
    got = [tuple(r[n] for n in names) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_unusual(rows, baseline, least) and got
    assert [r[2] for r in got] == sorted((r[2] for r in got), reverse=True)


def test_no_addresses(spark):
    assert addresses.unusual_addresses(events(spark, [])).count() == 0
    assert addresses.unusual_addresses(events(spark, [{"date_jst": dt.datetime(2024, 1, 1), "actor": "a"}]), 3, 0).count() == 0


@pytest.fixture
def store(spark):
    path = scratch_path(spark, "store")
    write_events(events(spark, random_rows(3, 400)), path)
    return path


def folders_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.metrics().contains("numPartitions"):
            total += node.metrics().apply("numPartitions").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return total


def keys(df):
    return sorted(str(tuple(r[n] for n in EVENT_SCHEMA.names)) for r in df.collect())


def test_search_opens_only_the_dates_found(spark, store):
    index = scratch_path(spark, "index")
    write_events(events(spark, [{"date_jst": dt.datetime(2024, 7, 7, 3), "actor": "rare.one", "repo": "x+y"}]), store)
    postings.index_store(spark, store, index)
    for search, literal in (("RARE", False), ("x+y", True), ("^team", False), ("nothing at all", False), ("prod-[12]$", False)):
        found = postings.search_store(spark, store, index, search, literal)
        assert keys(found) == keys(filters.matching(read_events(spark, store), search, literal))
    assert folders_read(postings.search_store(spark, store, index, "rare")) == 1
    assert folders_read(filters.matching(read_events(spark, store), "rare")) > 100


def test_index_follows_the_store(spark, store):
    index = scratch_path(spark, "index")
    postings.index_store(spark, store, index)
    assert not postings.dates_with(spark, index, "newcomer")
    day = dt.datetime(2024, 1, 5)
    write_events(events(spark, [{"date_jst": day, "actor": "newcomer"}]), store)
    postings.index_store(spark, store, index)
    assert postings.dates_with(spark, index, "newcomer") == [day.date()]
    before = sorted(map(str, spark.read.parquet(f"{index}/postings").collect()))
    postings.index_store(spark, store, index)
    assert sorted(map(str, spark.read.parquet(f"{index}/postings").collect())) == before
    assert before == sorted(map(str, postings.postings_of(read_events(spark, store)).select("field", "value", "event_date").collect()))


def test_latest_reads_the_newest_folders(spark, store):
    for n in (1, 7, 100, 1000):
        assert keys(postings.latest_stored(spark, store, n)) == keys(filters.latest_events(read_events(spark, store), n))
    assert len(postings.newest_dates(spark, store, 3)) <= 3 and len(postings.newest_dates(spark, store, 10)) <= 15
    assert folders_read(postings.latest_stored(spark, store, 3)) <= 3
    rare = filters.listed_events(read_events(spark, store), ["repo.destroy"])
    assert keys(postings.latest_stored(spark, store, 5, ["repo.destroy"])) == keys(filters.latest_events(rare, 5))
    assert len(postings.newest_dates(spark, store, 5, ["none"])) == len(postings.store_dates(spark, store))


def test_sketches_are_exact_while_small(spark):
    rows = random_rows(5, 500)
    days = sketches.day_sketches(events(spark, rows))
    for date_range in (("2024-01-10", "2024-02-20"), ("2024-01-01", "2024-04-30"), ("2030-01-01", "2030-01-02")):
        chosen = filters.in_date_range(events(spark, rows), date_range)
        exact = activity.dataset_summary(chosen).first()
        got = sketches.range_counts(days, date_range).first()
        assert (got.event_count, got.unique_actors, got.unique_actions) == (exact.event_count, exact.unique_actors, exact.unique_actions)
        assert got.unique_addresses == chosen.select("actor_ip").where("actor_ip IS NOT NULL").distinct().count()
    split = {r.is_bot: r.unique_actors for r in sketches.range_counts(days, ("2024-01-01", "2024-04-30"), "is_bot").collect()}
    assert split == {True: 1, False: 4}


def test_error_of_large_counts_is_bounded(spark):
    lg, n = 10, 60_000
    rows = spark.range(n).selectExpr("timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 30)) AS date_jst", "concat('u', id % 50000) AS actor", "'x' AS action", "CAST(NULL AS string) AS actor_ip")
    days = sketches.day_sketches(rows, lg)
    got = sketches.range_counts(days, ("2024-01-01", "2024-01-30"), lg=lg).first().unique_actors
    assert abs(got / 50_000 - 1) < 4 * 2 ** (-lg / 2)
    row = sketches.compare_periods(days, ("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-30"), lg).first()
    first = {i % 50_000 for i in range(n) if i % 30 < 15}
    second = {i % 50_000 for i in range(n) if i % 30 >= 15}
    union = len(first | second)
    for name, exact in (("first_actors", first), ("second_actors", second), ("in_both", first & second), ("only_first", first - second), ("only_second", second - first)):
        assert abs(row[name] - len(exact)) < 4 * 2 ** (-lg / 2) * union
    # No event is needed any more: a day is a row of bounded size.
    assert days.selectExpr("max(length(actors)) AS m").first().m < 16 * 2**lg and days.count() == 30
