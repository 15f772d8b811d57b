"""Loading exports: layouts, times, missing and null keys, faults."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from trailspark.session import scratch_path
from trailspark.sources import directory, sinks, text
from trailspark.sources.events import ingest_events, load_events, parse_events, read_events, read_rejects, write_events
from trailspark.operators import activity, filters


def write(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content, encoding="utf-8")
    return str(folder)


def event(**fields):
    return json.dumps({"@timestamp": 1736899200123, "action": "git.push", "actor": "a", "org": "o", **fields})


def loaded(spark, path, layout="auto"):
    return [row.asDict() for row in load_events(spark, path, layout).events.collect()]


def test_layouts_are_told_apart(spark, tmp_path):
    folder = tmp_path / "logs"
    write(folder, "lines.ndjson", event(actor="n1") + "\n\n  \n" + event(actor="n2") + "\r\n")
    write(folder, "array.json", "  \n[" + event(actor="a1") + ",\n" + event(actor="a2") + "]\n")
    write(folder, "pretty name.json", json.dumps([json.loads(event(actor="p1")), json.loads(event(actor="p2"))], indent=2))
    write(folder, "lines.json", "\n" + event(actor="l1") + "\n" + event(actor="l2"))
    path = write(folder, "blank.json", " \n \n")
    result = load_events(spark, path)
    assert sorted(row.actor for row in result.events.collect()) == ["a1", "a2", "l1", "l2", "n1", "n2", "p1", "p2"]
    assert result.rejects.count() == 0
    counts = {row["_source_file"]: row.event_count for row in activity.file_counts(result.events).collect()}
    assert counts == {"lines.ndjson": 2, "array.json": 2, "pretty name.json": 2, "lines.json": 2}
    summary = activity.dataset_summary(result.events).first()
    size = sum((folder / name).stat().st_size for name in counts)
    assert (summary.event_count, summary.file_count, summary.total_bytes, summary.unique_actors) == (8, 4, size, 8)


def test_bracket_in_ndjson_file_is_no_array(spark, tmp_path):
    path = write(tmp_path / "logs", "x.ndjson", "[" + event() + "]\n" + event())
    result = load_events(spark, path)
    assert result.events.count() == 1
    assert [row.reject_reason for row in result.rejects.collect()] == ["not_an_object"]


def test_layout_can_be_named(spark, tmp_path):
    path = write(tmp_path / "logs", "x.json", "[" + event(actor="a") + "," + event(actor="b") + "]")
    assert len(loaded(spark, path, "array")) == 2
    assert load_events(spark, path, "lines").rejects.count() == 1
    with pytest.raises(ValueError):
        load_events(spark, path, "csv")


def test_files_of_one_name_are_several(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for folder in ("a", "b"):
        write(tmp_path / "logs" / folder, "audit log.ndjson", event(actor=folder))
    events = load_events(spark, str(tmp_path / "logs")).events
    summary = activity.dataset_summary(events).first()
    size = len(event(actor="a"))
    assert (summary.file_count, summary.total_bytes) == (2, 2 * size)
    counts = activity.file_counts(events).collect()
    assert [(row["_source_path"].split("/")[-2:], row["_source_file"], row.event_count) for row in counts] == [
        (["a", "audit log.ndjson"], "audit log.ndjson", 1), (["b", "audit log.ndjson"], "audit log.ndjson", 1),
    ]


def test_array_lines_split_over_tasks(spark, tmp_path):
    elements = [event(actor=f"a{n:05d}") for n in range(3000)]
    path = write(tmp_path / "logs", "big.json", "[\n" + ",\n".join(elements) + "\n]\n")
    write(tmp_path / "logs", "tight.json", "[" + event(actor="x") + ",\n" + event(actor="y") + "]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        records = text.raw_records(spark, path, "array_lines")
        assert records.rdd.getNumPartitions() > 3
        result = load_events(spark, path, "array_lines")
        assert sorted(row.actor for row in result.events.collect()) == [f"a{n:05d}" for n in range(3000)] + ["x", "y"]
        assert result.rejects.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_file_too_large_for_a_row_loads_in_pieces(spark, tmp_path):
    write(tmp_path / "logs", "small.json", "[" + event() + "]")
    path = write(tmp_path / "logs", "large.json", "[" + ",".join([event()] * 50) + "]")
    result = parse_events(text.raw_records(spark, path, "auto", max_bytes=1000))
    assert result.events.count() == 51 and result.rejects.count() == 0


def test_same_event_in_two_files_stays_twice(spark, tmp_path):
    write(tmp_path / "logs", "a.ndjson", event())
    path = write(tmp_path / "logs", "b.ndjson", event())
    assert len(loaded(spark, path)) == 2


TIMES = [
    (1736899200123, "2025-01-15T09:00:00.123"),
    (1736899200123.5, "2025-01-15T09:00:00.123500"),
    (10**12 + 1, "2001-09-09T10:46:40.001"),
    (1736899200, "2025-01-15T09:00:00"),
    (1736899200.25, "2025-01-15T09:00:00.250"),
    (1.7368992e9, "2025-01-15T09:00:00"),
    (0, "1970-01-01T09:00:00"),
    (-1, "1970-01-01T08:59:59"),
    ("1736899200123", "2025-01-15T09:00:00.123"),
    ("2025-01-15T00:00:00Z", "2025-01-15T09:00:00"),
    ("2025-01-15T00:00:00", "2025-01-15T09:00:00"),
    ("2025-01-15 00:00:00.000001", "2025-01-15T09:00:00.000001"),
    ("2025-01-15", "2025-01-15T09:00:00"),
    ("2025-01-15T09:00:00+09:00", "2025-01-15T09:00:00"),
    ("2025-01-14T19:00:00.5-0500", "2025-01-15T09:00:00.5"),
    ("2025-01-15T15:30:00Z", "2025-01-16T00:30:00"),
]


def test_times(spark, tmp_path):
    lines = [event(**{"@timestamp": stamp, "actor": str(n)}) for n, (stamp, _) in enumerate(TIMES)]
    path = write(tmp_path / "logs", "x.ndjson", "\n".join(lines))
    found = {int(row["actor"]): row["date_jst"] for row in loaded(spark, path, "lines")}
    assert found == {n: dt.datetime.fromisoformat(expected) for n, (_, expected) in enumerate(TIMES)}


FAULTS = [
    ('{"@timestamp": 1000000000000}', "bad_timestamp"),  # exactly the limit is seconds, beyond the calendar
    ('{"@timestamp": null, "timestamp": 1736899200}', "bad_timestamp"),
    ('{"@timestamp": true}', "bad_timestamp"),
    ('{"@timestamp": "yesterday"}', "bad_timestamp"),
    ('{"@timestamp": "20250101"}', None),  # digits only: a number of seconds
    ('{"@timestamp": "2025-02-30"}', "bad_timestamp"),
    ('{"@timestamp": "10:00"}', "bad_timestamp"),
    ('{"@timestamp": [1736899200]}', "bad_timestamp"),
    ('{"action": "x"}', "bad_timestamp"),
    ('{}', "bad_timestamp"),
    ('{"@timestamp": 1736899200', "malformed_json"),
    ('{"@timestamp": 1736899200} x', "malformed_json"),
    ("{'@timestamp': 1736899200}", "malformed_json"),
    ('{"@timestamp": 1736899200},{"@timestamp": 1736899200}', "not_an_object"),
    ('{"@timestamp": 1736899200}]', "malformed_json"),
    ('17', "not_an_object"),
    ('null', "not_an_object"),
    ('"text"', "not_an_object"),
]


def test_rejects_name_the_fault(spark, tmp_path):
    path = write(tmp_path / "logs", "x.ndjson", "\n".join([record for record, _ in FAULTS] + [event()]))
    result = load_events(spark, path)
    rejects = sorted((row.raw, row.reject_reason) for row in result.rejects.collect())
    assert rejects == sorted((record, reason) for record, reason in FAULTS if reason)
    assert result.events.count() == 1 + sum(reason is None for _, reason in FAULTS)


def test_broken_arrays_are_rejected_whole(spark, tmp_path):
    documents = ["[{} ][{}]", "[{}] x", "[{},", "[{}]]", "[{}],[{}]"]
    for n, document in enumerate(documents):
        path = write(tmp_path / "logs", f"{n}.json", document)
    result = load_events(spark, path)
    assert result.events.count() == 0
    assert sorted(row.raw for row in result.rejects.collect()) == sorted(documents)


def test_missing_and_null_keys(spark, tmp_path):
    lines = [
        '{"timestamp": 1736899200}',
        '{"@timestamp": 1736899200, "action": null, "actor": null, "org": null, "repo": null}',
        '{"@timestamp": 1736899200, "actor": "first", "actor": "last", "action": 5, "actor_is_bot": true, "actor_ip": "1.1.1.1"}',
    ]
    path = write(tmp_path / "logs", "x.ndjson", "\n".join(lines))
    rows = sorted(loaded(spark, path), key=lambda row: str(row["actor"]))
    assert [(r["action"], r["actor"], r["org"], r["repo"]) for r in rows] == [
        (None, None, None, None), ("5", "last", "unknown", None), ("unknown", "unknown", "unknown", None),
    ]
    assert rows[1]["actor_is_bot"] is True and rows[1]["actor_ip"] == "1.1.1.1"


def test_store_round_trip_prunes_folders(spark, tmp_path):
    lines = [event(**{"@timestamp": f"2025-01-{day:02d}T16:00:00Z"}) for day in range(1, 11)]
    path = write(tmp_path / "logs", "x.ndjson", "\n".join(lines))
    store = scratch_path(spark, "store")
    write_events(load_events(spark, path).events, store)
    stored = read_events(spark, store)
    assert stored.count() == 10
    some = filters.in_date_range(stored, ("2025-01-03", "2025-01-04"))
    assert sorted(row.date_jst.day for row in some.collect()) == [3, 4]
    plan = some._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "event_date" in partition_filters
    assert "GreaterThanOrEqual(date_jst" in plan


def test_time_range_prunes_folders(spark, tmp_path):
    lines = [event(**{"@timestamp": f"2025-01-{day:02d}T16:00:00Z"}) for day in range(1, 11)]
    path = write(tmp_path / "logs", "x.ndjson", "\n".join(lines))
    store = scratch_path(spark, "store")
    write_events(load_events(spark, path).events, store)
    some = filters.in_time_range(read_events(spark, store), "2025-01-03 01:00:00", "2025-01-04 00:59:59")
    assert [row.date_jst for row in some.collect()] == [dt.datetime(2025, 1, 3, 1)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    bounds = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "event_date" in bounds and ">=" in bounds and "<=" in bounds


def test_ingest_keeps_events_and_rejects_in_one_store(spark, tmp_path):
    lines = [event(actor="a"), event(actor="b", **{"@timestamp": "2025-02-01"}), '{"actor": "c"}', "{bad"]
    write(tmp_path / "logs", "x.ndjson", "\n".join(lines))
    path = write(tmp_path / "logs", "y.json", "[" + event(actor="d") + "]")
    store = scratch_path(spark, "ingest")
    ingest_events(spark, path, store)
    ingest_events(spark, str(tmp_path / "logs" / "y.json"), store, layout="array")
    expected = load_events(spark, path)
    stored = read_events(spark, store)
    assert sorted(row.actor for row in stored.collect()) == ["a", "b", "d", "d"]
    assert set(stored.drop("event_date").collect()) == set(expected.events.collect())
    assert set(read_rejects(spark, store).collect()) == set(expected.rejects.collect())
    assert read_rejects(spark, store).count() == 2


def test_members(spark, tmp_path):
    members = [
        {"login": "a", "id": 1, "type": "Bot", "site_admin": True, "url": "x"},
        {"login": "b", "id": 2},
        {"login": "c", "id": 3, "type": None, "site_admin": None},
    ]
    path = write(tmp_path / "m", "members.json", json.dumps(members, indent=2))
    rows = [tuple(row) for row in directory.load_members(spark, path).orderBy("id").collect()]
    assert rows == [("a", 1, "Bot", True), ("b", 2, "User", False), ("c", 3, None, None)]
    bad = write(tmp_path / "bad", "members.json", "[1]")
    with pytest.raises(Exception, match="not a member record"):
        directory.load_members(spark, bad).collect()


def seat(login, org="o", **fields):
    return {"assignee": {"login": login, "id": 7}, "organization": {"login": org}, **fields}


def test_seats(spark, tmp_path):
    folder = tmp_path / "s"
    write(folder, "one.json", json.dumps({"total_seats": 3, "seats": [
        seat("a", "org-1", last_activity_at="2025-01-15T00:00:00Z", last_activity_editor="vim",
             pending_cancellation_date="2026-01-16", created_at="2024-05-01T10:00:00+09:00"),
        seat("b", "org-2", last_activity_at=None), {"assignee": None, "organization": {}, "last_activity_at": ""},
    ]}, indent=2))
    path = write(folder, "two.json", '{"total_seats": 0, "seats": []}')
    write(folder, "three.json", '{"total_seats": 0}')
    documents = directory.read_seat_documents(spark, path)
    summary = {row["_source_file"]: (row.org_name, row.seat_count) for row in directory.seat_file_summary(documents).collect()}
    assert summary == {"one.json": ("org-1", 3), "two.json": ("unknown", 0), "three.json": ("unknown", 0)}
    rows = directory.load_seats(spark, path).orderBy(F.col("login").asc_nulls_last()).collect()
    assert tuple(rows[0]) == ("a", 7, "org-1", dt.datetime(2024, 5, 1, 10), dt.datetime(2025, 1, 15, 9), "vim",
                              dt.datetime(2026, 1, 16))
    assert rows[1].last_activity_at is None and rows[2].login is None


@pytest.mark.parametrize("document, fault", [
    ('{"seats": []}{"seats": []}', "(?i)malformed|parse"),
    ('{"seats": [', "(?i)malformed|parse"),
    (json.dumps({"seats": [seat("a", last_activity_at="soon")]}), "not a seat time"),
])
def test_bad_seat_documents_stop_the_load(spark, tmp_path, document, fault):
    path = write(tmp_path / "s", "x.json", document)
    with pytest.raises(Exception, match=fault):
        directory.load_seats(spark, path).collect()


def test_seat_documents_page_large_organisations(spark):
    rows = [("u%d" % (i % 5), 1, "big", None, None, None, None) for i in range(1000)] + [
        ("v", 2, "small", None, dt.datetime(2025, 1, 1), "vim", None)]
    seats = spark.createDataFrame(rows, "login string, user_id long, org_name string, created_at timestamp_ntz, "
                                        "last_activity_at timestamp_ntz, last_activity_editor string, "
                                        "pending_cancellation_date timestamp_ntz")
    documents = sinks.seat_documents(seats, page_size=50)
    found = {}
    for row in documents.collect():
        found.setdefault(row.org_name, []).append((row.total_seats, row.page, len(row.seats)))
    big = found["big"]
    assert {total for total, _, _ in big} == {1000} and sum(n for _, _, n in big) == 1000
    assert len(big) > 5 and len({page for _, page, _ in big}) == len(big) and found["small"] == [(1, 0, 1)]
    path = scratch_path(spark, "seats")
    sinks.write_seat_documents(seats, path, page_size=50)
    back = directory.load_seats(spark, path, layout="lines")
    key = lambda row: tuple(str(cell) for cell in row)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)


def test_csv_export_text(spark, tmp_path):
    df = spark.createDataFrame([("a", "", -1)], "login string, editor string, days int")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    parts = [p.read_text() for p in (tmp_path / "csv").glob("*.csv")]
    assert parts == ["login,editor,days\na,,-1\n"]


def test_empty_folder_loads_empty(spark, tmp_path):
    path = write(tmp_path / "logs", "x.ndjson", "")
    assert loaded(spark, path) == []
    assert text.raw_records(spark, path).count() == 0
