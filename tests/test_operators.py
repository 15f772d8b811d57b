"""Operators on small frames: boundaries, nulls, ties, identities, empty input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trailspark.functions import labels
from trailspark.operators import activity, anomaly, dormancy, filters, profile, series
from trailspark.operators.lists import paged_lists
from trailspark.plans import reports
from trailspark.streaming import detections
from trailspark.schema import CRITICAL_ACTIONS, EVENT_SCHEMA, HIGH_RISK_ACTIONS, SEAT_SCHEMA

NOON = dt.datetime(2024, 1, 3, 12)  # a Wednesday
AS_OF = dt.datetime(2024, 2, 1)


def events(spark, *rows):
    """Events from dicts; what is not given is null, the time is a Wednesday noon."""
    full = [tuple({"date_jst": NOON, **row}.get(name) for name in EVENT_SCHEMA.names) for row in rows]
    return spark.createDataFrame(full, EVENT_SCHEMA)


def times(n, **row):
    return [row] * n


def members(spark, *logins):
    return spark.createDataFrame([(x, n, "User", False) for n, x in enumerate(logins)],
                                 "login string, id long, type string, site_admin boolean")


def seats(spark, *rows):
    full = [tuple(row.get(name) for name in SEAT_SCHEMA.names) for row in rows]
    return spark.createDataFrame(full, SEAT_SCHEMA)


def values(df, *names):
    return [tuple(row[name] for name in (names or df.columns)) for row in df.collect()]


# ---------------------------------------------------------------- filters


def test_date_range_takes_whole_last_day(spark):
    moments = [dt.datetime(2024, 1, 1) - dt.timedelta(microseconds=1), dt.datetime(2024, 1, 1),
               dt.datetime(2024, 1, 2, 23, 59, 59, 999999), dt.datetime(2024, 1, 3)]
    df = events(spark, *[{"date_jst": m} for m in moments])
    found = values(filters.in_date_range(df, (dt.date(2024, 1, 1), dt.date(2024, 1, 2))), "date_jst")
    assert sorted(found) == [(moments[1],), (moments[2],)]
    assert filters.in_date_range(df, None).count() == 4
    assert values(activity.selected_counts(df, ("2024-01-01", "2024-01-02"))) == [(2, 4)]
    assert values(activity.selected_counts(df, None)) == [(4, 4)]
    assert filters.in_time_range(df, moments[1], moments[2]).count() == 2


def test_period_has_no_upper_bound(spark):
    start = AS_OF - dt.timedelta(days=90)
    df = events(spark, {"date_jst": start - dt.timedelta(microseconds=1)}, {"date_jst": start},
                {"date_jst": AS_OF + dt.timedelta(days=400)})
    assert filters.in_period(df, AS_OF, 3).count() == 2
    assert filters.in_period(df, "2024-02-01", 3).count() == 2


def test_search_is_a_lower_cased_pattern_with_null_safe_or(spark):
    df = events(spark, {"action": "Git.Push", "actor": "a"}, {"action": "x", "actor": "b", "repo": "GIT-1"},
                {"action": "x", "actor": "c"}, {"action": None, "actor": "git", "repo": None}, {"action": "gXt", "actor": "d"})
    assert sorted(values(filters.matching(df, "G.T"), "actor")) == [("a",), ("b",), ("d",), ("git",)]
    assert sorted(values(filters.matching(df, "Git.", literal=True), "actor")) == [("a",)]
    assert filters.matching(df, "").count() == 5
    assert filters.matching(df, r"\S-1").count() == 0  # lower-casing turns it into \s
    assert filters.with_actions(df, []).count() == 5
    assert filters.with_actions(df, ["x"]).count() == 2


def test_two_bot_rules(spark):
    df = events(spark, {"actor": "x[bot]"}, {"actor": "x[bot]-old"}, {"actor": "x"}, {"actor": None})
    assert values(filters.without_bots(df), "actor") == [("x",)]
    split = dormancy.bot_human_split(df, AS_OF, 3).first()
    assert (split.bot_actor_count, split.human_actor_count) == (1, 3)  # null is one human actor
    assert (split.bot_event_count, split.human_event_count) == (1, 3)


def test_latest_events_break_ties(spark):
    df = events(spark, *[{"actor": a, "action": "x"} for a in "cab"], {"date_jst": AS_OF, "actor": "z"})
    assert values(filters.latest_events(df, 3), "actor") == [("z",), ("a",), ("b",)]
    assert values(filters.critical_events(df, ["x"]), "actor") == [("a",), ("b",), ("c",)]


# ---------------------------------------------------------------- counts and rankings


def test_rankings(spark):
    df = events(spark, *times(2, actor="b", action="x", repo="r1"), *times(2, actor="a", action="y"),
                *times(3, actor="z[bot]", action="x", team="t"), {"actor": None, "action": None})
    assert values(activity.events_per_actor(df)) == [("z[bot]", 3), ("a", 2), ("b", 2), (None, 1)]
    assert values(activity.top_actors(df, 1)) == [("a", 2)]
    assert values(activity.top_actors(df, 1, exclude_bots=False)) == [("z[bot]", 3)]
    assert values(activity.user_totals(df)) == [(4, 8, 2.0)]
    assert values(activity.actor_actions(df)) == [(None, None, 1), ("a", "y", 2), ("b", "x", 2), ("z[bot]", "x", 3)]
    assert values(activity.action_distribution(df)) == [("x", 5), ("y", 2), (None, 1)]
    assert values(activity.action_distribution(df, 1)) == [("x", 5)]
    assert values(activity.top_repos(df)) == [("r1", 2)]
    assert values(activity.top_teams(df)) == [("t", 3)]
    assert values(activity.distinct_actions(df)) == [(None,), ("x",), ("y",)]


def test_summary_counts_null_as_a_value(spark):
    df = events(spark, {"actor": "a", "action": "x", "_source_path": "d/f", "_source_bytes": 10},
                {"actor": None, "action": "x", "_source_path": "d/f", "_source_bytes": 10},
                {"actor": None, "action": "y", "_source_path": "e/f", "_source_bytes": 5, "date_jst": AS_OF})
    assert values(activity.dataset_summary(df)) == [(3, 2, 15, NOON, AS_OF, 2, 2)]
    assert values(activity.data_span(df)) == [(NOON.date(), AS_OF.date(), 28)]
    assert values(profile.event_profile(df)) == [(3, NOON.date(), AS_OF.date(), 2, 2)]


# ---------------------------------------------------------------- anomalies


def test_bulk_operations_are_strictly_above_in_a_clock_hour(spark):
    early, late = NOON.replace(minute=59, second=59), NOON.replace(hour=13)
    df = events(spark, *times(2, actor="a", action="x"), *times(1, actor="a", action="x", date_jst=early),
                *times(2, actor="a", action="x", date_jst=late), *times(3, actor=None, action="x"))
    assert values(anomaly.bulk_operations(df, 2)) == [("a", "x", NOON, 3), (None, "x", NOON, 3)]
    assert anomaly.bulk_operations(df, 3).count() == 0


def test_addresses(spark):
    rows = [{"actor": a, "actor_ip": ip} for a, ips in {"two": "12", "three": "1233", None: "abc"}.items() for ip in ips]
    df = events(spark, *rows, *times(4, actor="two", actor_ip=None))
    assert values(anomaly.multi_ip_actors(df)) == [("three", 3), (None, 3)]
    lists = sorted(values(anomaly.multi_ip_lists(df)), key=str)
    assert lists == [("three", 3, "1"), ("three", 3, "2"), ("three", 3, "3"), (None, 3, "a"), (None, 3, "b"), (None, 3, "c")]


def test_long_lists_are_paged_and_whole(spark):
    rows = [("hot", f"{n:04d}") for n in range(2000)] + [("copies", "x")] * 500 + [("cold", "y")]
    df = spark.createDataFrame(rows, "k string, v string")
    pages = paged_lists(df, "k", "v", 100).collect()
    back = sorted((row.k, v) for row in pages for v in row["items"])
    assert back == sorted(rows)
    assert {row.k: row.total for row in pages} == {"hot": 2000, "copies": 500, "cold": 1}
    assert max(len(row["items"]) for row in pages) < 500
    assert all(row["items"] == sorted(row["items"]) for row in pages)


@pytest.mark.parametrize("critical, high, off_hours, score, level", [
    (0, 0, 0, 0, "低リスク"), (0, 0, 99, 0, "低リスク"), (0, 0, 100, 1, "中リスク"), (4, 1, 400, 49, "中リスク"),
    (5, 0, 0, 50, "高リスク"), (9, 1, 400, 99, "高リスク"), (10, 0, 0, 100, "重大リスク"),
])
def test_risk_levels(spark, critical, high, off_hours, score, level):
    night = NOON.replace(hour=3)
    df = events(spark, {"actor": "x", "action": "quiet"}, *times(critical, action=CRITICAL_ACTIONS[0], actor="a"),
                *times(high, action=HIGH_RISK_ACTIONS[0], actor="b"), *times(off_hours, action="n", date_jst=night))
    row = anomaly.risk_summary(df, bulk_threshold=1000).first()
    assert (row.risk_score, row.risk_level) == (score, level)
    assert (row.critical_events, row.high_risk_events, row.off_hours_events) == (critical, high, off_hours)


def test_risk_scopes_and_missing_addresses(spark):
    old = NOON - dt.timedelta(days=10)
    df = events(spark, *times(3, action="repo.destroy", actor="a", date_jst=old.replace(hour=20)),
                {"action": "repo.destroy", "actor": "a"}, {"action": "x", "actor": "a", "actor_ip": "1"})
    day = (NOON.date(), NOON.date())
    written = anomaly.risk_summary(df, day, 2).first()
    assert (written.critical_events, written.bulk_operations, written.off_hours_events) == (1, 1, 3)
    inside = anomaly.risk_summary(df, day, 2, scope="filtered").first()
    assert (inside.critical_events, inside.bulk_operations, inside.off_hours_events) == (1, 0, 0)
    assert anomaly.risk_summary(df.drop("actor_ip"), day, 2).first().multi_ip_actors == 0
    with pytest.raises(ValueError):
        anomaly.risk_summary(df, scope="some")


# ---------------------------------------------------------------- dormancy


def test_latest_seat_takes_one_whole_row(spark):
    jan, feb = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    df = seats(
        spark,
        {"login": "a", "org_name": "z", "last_activity_at": feb, "last_activity_editor": None},
        {"login": "a", "org_name": "y", "last_activity_at": jan, "last_activity_editor": "vim"},
        {"login": "a", "org_name": "x", "last_activity_at": None, "last_activity_editor": "old"},
        {"login": "tie", "org_name": "2", "last_activity_at": jan}, {"login": "tie", "org_name": "1", "last_activity_at": jan},
        {"login": "never", "org_name": "b", "created_at": jan}, {"login": "never", "org_name": "b", "created_at": feb},
        {"login": None, "org_name": "n"},
    )
    rows = {row.login: row for row in dormancy.latest_seats(df).collect()}
    assert (rows["a"].org_name, rows["a"].last_activity_editor) == ("z", None)
    assert rows["tie"].org_name == "1" and rows["never"].created_at == feb and None in rows and len(rows) == 4


@pytest.mark.parametrize("threshold, expected", [
    (5, {"m0": "完全休眠", "m1": "低活動", "m2": "低活動", "m3": "要観察", "m5": "要観察"}),
    (1, {"m0": "完全休眠", "m1": "要観察"}),
    (0, {"m0": "完全休眠"}),
])
def test_status_thresholds(spark, threshold, expected):
    df = events(spark, *[row for n in (1, 2, 3, 5, 6) for row in times(n, actor=f"m{n}", action="x")])
    people = members(spark, "m0", "m1", "m2", "m3", "m5", "m6")
    summary = dormancy.member_summary(df, people, None, AS_OF)
    dormant = dormancy.dormant_members(summary, threshold)
    assert dict(values(dormant, "login", "status")) == expected
    kpis = dormancy.dormancy_kpis(summary, threshold).first()
    assert (kpis.total_members, kpis.dormant_count) == (6, len(expected))
    assert kpis.complete_dormant + kpis.low_activity + kpis.watch_needed == len(expected)
    assert kpis.dormant_ratio == pytest.approx(len(expected) / 6 * 100)
    assert sum(n for _, n in values(dormancy.status_counts(dormant))) == len(expected)


def test_summary_columns(spark):
    seat_time = NOON + dt.timedelta(days=3)
    df = events(spark, {"actor": "a", "action": "x"}, {"actor": "a", "action": None}, {"actor": "other", "action": "x"})
    owned = seats(spark, {"login": "a", "last_activity_at": seat_time, "last_activity_editor": "vim"})
    rows = {r.login: r for r in dormancy.member_summary(df, members(spark, "a", "b"), owned, AS_OF).collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a.audit_event_count, a.unique_actions, a.last_audit_activity) == (2, 2, NOON)
    assert (a.copilot_last_activity, a.last_activity, a.days_inactive) == (seat_time, seat_time, 25)
    assert (b.audit_event_count, b.last_activity, b.days_inactive) == (0, None, None)
    dormant = dormancy.dormant_members(dormancy.member_summary(df, members(spark, "b"), None, AS_OF))
    assert values(dormancy.dormant_table(dormant)) == [("b", "完全休眠", 0, 0, "-", "-", "-", "N/A")]
    assert values(dormancy.dormant_export(dormant)) == [("b", "完全休眠", 0, 0, "", "", "", -1)]


def test_listed_twice_stays_twice(spark):
    df = events(spark, {"actor": "a", "action": "x"})
    assert dormancy.member_summary(df, members(spark, "a", "a"), None, AS_OF).count() == 2
    assert dormancy.member_events(df, members(spark, "a", "a")).count() == 1
    trend = dormancy.monthly_trend(df, members(spark, "a", "a"), AS_OF)
    assert values(trend) == [(dt.datetime(2024, 1, 1), 1, 1)]


def test_former_users(spark):
    df = events(spark, *[{"actor": f"old{n:02d}"} for n in range(12)], {"actor": "bot[bot]"}, {"actor": None}, {"actor": "m"},
                {"actor": "old00", "date_jst": dt.datetime(2000, 1, 1)})
    people = members(spark, "m", None)
    assert dormancy.former_users(df, people).count() == 12
    row = dormancy.former_user_report(df, people, 3).first()
    assert tuple(row) == (12, "old00, old01, old02", 9)
    nobody = dormancy.former_user_report(df.where("actor = 'm'"), people).first()
    assert (nobody.former_count, nobody.more) == (0, 0)
    owned = seats(spark, {"login": "old01"}, {"login": "m"})
    assert values(dormancy.former_user_seats(df, people, owned), "login") == [("old01",)]


def test_trend(spark):
    dec, jan = dt.datetime(2023, 12, 31, 23), dt.datetime(2024, 1, 1)
    df = events(spark, *times(4, actor="busy", date_jst=dec), *times(3, actor="busy", date_jst=jan),
                *times(2, actor="quiet", date_jst=jan), *times(9, actor="stranger", date_jst=jan), *times(9, actor=None))
    trend = dormancy.monthly_trend(df, members(spark, "busy", "quiet", "absent"), AS_OF)
    assert values(trend) == [(dt.datetime(2023, 12, 1), 4, 0), (jan, 5, 2)]
    long = sorted(values(dormancy.trend_long(trend), "month_label", "category", "events"))
    assert long == [("2023-12", "休眠ユーザー", 0), ("2023-12", "全ユーザー", 4),
                    ("2024-01", "休眠ユーザー", 2), ("2024-01", "全ユーザー", 5)]


def test_seat_usage(spark):
    df = events(spark, *times(9, actor="busy"))
    dormant = dormancy.dormant_members(dormancy.member_summary(df, members(spark, "busy", "a", "b", "c"), None, AS_OF))
    owned = seats(spark, {"login": "a", "last_activity_at": NOON, "last_activity_editor": "vim"},
                  {"login": "b", "pending_cancellation_date": NOON}, {"login": "busy"}, {"login": "gone"})
    assert values(dormancy.seat_usage(dormant, owned)) == [(2, 1, 1, 1)]
    assert values(dormancy.seat_profile(owned)) == [(4, 1, 3, 1)]
    assert values(dormancy.editor_distribution(dormant, owned)) == [("vim", 1)]


@pytest.mark.parametrize("low, high, bins, step", [
    (0, 47, 30, 2), (0, 300, 30, 10), (0, 1, 30, 0.05), (7, 7, 30, 0.05), (0, 31, 30, 2), (0, 30, 30, 1),
    (0, 99, 10, 10), (0, 5_000_000, 30, 200_000),
])
def test_histogram_step(spark, low, high, bins, step):
    ends = spark.range(1).select(F.lit(low).alias("smallest"), F.lit(high).alias("largest"))
    assert dormancy.histogram_step(ends, bins).first()[0] == pytest.approx(step)


def test_histogram_step_stays_small(spark):
    ends = spark.range(5).agg(F.min("id").alias("smallest"), F.max("id").alias("largest"))
    plan = dormancy.histogram_step(ends, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LOG10") + plan.count("log10") <= 3 and plan.count("CASE WHEN") <= 12


def test_empty_risk_lists_find_nothing(spark):
    df = events(spark, *times(2, actor="a", action=CRITICAL_ACTIONS[0]), *times(1, actor="a", action=HIGH_RISK_ACTIONS[0]))
    assert filters.critical_events(df, []).count() == 0 and filters.high_risk_events(df, []).count() == 0
    row = anomaly.risk_summary(df, critical_actions=[], high_risk_actions=[]).first()
    assert (row.critical_events, row.high_risk_events) == (0, 0)
    assert filters.with_actions(df, []).count() == 3
    assert detections.critical_event_stream(df, []).count() == 0


def test_histogram(spark):
    summary = spark.createDataFrame([(n,) for n in (0, 0, 1, 5, 6, 47)], "audit_event_count long")
    rows = values(dormancy.activity_histogram(summary))
    assert rows == [(0.0, 2.0, "休眠", 3), (4.0, 2.0, "休眠", 1), (6.0, 2.0, "アクティブ", 1), (46.0, 2.0, "アクティブ", 1)]


# ---------------------------------------------------------------- labels and profile


@pytest.mark.parametrize("action, kind", [
    ("repo.create", "create"), ("org.add_member", "create"), ("app.uninstall", "create"), ("repo.destroy", "remove"),
    ("team.remove_repo", "remove"), ("repo.rename", "modify"), ("hook.config_changed", "modify"), ("git.clone", "access"),
])
def test_operation_types(spark, action, kind):
    assert spark.range(1).select(labels.operation_type(F.lit(action))).first()[0] == kind


def test_profile(spark):
    sunday_night = dt.datetime(2024, 1, 7, 23)
    df = events(spark, {"actor": "low-1", "action": "repo.access", "country_code": "RU", "date_jst": sunday_night},
                {"actor": "low-1", "country_code": None}, {"actor": "former-low-", "country_code": "JP"}, {"actor": None})
    assert values(profile.anomaly_indicators(df)) == [(1, 1, 1, 1)]
    assert values(profile.category_coverage(df)) == [(1, 1)]
    assert values(profile.top_values(df, "actor", 2)) == [("low-1", 2), ("former-low-", 1)]


# ---------------------------------------------------------------- whole reports


def test_bot_and_human_split_adds_up(spark):
    df = events(spark, *times(3, actor="a"), *times(2, actor="b[bot]"), {"actor": None})
    row = dormancy.bot_human_split(df, AS_OF, 3).first()
    assert row.bot_event_count + row.human_event_count == 6 and row.bot_actor_count + row.human_actor_count == 3


def test_reports(spark):
    df = events(spark, *times(2, actor="a", action="git.push", repo="r", team="t"), {"actor": "b", "action": "repo.destroy"})
    day = (NOON.date(), NOON.date())
    found = reports.track_actions(df, day, ["git.push"], "A")
    assert values(found.totals) == [(2, 1)] and values(found.repos) == [("r", 2)] and found.latest.count() == 2
    assert values(found.actions) == [("git.push", 2)] and values(found.teams) == [("t", 2)]
    users = reports.user_report(df, day, 1, user="b")
    assert values(users.top_actors) == [("a", 2)] and values(users.user_actions) == [("b", "repo.destroy", 1)]
    assert users.actors.count() == 2 and users.actor_actions.count() == 2 and values(users.totals) == [(2, 3, 1.5)]
    assert reports.user_report(df).user_actions is None
    risk = reports.risk_report(df, day, 1)
    assert risk.critical_events.count() == 1 and risk.high_risk_events.count() == 0 and risk.bulk_operations.count() == 1
    assert risk.off_hours_by_actor.count() == 0 and risk.multi_ip_actors.count() == 0
    assert values(risk.off_hours_share) == [(0, 3, 0.0)] and risk.summary.first().risk_score == 15
    assert values(reports.activity_series(df, "hour", day), "period", "period_str", "count") == [(NOON, "2024-01-03 12:00", 3)]


def test_empty_input(spark):
    df, nobody, none = events(spark).limit(0), members(spark, "x").limit(0), seats(spark, {"login": "x"}).limit(0)
    assert values(activity.dataset_summary(df)) == [(0, 0, 0, None, None, 0, 0)]
    assert values(activity.user_totals(df)) == [(0, 0, 0.0)]
    assert values(activity.data_span(df)) == [(None, None, None)]
    assert values(anomaly.off_hours_share(df)) == [(0, 0, 0.0)]
    assert values(anomaly.risk_summary(df)) == [("低リスク", 0, 0, 0, 0, 0, 0)]
    summary = dormancy.member_summary(df, nobody, none, AS_OF)
    assert values(dormancy.dormancy_kpis(summary)) == [(0, 0, 0, 0, 0, 0.0)]
    assert values(dormancy.bot_human_split(df, AS_OF)) == [(0, 0, 0, 0)]
    for result in (dormancy.activity_histogram(summary), dormancy.monthly_trend(df, nobody, AS_OF),
                   reports.dormancy_report(df, nobody, none, AS_OF), anomaly.bulk_operations(df),
                   anomaly.multi_ip_lists(df), series.peak_hour(df), filters.latest_events(df)):
        assert result.count() == 0
    assert values(dormancy.seat_profile(none)) == [(0, 0, 0, 0)]
    assert values(profile.anomaly_indicators(df)) == [(0, 0, 0, 0)]
