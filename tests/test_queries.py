"""Every registered query against its SQL twin, on whole tables."""

import oracle
import pytest

import __spark_entry__ as entry

from trailspark.binding.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    columns, rows = oracle.spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = oracle.oracle_rows(duck, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry_is_the_dormancy_report(spark):
    assert entry.entry(spark).limit(1).count() == 1


# Counts worked out for this table binding independently of the code.
KNOWN = {
    "f09_critical_events": 46, "f10_high_risk_events": 20, "f11_off_hours": 721, "f11_off_hours_with_friday": 775,
    "a13_bulk_operations": 1, "a14_multi_ip_actors": 3, "j04_former_users": 1, "t4_monthly_series": 12,
}


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_known_counts(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() == KNOWN[name]


def test_known_dormancy(spark):
    row = QUERIES["a17_dormancy_kpis"](spark, "/root/testdata/sf0.001").first()
    assert (row.complete_dormant, row.low_activity, row.watch_needed) == (138, 1, 9)
    assert row.total_members - row.dormant_count == 2
