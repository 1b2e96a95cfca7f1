"""Every registered analysis equals its DuckDB oracle on the smallest test data."""

import pytest

import __spark_entry__ as E
from tools.compare import compare
from trailmark.plans import registry

KEYS = sorted(registry.queries())


def test_every_query_has_oracle_sql():
    assert set(registry.oracle_sql()) == set(KEYS) <= set(E.queries())


@pytest.fixture(scope="module")
def results(spark, small_dir):
    return compare(spark, small_dir, KEYS, verbose=False)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(results, key):
    r = results[key]
    assert r.get("ok") is True, r
    assert "types" not in r, r


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns[0] == "segment"


def test_results_do_not_depend_on_the_session_time_zone(spark, small_dir):
    keys = ["calendar_features", "hour_weekday_heatmap", "bounce_rate_weekly",
            "volume_with_month_total", "next_page_pathing", "product_refund_rates"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        res = compare(spark, small_dir, keys, verbose=False)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert all(r.get("ok") is True and "types" not in r for r in res.values()), res
