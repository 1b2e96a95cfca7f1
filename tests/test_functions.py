"""Column helpers: week-0, weekday, month names, exact rounding, zero denominators."""

import datetime as dt

from pyspark.sql import functions as F

from trailmark.functions import (
    avg_round1,
    cents_ratio_round2,
    month_name,
    pct_round2,
    ratio,
    ratio_pct,
    ts,
    week0,
    weekday0,
)


def test_week0_year_boundaries(spark):
    # Sunday-start weeks, days before the first Sunday are week 0
    cases = {"2012-01-01": 1, "2013-01-01": 0, "2012-12-31": 53, "2008-02-20": 7,
             "2011-12-31": 52, "2013-01-06": 1, "2013-01-05": 0}
    df = spark.createDataFrame([(k,) for k in cases], "d string").select(
        "d", week0(F.to_date("d")).alias("w"))
    got = {r.d: r.w for r in df.collect()}
    assert got == cases


def test_weekday_and_month_name(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",), ("2024-03-15",)], "d string")
    rows = df.select(weekday0(F.to_date("d")).alias("w"),
                     month_name(F.to_date("d")).alias("m")).collect()
    assert [(r.w, r.m) for r in rows] == [(0, "January"), (6, "January"), (4, "March")]


def test_exact_percent_rounds_half_up(spark):
    # 1/8 = 12.5% exactly; 1/3 = 33.333..; 2/3 = 66.666..; 1/200 = 0.5; 1/40000 -> 0.0025 -> 0.0
    df = spark.createDataFrame([(1, 8), (1, 3), (2, 3), (1, 200), (1, 80000), (1, 0), (0, 5)],
                               "n long, d long")
    got = [r.p for r in df.select(pct_round2("n", "d").alias("p")).collect()]
    assert got == [12.5, 33.33, 66.67, 0.5, 0.0, None, 0.0]


def test_percent_tie_is_half_up(spark):
    # 1/16 * 100 = 6.25 exactly -> 6.25; 1/32 * 100 = 3.125 -> 3.13 (a double round may give 3.12)
    df = spark.createDataFrame([(1, 32), (3, 32)], "n long, d long")
    got = [r.p for r in df.select(pct_round2("n", "d").alias("p")).collect()]
    assert got == [3.13, 9.38]


def test_avg_round1_and_cents(spark):
    df = spark.createDataFrame([(5, 2, 12345, 10), (7, 3, 5, 2), (0, 0, 1, 0)],
                               "s long, c long, cents long, d long")
    rows = df.select(avg_round1("s", "c").alias("a"),
                     cents_ratio_round2("cents", "d").alias("m")).collect()
    # 5/2 = 2.5; 7/3 = 2.33 -> 2.3; 123.45/10 = 12.345 -> 12.35; 0.05/2 = 0.025 -> 0.03
    assert [(r.a, r.m) for r in rows] == [(2.5, 12.35), (2.3, 0.03), (None, None)]


def test_ratio_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(3, 0), (3, 4)], "n long, d long")
    rows = df.select(ratio("n", "d").alias("r"), ratio_pct("n", "d").alias("p")).collect()
    assert [(r.r, r.p) for r in rows] == [(None, None), (0.75, 75.0)]


def test_ts_literal_is_midnight_ntz(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 25, 0, 0, 0),),
                                (dt.datetime(2024, 1, 25, 0, 0, 1),)], "t timestamp_ntz")
    n = df.where(F.col("t").between(ts("2024-01-01"), ts("2024-01-25"))).count()
    assert n == 1  # the upper date bound is that day's midnight


def test_scale_settings_for_100tb():
    from trailmark.session import scale_settings

    s = scale_settings(100 << 40, total_cores=8000)
    parts = int(s["spark.sql.shuffle.partitions"])
    assert parts % 8000 == 0 and parts >= (100 << 40) // (256 << 20)
    assert s["spark.sql.adaptive.enabled"] == "true"


def test_rounding_helpers_match_decimal_half_up(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from hypothesis import given, settings
    from hypothesis import strategies as st

    pairs = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.integers(0, 10**9), st.integers(1, 10**7))
    def collect(n, d):
        pairs.append((n, d))

    collect()
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", pct_round2("n", "d").alias("p"), avg_round1("n", "d").alias("a"),
                    cents_ratio_round2("n", "d").alias("c")).collect()
    q2, q1 = Decimal("0.01"), Decimal("0.1")
    for r in got:
        n, d = Decimal(r.n), Decimal(r.d)
        assert r.p == float((n * 100 / d).quantize(q2, rounding=ROUND_HALF_UP)), (r.n, r.d)
        assert r.a == float((n / d).quantize(q1, rounding=ROUND_HALF_UP)), (r.n, r.d)
        assert r.c == float((n / 100 / d).quantize(q2, rounding=ROUND_HALF_UP)), (r.n, r.d)
