"""Traffic, channels and seasonality.

Each analysis groups sessions by a calendar bucket. Sessions are joined to *per-session* order
facts (``common.sessions_with_orders``), so distinct counts over the session ⟕ order join become
plain counts and sums at session grain: one partial + final aggregate, no ``Expand`` for the
several ``COUNT(DISTINCT CASE ...)`` columns, and no row of a hot session leaves its map task
un-aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import fixed_values as FV
from trailmark.functions import avg_round1, month_name, pct_round2, week0, weekday0
from trailmark.operators.common import (
    SESSION,
    apply_filter,
    period_keys,
    sessions_with_orders,
)

SESSION_COLS = ["website_session_id", "created_at", "utm_source", "utm_campaign", "http_referer",
                "device_type"]


def session_order_join(sessions: DataFrame, orders: DataFrame,
                       where: Column | None = None) -> DataFrame:
    """Sessions ⟕ orders on the session id, one row per (session, order) or per session."""
    o = orders.select(
        SESSION,
        "order_id",
        F.col("created_at").alias("order_created_at"),
        "primary_product_id",
        "items_purchased",
        "price_cents",
        "cogs_cents",
    )
    # the session id is the key; with the same condition on both branches they share an exchange
    known = F.col(SESSION).isNotNull()
    o = o.where(known)
    s = apply_filter(sessions.select(*SESSION_COLS), where).where(known)
    # left join = matched rows ∪ sessions without orders. The inner part can be split by adaptive
    # execution on either side when one session holds very many orders; the anti part meets one
    # pre-deduplicated id per session.
    matched = s.join(o, SESSION, "inner")
    with_orders = o.select(SESSION).distinct()
    unmatched = s.join(with_orders, SESSION, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def _bucketed(sessions: DataFrame, orders: DataFrame | None, where: Column | None, grain: str,
              include_year: bool) -> tuple[DataFrame, list[Column]]:
    s = apply_filter(sessions, where)
    if orders is not None:
        s = sessions_with_orders(s, orders)
    return s, period_keys(F.col("created_at"), grain, include_year)


def _finish(df: DataFrame) -> DataFrame:
    return df.drop("_period", "_year")


def period_trend(sessions: DataFrame, orders: DataFrame, where: Column | None = None,
                 grain: str = "month", include_year: bool = False) -> DataFrame:
    """Per bucket, first present date, sessions and orders."""
    s, keys = _bucketed(sessions, orders, where, grain, include_year)
    out = s.groupBy(*keys).agg(
        F.min(F.to_date("created_at")).alias("period_start"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("n_orders").cast("bigint").alias("orders"),
    )
    return _finish(out)


def segment_pivot_trend(sessions: DataFrame, orders: DataFrame | None, segment: str,
                        values: Sequence[str], where: Column | None = None,
                        grain: str = "month", include_year: bool = False) -> DataFrame:
    """The trend with one (sessions[, orders]) column pair per listed segment value.

    ``orders=None`` gives sessions only (the weekly device form). Values are listed, as in a
    ``pivot`` with explicit values, so no job runs to discover them.
    """
    s, keys = _bucketed(sessions, orders, where, grain, include_year)
    seg = F.col(segment)
    aggs = [F.min(F.to_date("created_at")).alias("period_start")]
    for v in values:
        aggs.append(F.count(F.when(seg == v, 1)).alias(f"{v}_sessions"))
        if orders is not None:
            aggs.append(F.sum(F.when(seg == v, F.col("n_orders")).otherwise(0)).cast("bigint")
                        .alias(f"{v}_orders"))
    return _finish(s.groupBy(*keys).agg(*aggs))


def traffic_source_inventory(sessions: DataFrame, where: Column | None = None) -> DataFrame:
    """The distinct (utm_source, utm_campaign, http_referer) combinations."""
    return apply_filter(sessions, where).select("utm_source", "utm_campaign",
                                                "http_referer").distinct()


def channel_mix_trend(sessions: DataFrame, where: Column | None = None, grain: str = "month",
                      paid_sources: Sequence[str] = (FV.GSEARCH, FV.BSEARCH),
                      include_year: bool = False) -> DataFrame:
    """Per bucket, sessions per paid source, organic (no source, a referer) and direct.

    The original's left join to orders contributes no column and cannot change a distinct count,
    so it is not planned at all.
    """
    s, keys = _bucketed(sessions, None, where, grain, include_year)
    src, ref = F.col("utm_source"), F.col("http_referer")
    aggs = [F.min(F.to_date("created_at")).alias("period_start")]
    aggs += [F.count(F.when(src == v, 1)).alias(f"{v}_paid_sessions") for v in paid_sources]
    aggs += [
        F.count(F.when(src.isNull() & ref.isNotNull(), 1)).alias("organic_search_sessions"),
        F.count(F.when(src.isNull() & ref.isNull(), 1)).alias("direct_search_sessions"),
    ]
    return _finish(s.groupBy(*keys).agg(*aggs))


def conversion_rate_trend(sessions: DataFrame, orders: DataFrame, where: Column | None = None,
                          grain: str = "month", include_year: bool = False) -> DataFrame:
    """Per bucket, sessions, orders and the conversion percentage rounded to 2 places."""
    t = period_trend(sessions, orders, where, grain, include_year)
    return t.withColumn("conv_rate", pct_round2("orders", "sessions"))


def calendar_features(sessions: DataFrame, where: Column | None = None) -> DataFrame:
    """Per session, hour, weekday (Mon = 0) and its label, quarter, month, date, week-0.

    The original groups by (quarter, session, created_at); the session id is a key, so every group
    is one session and the statement is a projection (``qtr_date`` is the session's date).
    """
    c = F.col("created_at")
    wd = weekday0(c)
    return apply_filter(sessions, where).select(
        SESSION,
        "created_at",
        F.hour(c).cast("bigint").alias("hr"),
        wd.alias("wkday"),
        F.when(wd == 0, FV.MONDAY_LABEL).when(wd == 1, FV.TUESDAY_LABEL)
        .otherwise(FV.OTHER_DAY_LABEL).alias("clean_weekday"),
        F.quarter(c).cast("bigint").alias("qtr"),
        F.to_date(c).alias("qtr_date"),
        F.month(c).cast("bigint").alias("month"),
        F.to_date(c).alias("date"),
        week0(c).alias("wk"),
    )


def volume_with_month_total(sessions: DataFrame, orders: DataFrame,
                            where: Column | None = None) -> DataFrame:
    """Per (year, month, week), sessions, orders and first date, plus month totals.

    The month totals are windowed sums over the already-aggregated rows (at most 54 per month and
    year), partitioned by month only, so different years of one month share a total as in the
    original. Sorted by year, month, month total; the year is sorted on, then dropped.
    """
    s = sessions_with_orders(apply_filter(sessions, where), orders)
    c = F.col("created_at")
    grouped = s.groupBy(
        F.year(c).alias("_year"),
        F.month(c).cast("bigint").alias("month"),
        month_name(c).alias("month_name"),
        week0(c).alias("wk"),
    ).agg(
        F.min(F.to_date(c)).alias("week_start"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("n_orders").cast("bigint").alias("orders"),
    )
    by_month = Window.partitionBy("month")
    with_totals = grouped.withColumns({
        "total_month_sessions": F.sum("sessions").over(by_month).cast("bigint"),
        "total_month_orders": F.sum("orders").over(by_month).cast("bigint"),
    })
    return with_totals.orderBy("_year", "month", "total_month_sessions").select(
        "month", "month_name", "total_month_sessions", "total_month_orders", "wk",
        "week_start", "sessions", "orders",
    )


def hourly_sessions_by_day(sessions: DataFrame, where: Column | None = None) -> DataFrame:
    """W09 inner: sessions per (date, weekday, hour)."""
    c = F.col("created_at")
    return apply_filter(sessions, where).groupBy(
        F.to_date(c).alias("created_date"),
        weekday0(c).alias("wkday"),
        F.hour(c).cast("bigint").alias("hr"),
    ).agg(F.count(F.lit(1)).alias("sessions"))


WEEKDAY_COLUMNS = ("mon", "tues", "wed", "thurs", "fri", "sat", "sun")


def hour_weekday_heatmap(sessions: DataFrame, where: Column | None = None) -> DataFrame:
    """Per hour, the mean daily sessions for each weekday, rounded to 1 place.

    Days without a session in that hour have no inner row, so they are not in the mean.
    """
    inner = hourly_sessions_by_day(sessions, where)
    wd = F.col("wkday")
    aggs = []
    for k, name in enumerate(WEEKDAY_COLUMNS):
        total = F.sum(F.when(wd == k, F.col("sessions")))
        days = F.count(F.when(wd == k, 1))
        aggs.append(avg_round1(F.coalesce(total, F.lit(0)), days).alias(name))
    return inner.groupBy("hr").agg(*aggs)


__all__ = [
    "calendar_features",
    "channel_mix_trend",
    "conversion_rate_trend",
    "hour_weekday_heatmap",
    "hourly_sessions_by_day",
    "period_trend",
    "segment_pivot_trend",
    "session_order_join",
    "traffic_source_inventory",
    "volume_with_month_total",
]
