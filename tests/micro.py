"""Hand-written micro tables in the commerce schema (10-20 rows each)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

SESSIONS = ("website_session_id long, created_at timestamp_ntz, utm_source string, "
            "utm_campaign string, http_referer string, device_type string")
PAGEVIEWS = ("website_pageview_id long, created_at timestamp_ntz, website_session_id long, "
             "pageview_url string")
ORDERS = ("order_id long, created_at timestamp_ntz, website_session_id long, "
          "primary_product_id long, items_purchased long, price_cents long, cogs_cents long")
ITEMS = ("order_item_id long, created_at timestamp_ntz, order_id long, product_id long, "
         "is_primary_item int, price_cents long")
REFUNDS = ("order_item_refund_id long, order_item_id long, order_id long, "
           "created_at timestamp_ntz, refund_cents long")


def t(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def sessions(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(r[0], t(r[1]), *r[2:]) for r in rows], SESSIONS)


def pageviews(spark: SparkSession, rows) -> DataFrame:
    """rows: (pageview id, time, session id, url)."""
    return spark.createDataFrame([(r[0], t(r[1]), r[2], r[3]) for r in rows], PAGEVIEWS)


def orders(spark: SparkSession, rows) -> DataFrame:
    """rows: (order id, time, session id, product, items, price cents, cogs cents)."""
    return spark.createDataFrame([(r[0], t(r[1]), *r[2:]) for r in rows], ORDERS)


def items(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(r[0], t(r[1]), *r[2:]) for r in rows], ITEMS)


def refunds(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(r[0], r[1], r[2], t(r[3]), r[4]) for r in rows], REFUNDS)


def one(df: DataFrame) -> dict:
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def by(df: DataFrame, key: str) -> dict:
    return {r[key]: r.asDict() for r in df.collect()}
