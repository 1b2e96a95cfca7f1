"""The five commerce tables the analyses read, derived from the raw tables.

The analyses read ``website_sessions``, ``website_pageviews``, ``orders``, ``order_items`` and
``order_item_refunds``. The test data has none of them, so they are derived deterministically from
``events`` (clickstream) and ``orders`` + ``lineitem`` (store orders); the derivation rules are the
repository's own (see FIXTURES.md) and every derived table is a lazy DataFrame, so a query plans
from the raw parquet scans and its work grows with them.

Money is carried as long cents (``*_cents``). Columns follow the inferred schemas:

=================== =========================================================================
website_sessions    website_session_id, created_at, user_id, utm_source, utm_campaign,
                    http_referer, device_type
website_pageviews   website_pageview_id, created_at, website_session_id, pageview_url
web_orders          order_id, created_at, website_session_id, primary_product_id,
                    items_purchased, price_cents, cogs_cents
order_items         order_item_id, created_at, order_id, product_id, is_primary_item, price_cents
order_item_refunds  order_item_refund_id, order_item_id, order_id, created_at, refund_cents
store_orders        order_id, created_at, primary_product_id, items_purchased, price_cents,
                    cogs_cents
=================== =========================================================================

``web_orders`` is linked to sessions; ``store_orders`` (with items and refunds) carries the
multi-year product data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.sources.tables import read_table


def _session_key(user_id: Column, ts: Column) -> Column:
    return user_id * 1000 + F.dayofyear(ts)


def website_sessions(events: DataFrame) -> DataFrame:
    """One session per user and calendar day; source, campaign and device by fixed rules."""
    per_day = events.groupBy(
        F.col("user_id"), F.dayofyear("ts").alias("doy")
    ).agg(F.min("ts").alias("created_at"))
    k = (F.col("user_id") + F.col("doy")) % 5
    return per_day.select(
        (F.col("user_id") * 1000 + F.col("doy")).alias("website_session_id"),
        "created_at",
        "user_id",
        F.when(k.isin(0, 1), "gsearch").when(k == 2, "bsearch").alias("utm_source"),
        F.when(k > 2, F.lit(None))
        .when(F.col("user_id") % 3 == 0, "brand")
        .otherwise("nonbrand")
        .alias("utm_campaign"),
        F.when(k == 4, F.lit(None))
        .when(k == 2, "https://www.bsearch.com")
        .otherwise("https://www.gsearch.com")
        .alias("http_referer"),
        F.when(F.col("user_id") % 2 == 0, "desktop").otherwise("mobile").alias("device_type"),
    )


def website_pageviews(events: DataFrame) -> DataFrame:
    """Every event but each 97th is a pageview; the url follows event type and id parity."""
    eid = F.col("event_id")
    et = F.col("event_type")
    url = (
        F.when(et == "view", F.when(eid % 2 == 0, "/home").otherwise("/lander-1"))
        .when(et == "click",
              F.when(eid % 3 == 0, "/products")
              .when(eid % 3 == 1, "/the-original-mr-fuzzy")
              .otherwise("/the-forever-love-bear"))
        .when(et == "signup", F.when(eid % 2 == 0, "/cart").otherwise("/shipping"))
        .when(et == "error", F.when(eid % 2 == 0, "/billing").otherwise("/billing-2"))
        .otherwise("/thank-you-for-your-order")
    )
    return events.where(eid % 97 != 0).select(
        eid.alias("website_pageview_id"),
        F.col("ts").alias("created_at"),
        _session_key(F.col("user_id"), F.col("ts")).alias("website_session_id"),
        url.alias("pageview_url"),
    )


def web_orders(events: DataFrame) -> DataFrame:
    """Purchase events are the orders of the website sessions."""
    eid = F.col("event_id")
    return events.where(F.col("event_type") == "purchase").select(
        eid.alias("order_id"),
        F.col("ts").alias("created_at"),
        _session_key(F.col("user_id"), F.col("ts")).alias("website_session_id"),
        (eid % 4 + 1).alias("primary_product_id"),
        (eid % 3 + 1).alias("items_purchased"),
        F.round(F.col("value") * 100).cast("bigint").alias("price_cents"),
        F.round(F.col("value") * 60).cast("bigint").alias("cogs_cents"),
    )


def order_items(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One item per (order, line number); the lowest line number of an order is its primary item.

    Lines are aggregated first (partial aggregation collapses repeated (order, line) rows, even
    of an order holding a large share of lineitem). The order's first line is windowed over its
    few distinct lines, and not planned at all where ``is_primary_item`` is not used.
    """
    lines = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("min_part"), F.min("l_extendedprice").alias("min_price"))
    lines = lines.withColumn("first_line", F.min("l_linenumber").over(Window.partitionBy("l_orderkey")))
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    grouped = lines.join(o, "l_orderkey")
    return grouped.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("l_orderkey").alias("order_id"),
        (F.col("min_part") % 4 + 1).alias("product_id"),
        F.when(F.col("l_linenumber") == F.col("first_line"), 1).otherwise(0).alias("is_primary_item"),
        F.round(F.col("min_price") * 100).cast("bigint").alias("price_cents"),
    )


def order_item_refunds(lineitem: DataFrame) -> DataFrame:
    """Items whose (smallest) return flag is 'R' were refunded in full at ship date.

    ``min(flag) = 'R'`` is tested as "no flag below 'R' and some flag 'R'": two fixed-width
    counts, so the aggregate stays hash-based (a string minimum would force a sort aggregate).
    """
    flag = F.col("l_returnflag")
    g = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("created_at"),
        F.min("l_extendedprice").alias("min_price"),
        F.count(F.when(flag < "R", 1)).alias("below"),
        F.count(F.when(flag == "R", 1)).alias("at"),
    )
    item = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return g.where((F.col("below") == 0) & (F.col("at") > 0)).select(
        (item * 10 + 1).alias("order_item_refund_id"),
        item.alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        "created_at",
        F.round(F.col("min_price") * 100).cast("bigint").alias("refund_cents"),
    )


NO_PART = 1 << 40  # stands for a NULL part key, above every other


def store_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders with their primary product and item count, from one per-order aggregate of lineitem.

    Equal to joining ``order_items`` back (primary item, item count) but with a single partially
    aggregated pass: the primary item is the lowest line number and its product comes from that
    line's smallest part key, so the minimum of line and part packed into one long yields both (a
    fixed-width buffer, so the aggregate stays hash-based). Items are the distinct line numbers
    (a NULL line number would be one item too). Line numbers stay below 2**22, part keys below 2**40.
    """
    line = F.col("l_linenumber").cast("long")
    part = F.coalesce(F.col("l_partkey").cast("long"), F.lit(NO_PART))
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.min(line * (2 * NO_PART) + part).alias("first"),
        (F.count_distinct(line) + F.max(F.when(line.isNull(), 1).otherwise(0)))
        .alias("items_purchased"),
        F.count(line).alias("n_lines"),
    ).where(F.col("n_lines") > 0)  # a primary item exists; lets unused aggregates be pruned
    first_part = F.nullif(F.col("first") % (2 * NO_PART), F.lit(NO_PART))
    o = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_orderdate").alias("created_at"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price_cents"),
        F.round(F.col("o_totalprice") * 60).cast("bigint").alias("cogs_cents"),
    )
    return o.join(per_order, "l_orderkey").select(
        F.col("l_orderkey").alias("order_id"), "created_at",
        (first_part % 4 + 1).alias("primary_product_id"),
        F.col("items_purchased").cast("bigint").alias("items_purchased"),
        "price_cents", "cogs_cents",
    )


@dataclass
class CommerceData:
    """Lazily derived tables for one data directory; nothing is computed until an action."""

    spark: SparkSession
    base_dir: str

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.base_dir, name)

    @cached_property
    def sessions(self) -> DataFrame:
        return website_sessions(self.raw("events"))

    @cached_property
    def pageviews(self) -> DataFrame:
        return website_pageviews(self.raw("events"))

    @cached_property
    def orders(self) -> DataFrame:
        return web_orders(self.raw("events"))

    @cached_property
    def order_items(self) -> DataFrame:
        return order_items(self.raw("orders"), self.raw("lineitem"))

    @cached_property
    def refunds(self) -> DataFrame:
        return order_item_refunds(self.raw("lineitem"))

    @cached_property
    def store_orders(self) -> DataFrame:
        return store_orders(self.raw("orders"), self.raw("lineitem"))
