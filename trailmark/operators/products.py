"""Products, cross-sell and refunds.

Distinct-count pivots (up to eight ``COUNT(DISTINCT CASE ...)`` in one statement) would make Spark
copy every row once per distinct expression (``Expand``). Here each is reduced to the grain of its
key first (order, item, or (period, session)) with partial aggregation, and the report sums 0/1
flags over that grain: one aggregate, no ``Expand``, and a hot key is collapsed map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import fixed_values as FV
from trailmark.functions import big, dollars, month_name, pct_round2, ratio
from trailmark.operators.common import (
    SESSION,
    apply_filter,
    money_ratio,
    orders_per_session,
    sessions_with_orders,
)
from trailmark.operators.funnels import period_label

PV = "website_pageview_id"
URL = "pageview_url"


# ---- W35 / W36 ----------------------------------------------------------------------------------

def _sales_aggs() -> list[Column]:
    return [
        F.count("order_id").alias("orders"),
        F.sum("price_cents").alias("_cents"),
        F.sum(F.col("price_cents") - F.col("cogs_cents")).alias("_margin"),
        F.count("price_cents").alias("_priced"),
    ]


def product_sales_summary(orders: DataFrame, where: Column | None = None) -> DataFrame:
    """W35 global: orders, revenue, margin and average order value."""
    g = apply_filter(orders, where).agg(*_sales_aggs())
    return g.select("orders", dollars("_cents").alias("revenue"),
                    dollars("_margin").alias("margin"),
                    money_ratio("_cents", "_priced").alias("avg_order_value"))


def product_sales_by_product(orders: DataFrame, where: Column | None = None) -> DataFrame:
    """W35 per primary product, most orders first."""
    g = apply_filter(orders, where).groupBy("primary_product_id").agg(*_sales_aggs())
    return g.select("primary_product_id", "orders", dollars("_cents").alias("revenue"),
                    dollars("_margin").alias("margin"),
                    money_ratio("_cents", "_priced").alias("aov")).orderBy(F.desc("orders"))


def monthly_sales_margin(orders: DataFrame, where: Column | None = None) -> DataFrame:
    """Per (year, month), number of sales, revenue and margin."""
    c = F.col("created_at")
    g = apply_filter(orders, where).groupBy(
        F.year(c).cast("bigint").alias("yr"), F.month(c).cast("bigint").alias("month")
    ).agg(*_sales_aggs())
    return g.select("yr", "month", F.col("orders").alias("number_of_sales"),
                    dollars("_cents").alias("revenue"), dollars("_margin").alias("margin"))


# ---- W37 ----------------------------------------------------------------------------------------

def launch_trend(sessions: DataFrame, orders: DataFrame, where: Column | None = None,
                 products: Sequence[int] = (1, 2),
                 product_names: Sequence[str] = ("product_one_orders",
                                                 "product_two_orders")) -> DataFrame:
    """Per (year, month) of the session: orders, conversion rate, revenue per session and
    orders per listed primary product."""
    s = sessions_with_orders(apply_filter(sessions, where), orders, products)
    c = F.col("created_at")
    g = s.groupBy(F.year(c).cast("bigint").alias("yr"),
                  F.month(c).cast("bigint").alias("month")).agg(
        F.count(F.lit(1)).alias("_sessions"),
        F.sum("n_orders").cast("bigint").alias("orders"),
        F.sum("revenue_cents").alias("_cents"),
        *[F.sum(f"n_p{k}").cast("bigint").alias(name) for k, name in zip(products, product_names)],
    )
    return g.select("yr", "month", "orders",
                    ratio("orders", "_sessions").alias("conv_rate"),
                    money_ratio("_cents", "_sessions").alias("revenue_per_session2"),
                    *product_names)


# ---- W38 ----------------------------------------------------------------------------------------

def cross_sell_matrix(orders: DataFrame, items: DataFrame, where: Column | None = None,
                      products: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Per primary product, orders, and per product k the orders that also hold k as a
    non-primary item, with its share (%, 2 places).

    The original joins items with ``is_primary_item = 0`` inside the ``ON`` of a left join (it
    must not become a ``WHERE``: orders without cross-sell items stay). Items are reduced to one
    row of 0/1 flags per order before the join.
    """
    cross = items.where((F.col("is_primary_item") == 0) & F.col("product_id").isin(list(products)))
    per_order = cross.groupBy("order_id").agg(*[
        F.max(F.when(F.col("product_id") == k, 1).otherwise(0)).alias(f"_x{k}")
        for k in products])
    o = apply_filter(orders, where).select("order_id", "primary_product_id")
    j = o.join(per_order, "order_id", "left")
    g = j.groupBy("primary_product_id").agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.count(F.when(F.col(f"_x{k}") == 1, 1)).alias(f"x_sell_prod{k}") for k in products])
    cols: list[Column | str] = ["primary_product_id", "orders"]
    for k in products:
        cols += [f"x_sell_prod{k}", pct_round2(f"x_sell_prod{k}", "orders")
                 .alias(f"x_sell_prod{k}_rt")]
    return g.select(*cols)


# ---- W39 ----------------------------------------------------------------------------------------

CART_LABELS = (FV.PRE_CROSS_SELL, FV.POST_CROSS_SELL, FV.PERIOD_SENTINEL)


def _cart_session_facts(pageviews: DataFrame, orders: DataFrame, where: Column | None,
                        cut: Column, cart_url: str, labels: tuple[str, str, str]) -> DataFrame:
    """Per (time_period, cart session): cart views c, clicked (a pageview after the first cart
    view of the period), over all periods of the session all_c cart views and k periods clicked, and
    the session's order facts.

    One aggregate of ids and counts per session; a session then gives a row per period with a cart
    view. Cart views without a session id keep their row, with no click and no order.
    """
    cart = F.col(URL) == cart_url
    if where is not None:
        cart = cart & where
    period = period_label(F.col("created_at"), cut, *labels)
    aggs = [F.max(PV).alias("last_pv")]
    for i, label in enumerate(labels):
        here = cart & (period == label)
        aggs += [F.count(F.when(here, 1)).alias(f"_c{i}"), F.min(F.when(here, F.col(PV))).alias(f"_f{i}")]
    per_session = pageviews.groupBy(SESSION).agg(*aggs)
    index = range(len(labels))
    clicked = [F.when(F.col(SESSION).isNotNull() & (F.col("last_pv") > F.col(f"_f{i}")), 1).otherwise(0)
               for i in index]
    per_session = per_session.select(
        SESSION, sum((F.col(f"_c{i}") for i in index[1:]), F.col("_c0")).alias("all_c"),
        sum(clicked[1:], clicked[0]).alias("k"),
        F.explode(F.array(*[F.struct(F.lit(label).alias("time_period"), F.col(f"_c{i}").alias("c"),
                                     clicked[i].alias("clicked")) for i, label in enumerate(labels)])).alias("p"))
    rows = per_session.select(SESSION, "all_c", "k", "p.*").where("c > 0")
    return rows.join(orders_per_session(orders), SESSION, "left").withColumns({
        "n_orders": F.coalesce("n_orders", F.lit(0)),
        "n_priced": F.coalesce("n_priced", F.lit(0)),
    })


def _cart_report(rows: DataFrame, clicks: Column, placed: Column, items: Column, cents: Column,
                 priced: Column) -> DataFrame:
    g = rows.groupBy("time_period").agg(
        F.count(SESSION).alias("cart_sessions"),
        F.sum(clicks).cast("bigint").alias("clickthroughs"),
        F.sum(placed).cast("bigint").alias("orders_placed"),
        F.sum(items).cast("bigint").alias("products_purchased"),
        F.sum(cents).alias("_cents"),
        F.sum(priced).alias("_priced"),
    )
    return g.select(
        "time_period", "cart_sessions", "clickthroughs",
        ratio("clickthroughs", "cart_sessions").alias("cart_ctr"),
        "orders_placed", "products_purchased",
        ratio("products_purchased", "orders_placed").alias("products_per_order"),
        dollars("_cents").alias("revenue"),
        money_ratio("_cents", "orders_placed").alias("aov"),
        money_ratio("_cents", "_priced").alias("aov2"),
        money_ratio("_cents", "cart_sessions").alias("rev_per_cart_session"),
    )


def cart_cross_sell_performance(pageviews: DataFrame, orders: DataFrame, where: Column | None,
                                cut: Column, cart_url: str = FV.CART,
                                labels: tuple[str, str, str] = CART_LABELS) -> DataFrame:
    """W39 as written: per period, cart sessions, click-throughs, CTR, orders, items, items per
    order, revenue, AOV two ways and revenue per cart session.

    The original joins one row per cart pageview to the clicked-sessions table (one row per period
    the session clicked in) and to cart-pageview x order rows, all on the session id only, then
    sums. Per (period p, session s) with c_p cart views, C = sum of c_p over periods, k = periods
    clicked, n orders carrying items I and revenue R, that yields
    clicks c_p*k*max(1, C*n), orders c_p*max(1,k)*C*n, items c_p*max(1,k)*C*I and revenue
    c_p*max(1,k)*C*R. Those weights are computed from the per-session counts; nothing is
    multiplied out.
    """
    f = _cart_session_facts(pageviews, orders, where, cut, cart_url, labels)
    c, k, n = (big(F.col(x)) for x in ("c", "k", "n_orders"))
    base = c * F.greatest(k, big(F.lit(1))) * big(F.col("all_c"))
    clicks = c * k * F.greatest(big(F.col("all_c")) * n, big(F.lit(1)))
    return _cart_report(f, clicks, base * n, base * big(F.col("items")),
                        base * big(F.col("revenue_cents")), base * big(F.col("n_priced")))


def cart_cross_sell_session_grain(pageviews: DataFrame, orders: DataFrame, where: Column | None,
                                  cut: Column, cart_url: str = FV.CART,
                                  labels: tuple[str, str, str] = CART_LABELS) -> DataFrame:
    """W39 at (period, session) grain: each cart session counted once per period, with its own
    clicked flag and its orders, items and revenue once."""
    f = _cart_session_facts(pageviews, orders, where, cut, cart_url, labels)
    return _cart_report(f, F.col("clicked"), F.col("n_orders"), F.col("items"),
                        F.col("revenue_cents"), F.col("n_priced"))


# ---- W40 ----------------------------------------------------------------------------------------

def page_to_order_rate(pageviews: DataFrame, orders: DataFrame, where: Column | None,
                       urls: Sequence[str]) -> DataFrame:
    """Per product page, distinct sessions, distinct orders and orders per session."""
    seen = apply_filter(pageviews, where).where(F.col(URL).isin(list(urls))).select(
        URL, SESSION).distinct()
    j = seen.join(orders_per_session(orders).select(SESSION, "n_orders"), SESSION, "left")
    g = j.groupBy(URL).agg(F.count(SESSION).alias("sessions"),
                           F.coalesce(F.sum("n_orders"), F.lit(0)).cast("bigint").alias("orders"))
    return g.withColumn("viewed_product_to_order_rate", ratio("orders", "sessions"))


# ---- W41 / W42 ----------------------------------------------------------------------------------

def item_refund_lookup(items: DataFrame, refunds: DataFrame,
                       order_ids: Sequence[int] | None = None) -> DataFrame:
    """Item rows with their refund columns (NULL when not refunded); all orders, or the
    listed ``order_ids``."""
    i = items if order_ids is None else items.where(F.col("order_id").isin(list(order_ids)))
    r = refunds.select("order_item_id", "order_item_refund_id",
                       F.col("refund_cents"), F.col("created_at").alias("refund_date"))
    j = i.join(r, "order_item_id", "left")
    return j.select("order_id", "order_item_id", dollars("price_cents").alias("price_paid_usd"),
                    F.col("created_at").alias("order_date"), "order_item_refund_id",
                    dollars("refund_cents").alias("refund_amount_usd"), "refund_date")


def _items_with_refund_counts(items: DataFrame, refunds: DataFrame) -> DataFrame:
    per_item = refunds.groupBy("order_item_id").agg(F.count("order_item_refund_id").alias("n_ref"))
    return items.join(per_item, "order_item_id", "left").withColumn(
        "n_ref", F.coalesce("n_ref", F.lit(0)))


def refund_rates(items: DataFrame, refunds: DataFrame, where: Column | None = None) -> DataFrame:
    """W42 monthly: orders with items, refunds, refunds per order; two aggregation levels
    (order, then month) instead of two distinct counts."""
    j = _items_with_refund_counts(apply_filter(items, where), refunds)
    c = F.col("created_at")
    per_order = j.groupBy(F.year(c).cast("bigint").alias("yr"),
                          F.month(c).cast("bigint").alias("month"), "order_id").agg(
        F.sum("n_ref").alias("n_ref"))
    g = per_order.groupBy("yr", "month").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("n_ref").cast("bigint").alias("total_refunds"))
    return g.withColumn("refund_conv_rt", ratio("total_refunds", "total_orders"))


def product_refund_rates(items: DataFrame, refunds: DataFrame, where: Column | None = None,
                         products: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """W42 pivot: per (year, month, month name), items sold and % refunded for each product.

    Item ids are keys, so each distinct count is a count of flagged items at item grain.
    """
    j = _items_with_refund_counts(apply_filter(items, where), refunds)
    c = F.col("created_at")
    pid, refunded = F.col("product_id"), F.col("n_ref") > 0
    aggs = []
    for k in products:
        aggs += [F.count(F.when(pid == k, 1)).alias(f"p{k}_orders"),
                 F.count(F.when((pid == k) & refunded, 1)).alias(f"_r{k}")]
    g = j.groupBy(F.year(c).cast("bigint").alias("yr"),
                  F.month(c).cast("bigint").alias("month_num"),
                  month_name(c).alias("month")).agg(*aggs)
    cols: list[Column | str] = ["yr", "month_num", "month"]
    for k in products:
        cols += [f"p{k}_orders", pct_round2(f"_r{k}", f"p{k}_orders").alias(f"p{k}_refund_rt")]
    return g.select(*cols)
