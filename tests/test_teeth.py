"""Every filter of the registered analyses matters: taken away, the result changes; and counts stay
right where one session is very large."""

import pytest
from pyspark.sql import functions as F

from trailmark.functions import ts
from trailmark.operators import products as R
from trailmark.plans import q_experiments, q_funnels, q_pages, q_products, registry
from trailmark.sources import CommerceData

# analysis -> module and the window or bound that is widened
WINDOWS = [
    ("first_pageview_per_session_in_window", q_pages, {"DEMO_START": "1900-01-01", "DEMO_END": "2100-01-01"}),
    ("landing_page_in_window", q_pages, {"DEMO_START": "1900-01-01", "DEMO_END": "2100-01-01"}),
    ("bounced_sessions", q_pages, {"DEMO_START": "1900-01-01", "DEMO_END": "2100-01-01"}),
    ("bounce_rate_by_landing_page", q_pages, {"DEMO_START": "1900-01-01", "DEMO_END": "2100-01-01"}),
    ("landing_page", q_pages, {"LANDER_LAUNCH": "1900-01-01"}),
    ("landing_page_volume_by_landing", q_pages, {"LANDING_END": "2100-01-01"}),
    ("page_step_flags", q_funnels, {"DEMO_START": "1900-01-01", "DEMO_END": "2100-01-01"}),
    ("funnel_click_rates", q_funnels, {"DEMO_START": "1900-01-01", "DEMO_END": "2100-01-01"}),
    ("launch_trend", q_products, {"TREND_START": "1900-01-01", "TREND_END": "2100-01-01"}),
    ("billing_test_rows", q_experiments, {"BILLING_LAUNCH": "1900-01-01"}),
    ("billing_test_flags_by_page", q_experiments, {"BILLING_LAUNCH": "1900-01-01"}),
]


@pytest.fixture(scope="module")
def data(spark, small_dir):
    return CommerceData(spark, small_dir.replace("sf0.001", "sf0.01"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("key,module,wider", WINDOWS, ids=[w[0] for w in WINDOWS])
def test_window_rejects_rows(data, monkeypatch, key, module, wider):
    build = registry.REGISTRY[key].build
    before = rows(build(data))
    for name, value in wider.items():
        monkeypatch.setattr(module, name, value)
    assert rows(build(data)) != before


def test_incremental_orders_count_something(data):
    (row,) = registry.REGISTRY["incremental_orders"].build(data).collect()
    assert row.session_since_test > 0 and row.incremental_orders > 0


def test_one_session_with_millions_of_carts(spark):
    carts, orders = 3_000_000, 300
    when = F.lit("2024-01-10").cast("timestamp_ntz")
    pageviews = spark.range(carts).select(
        F.col("id").alias("website_pageview_id"), F.lit(1).cast("long").alias("website_session_id"), when.alias("created_at"), F.lit("/cart").alias("pageview_url"))
    web = spark.range(orders).select(
        F.col("id").alias("order_id"), F.lit(1).cast("long").alias("website_session_id"), when.alias("created_at"),
        F.lit(1).cast("long").alias("primary_product_id"), F.lit(1).cast("long").alias("items_purchased"),
        F.lit(5999).cast("long").alias("price_cents"), F.lit(0).cast("long").alias("cogs_cents"))
    (r,) = R.cart_cross_sell_performance(pageviews, web, F.lit(True), ts("2024-01-15")).collect()
    assert (r.cart_sessions, r.orders_placed) == (1, carts * carts * orders)
    assert r.revenue == pytest.approx(carts * carts * orders * 59.99)
    assert r.aov == pytest.approx(59.99)
