"""Properties that must hold on any data, checked on the test data."""

import pytest
from pyspark.sql import functions as F

from trailmark import fixed_values as FV
from trailmark.operators import traffic as T
from trailmark.plans import q_experiments, q_funnels, q_pages, q_products, q_traffic
from trailmark.sources import CommerceData


@pytest.fixture(scope="module")
def d(spark, small_dir):
    return CommerceData(spark, "/root/testdata/sf0.01")


def test_channel_columns_sum_to_sessions(d):
    mix = T.channel_mix_trend(d.sessions, grain="week").collect()
    totals = T.period_trend(d.sessions, d.orders, grain="week").collect()
    by_start = {r.period_start: r.sessions for r in totals}
    for r in mix:
        parts = (r.gsearch_paid_sessions + r.bsearch_paid_sessions + r.organic_search_sessions
                 + r.direct_search_sessions)
        assert parts == by_start[r.period_start]


def test_pivot_columns_sum_to_unpivoted_total(d):
    pivot = q_traffic.segment_pivot_trend_campaign(d).collect()
    total = q_traffic.period_trend(d).collect()
    assert len(pivot) == len(total) == 1
    p, t = pivot[0], total[0]
    assert p.brand_sessions + p.nonbrand_sessions == t.sessions
    assert p.brand_orders + p.nonbrand_orders == t.orders


def test_funnel_steps_never_exceed_sessions(d):
    row = q_funnels.funnel_counts(d).collect()[0]
    for c in q_funnels.FLAGS2_COUNTS:
        assert 0 <= row[c] <= row.sessions
    for r in q_funnels.multi_entry_funnel(d).collect():
        assert max(r.to_cart, r.to_shipping, r.to_billing, r.to_thankyou) <= r.sessions


def test_bounces_never_exceed_sessions(d):
    for r in q_pages.bounce_rate_by_landing_page(d).collect():
        assert 0 <= r.bounced_sessions <= r.total_sessions
        assert 0.0 <= r.bounce_rt <= 100.0
    overall = q_pages.bounce_rate(d).collect()[0]
    assert overall.bounced_sessions <= overall.total_sessions


def test_sentinel_labels_are_never_used(d):
    labels = {r.product_seen for r in q_funnels.multi_entry_flags(d).collect()}
    assert FV.PRODUCT_SENTINEL not in labels
    periods = {r.time_period for r in q_funnels.next_page_rows(d).collect()}
    periods |= {r.time_period for r in q_products.cart_cross_sell_performance(d).collect()}
    periods |= {r.time_period for r in q_experiments.pre_post_comparison(d).collect()}
    assert not periods & {FV.PRODUCT_SENTINEL, FV.PERIOD_SENTINEL}


def test_average_order_value_two_ways(d):
    for r in q_experiments.pre_post_comparison(d).collect():
        assert r.avg_order_value == r.aov
    for r in q_products.cart_cross_sell_session_grain(d).collect():
        assert r.aov == r.aov2


def test_session_grain_never_exceeds_fan_out(d):
    faithful = {r.billing_version_seen: r.revenue_per_billing_page_seen
                for r in q_experiments.revenue_per_page_session(d).collect()}
    grain = {r.billing_version_seen: r.revenue_per_billing_page_seen
             for r in q_experiments.revenue_per_page_session_grain(d).collect()}
    assert faithful.keys() == grain.keys()
    for k in faithful:
        assert grain[k] <= faithful[k]


def test_landing_pages_are_first_pageviews(d):
    lp = q_pages.landing_page_in_window(d)
    first = d.pageviews.groupBy("website_session_id").agg(F.min("website_pageview_id").alias("m"))
    joined = (first.join(d.pageviews, first.m == d.pageviews.website_pageview_id)
              .select(first.website_session_id, F.col("pageview_url").alias("landing_page")))
    assert lp.exceptAll(joined.join(lp.select("website_session_id"), "website_session_id")
                        .select("website_session_id", "landing_page")).count() == 0
