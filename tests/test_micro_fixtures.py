"""Edge cases on hand-written tables, with expected values worked out by hand."""

from pyspark.sql import functions as F

from tests import micro as M
from trailmark import fixed_values as FV
from trailmark.functions import ts
from trailmark.operators import experiments as X
from trailmark.operators import funnels as U
from trailmark.operators import pages as P
from trailmark.operators import products as R
from trailmark.operators import traffic as T

S_ROWS = [
    (1, "2024-01-02 10:00:00", "gsearch", "nonbrand", "https://www.gsearch.com", "desktop"),
    (2, "2024-01-02 11:00:00", None, None, "https://www.gsearch.com", "mobile"),  # organic
    (3, "2024-01-03 11:00:00", None, None, None, "mobile"),  # direct
    (4, "2024-01-03 12:00:00", "bsearch", "brand", "https://www.bsearch.com", "desktop"),
    (5, "2024-01-09 00:00:00", None, None, None, "desktop"),  # direct, next week
]


def test_channels_with_null_source_and_referer(spark):
    s = M.sessions(spark, S_ROWS)
    row = M.one(T.channel_mix_trend(s))
    assert row == {"period_start": row["period_start"], "gsearch_paid_sessions": 1,
                   "bsearch_paid_sessions": 1, "organic_search_sessions": 1,
                   "direct_search_sessions": 2}
    inv = {tuple(r) for r in T.traffic_source_inventory(s).collect()}
    assert (None, None, None) in inv and (None, None, "https://www.gsearch.com") in inv
    assert len(inv) == 4
    weekly = T.channel_mix_trend(s, grain="week").collect()
    assert sorted(r.direct_search_sessions for r in weekly) == [1, 1]


def test_bounce_counts_sessions_without_pageviews(spark):
    s = M.sessions(spark, S_ROWS[:4])
    pv = M.pageviews(spark, [
        (10, "2024-01-02 10:00:01", 1, "/home"),                 # s1 bounces
        (11, "2024-01-02 11:00:01", 2, "/home"),
        (12, "2024-01-02 11:01:00", 2, "/products"),
        (13, "2024-01-02 11:02:00", 2, "/cart"),
        (14, "2024-01-03 12:00:01", 4, "/lander-1"),             # s4 bounces; s3 has none
    ])
    landing = P.first_pageview_of_sessions(s, pv)
    assert M.one(P.bounce_rate(landing, pv)) == {"total_sessions": 4, "bounced_sessions": 2,
                                                 "bounce_rt": 50.0}
    per = M.by(P.bounce_rate_by_landing_page(P.landing_page(pv, s), pv), "landing_page")
    assert per["/home"]["total_sessions"] == 2 and per["/home"]["bounce_rt"] == 50.0
    assert per["/lander-1"]["bounce_rt"] == 100.0
    bounced = {r.website_session_id for r in P.bounced_sessions(P.landing_page(pv), pv).collect()}
    assert bounced == {1, 4}


def test_two_orders_in_one_session(spark):
    s = M.sessions(spark, S_ROWS[:2])
    o = M.orders(spark, [
        (100, "2024-01-02 10:05:00", 1, 1, 1, 1000, 600),
        (101, "2024-01-02 10:09:00", 1, 2, 2, 2000, 1200),
        (102, "2024-01-02 11:30:00", 2, 1, 1, 1500, 900),
    ])
    row = M.one(T.conversion_rate_trend(s, o))
    assert (row["sessions"], row["orders"], row["conv_rate"]) == (2, 3, 150.0)
    # revenue fan-out: two billing views x two orders of session 1
    pv = M.pageviews(spark, [
        (10, "2024-01-12 10:00:00", 1, "/billing"),
        (11, "2024-01-12 10:01:00", 1, "/billing"),
        (12, "2024-01-12 11:00:00", 2, "/billing-2"),
    ])
    faithful = M.by(X.revenue_per_page_session(pv, o, None, [FV.BILLING, FV.BILLING_2]),
                    "billing_version_seen")
    grain = M.by(X.revenue_per_page_session(pv, o, None, [FV.BILLING, FV.BILLING_2], True),
                 "billing_version_seen")
    assert faithful["/billing"]["revenue_per_billing_page_seen"] == 60.0  # 2 x (10 + 20)
    assert grain["/billing"]["revenue_per_billing_page_seen"] == 30.0
    assert faithful["/billing-2"]["revenue_per_billing_page_seen"] == 15.0


def test_pre_post_with_a_period_without_orders(spark):
    s = M.sessions(spark, S_ROWS)
    o = M.orders(spark, [(100, "2024-01-02 10:05:00", 1, 1, 3, 1001, 600)])
    got = M.by(X.pre_post_comparison(s, o, None, ts("2024-01-05")), "time_period")
    pre, post = got[FV.PRE_BIRTHDAY_BEAR], got[FV.POST_BIRTHDAY_BEAR]
    assert (pre["sessions"], pre["orders"], pre["conv_rt"]) == (4, 1, 25.0)
    assert pre["total_revenue"] == 10.01 and pre["avg_order_value"] == pre["aov"] == 10.01
    assert pre["total_products_sold"] == 3 and pre["products_per_order"] == 3.0
    assert (post["sessions"], post["orders"], post["conv_rt"]) == (1, 0, 0.0)
    assert post["total_revenue"] is None and post["total_products_sold"] is None
    assert post["avg_order_value"] is None


def test_two_cart_views_fan_out(spark):
    pv = M.pageviews(spark, [
        (10, "2024-01-06 10:00:00", 1, "/cart"),
        (11, "2024-01-06 10:01:00", 1, "/cart"),
        (12, "2024-01-06 10:02:00", 1, "/shipping"),
        (20, "2024-01-20 10:00:00", 2, "/cart"),     # post period, last page: no click
    ])
    o = M.orders(spark, [(100, "2024-01-06 10:05:00", 1, 1, 2, 5000, 3000)])
    where = F.col("created_at").between(ts("2024-01-05"), ts("2024-01-25"))
    f = M.by(R.cart_cross_sell_performance(pv, o, where, ts("2024-01-15")), "time_period")
    pre = f[FV.PRE_CROSS_SELL]
    assert (pre["cart_sessions"], pre["clickthroughs"], pre["orders_placed"],
            pre["products_purchased"], pre["revenue"]) == (1, 4, 4, 8, 200.0)
    assert pre["aov"] == pre["aov2"] == 50.0 and pre["rev_per_cart_session"] == 200.0
    post = f[FV.POST_CROSS_SELL]
    assert (post["cart_sessions"], post["clickthroughs"], post["orders_placed"]) == (1, 0, 0)
    assert post["revenue"] is None and post["aov"] is None
    g = M.by(R.cart_cross_sell_session_grain(pv, o, where, ts("2024-01-15")), "time_period")
    pre = g[FV.PRE_CROSS_SELL]
    assert (pre["cart_sessions"], pre["clickthroughs"], pre["orders_placed"],
            pre["products_purchased"], pre["revenue"]) == (1, 1, 1, 2, 50.0)


def test_both_billing_pages_in_one_session(spark):
    s = M.sessions(spark, S_ROWS[:2])
    pv = M.pageviews(spark, [
        (10, "2024-01-02 10:01:00", 1, "/billing"),
        (11, "2024-01-02 10:02:00", 1, "/billing-2"),
        (12, "2024-01-02 10:03:00", 1, "/thank-you-for-your-order"),
        (20, "2024-01-02 11:01:00", 2, "/billing"),
    ])
    o = M.orders(spark, [(100, "2024-01-02 10:03:00", 1, 1, 1, 1000, 600),
                         (101, "2024-01-02 10:04:00", 1, 1, 1, 1000, 600)])
    conv = M.by(X.billing_test_conversion(pv, o, None, None, [FV.BILLING, FV.BILLING_2]),
                "billing_version_seen")
    assert (conv["/billing"]["sessions"], conv["/billing"]["orders"]) == (2, 2)
    assert (conv["/billing-2"]["sessions"], conv["/billing-2"]["orders"]) == (1, 2)
    # first attempt: session 1 has 2 orders and saw both pages -> 2 x 2 joined rows
    row = M.one(X.billing_test_flags(s, pv, o, None, None))
    # old page: 1 converted session over (2*2 + 1) rows; new page: 1 over 2*2 rows
    assert row["og_billing_orders_conv_rt"] == 1 / 5 * 100
    assert row["new_billing_orders_conv_rt"] == 1 / 4 * 100
    # second attempt: each billing row repeats once per billing page of its session
    by_page = M.by(X.billing_test_flags_by_page(s, pv, None, None), "billing_version_seen")
    assert by_page["/billing"]["sessions"] == 3 and by_page["/billing"]["orders"] == 3
    assert by_page["/billing-2"]["sessions"] == 2
    assert by_page["/billing"]["billing_to_order_rt"] == 100.0


def test_entry_page_that_is_last_and_periods_in_one_session(spark):
    pv = M.pageviews(spark, [
        (10, "2024-01-10 10:00:00", 1, "/products"),
        (11, "2024-01-10 10:01:00", 1, "/the-original-mr-fuzzy"),
        (12, "2024-01-10 16:00:00", 1, "/products"),            # after the cut: own period
        (13, "2024-01-10 16:01:00", 1, "/the-forever-love-bear"),
        (20, "2024-01-11 09:00:00", 2, "/products"),            # last page: no next page
    ])
    cut = ts("2024-01-10 12:00:00")
    rows = {(r.time_period, r.website_session_id): r.next_pageview_url
            for r in U.next_page_rows(pv, FV.PRODUCTS, None, cut).collect()}
    assert rows == {(FV.PRE_PRODUCT_2, 1): FV.MR_FUZZY, (FV.POST_PRODUCT_2, 1): FV.LOVE_BEAR,
                    (FV.POST_PRODUCT_2, 2): None}
    summary = M.by(U.next_page_pathing(pv, FV.PRODUCTS, None, cut,
                                       {"mrfuzzy": FV.MR_FUZZY, "lovebear": FV.LOVE_BEAR}),
                   "time_period")
    post = summary[FV.POST_PRODUCT_2]
    assert (post["sessions"], post["w_next_pg"], post["pct_w_next_pg"]) == (2, 1, 50.0)
    assert (post["to_lovebear"], post["pct_to_lovebear"], post["to_mrfuzzy"]) == (1, 50.0, 0)
    urls = {r.pageview_url for r in U.funnel_step_discovery(pv, [FV.PRODUCTS]).collect()}
    assert urls == {FV.MR_FUZZY, FV.PRODUCTS, FV.LOVE_BEAR, None}


def test_multi_entry_flags_only_count_later_pages(spark):
    pv = M.pageviews(spark, [
        (10, "2024-01-10 10:00:00", 1, "/cart"),                     # before the entry
        (11, "2024-01-10 10:01:00", 1, "/the-original-mr-fuzzy"),
        (12, "2024-01-10 10:02:00", 1, "/shipping"),
        (13, "2024-01-10 10:03:00", 1, "/the-forever-love-bear"),
        (14, "2024-01-10 10:04:00", 1, "/cart"),
    ])
    steps = [("cart_made_it", FV.CART), ("shipping_made_it", FV.SHIPPING)]
    entries = {FV.MR_FUZZY: "mrfuzzy", FV.LOVE_BEAR: "lovebear"}
    got = M.by(U.multi_entry_flags(pv, entries, steps), "product_seen")
    assert (got["mrfuzzy"]["cart_made_it"], got["mrfuzzy"]["shipping_made_it"]) == (1, 1)
    assert (got["lovebear"]["cart_made_it"], got["lovebear"]["shipping_made_it"]) == (1, 0)


def test_funnel_step_nobody_reached_gives_null_rate(spark):
    flags = spark.createDataFrame([(1, 1, 0, 0), (2, 0, 0, 0)],
                                  "website_session_id long, a int, b int, c int")
    row = M.one(U.funnel_click_rates(flags, ["a", "b", "c"], ["ra", "rb", "rc"]))
    assert row == {"sessions": 2, "ra": 50.0, "rb": 0.0, "rc": None}
    report = U.funnel_report(flags, ["a", "b", "c"], ["na", "nb", "nc"]).collect()
    assert [tuple(r) for r in report] == [(2, 1.0, 0.0, 0.0), (2, 50.0, 0.0, None)]


def test_landing_segment_first_branch_wins(spark):
    flags = spark.createDataFrame([(1, 1, 1, 1), (2, 0, 1, 0), (3, 0, 0, 1)],
                                  "website_session_id long, saw_homepage int, "
                                  "saw_custom_lander int, product_made_it int")
    got = M.by(U.funnel_click_rates(flags, ["product_made_it"], ["lander_click_rt"], "all",
                                    U.landing_segment(), rounded=True, sessions_name=None),
               "segment")
    assert got[FV.SAW_HOMEPAGE]["lander_click_rt"] == 100.0
    assert got[FV.SAW_CUSTOM_LANDER]["lander_click_rt"] == 0.0
    assert got[FV.SEGMENT_SENTINEL]["lander_click_rt"] == 100.0


def test_cross_sell_residual_condition_stays_in_join(spark):
    o = M.orders(spark, [
        (1, "1997-03-01 00:00:00", None, 1, 1, 100, 60),   # no cross-sell item: still counted
        (2, "1997-03-01 00:00:00", None, 1, 2, 100, 60),   # cross-sells product 2
        (3, "1997-03-01 00:00:00", None, 1, 2, 100, 60),   # non-primary item of product 1
        (4, "1998-03-01 00:00:00", None, 1, 2, 100, 60),   # outside the window
    ])
    i = M.items(spark, [
        (11, "1997-03-01 00:00:00", 1, 1, 1, 100),
        (21, "1997-03-01 00:00:00", 2, 1, 1, 100),
        (22, "1997-03-01 00:00:00", 2, 2, 0, 100),
        (31, "1997-03-01 00:00:00", 3, 1, 1, 100),
        (32, "1997-03-01 00:00:00", 3, 1, 0, 100),
        (41, "1998-03-01 00:00:00", 4, 2, 0, 100),
    ])
    where = F.col("created_at").between(ts("1997-01-01"), ts("1997-12-31"))
    row = M.one(R.cross_sell_matrix(o, i, where))
    assert (row["orders"], row["x_sell_prod1"], row["x_sell_prod2"], row["x_sell_prod3"]) == (
        3, 1, 1, 0)
    assert (row["x_sell_prod1_rt"], row["x_sell_prod2_rt"]) == (33.33, 33.33)


def test_item_with_two_refunds(spark):
    i = M.items(spark, [
        (11, "2000-02-01 00:00:00", 1, 1, 1, 1000),
        (12, "2000-02-01 00:00:00", 1, 2, 0, 500),
        (21, "2000-02-03 00:00:00", 2, 1, 1, 1000),
    ])
    r = M.refunds(spark, [(111, 11, 1, "2000-02-10 00:00:00", 400),
                          (112, 11, 1, "2000-02-11 00:00:00", 600)])
    look = R.item_refund_lookup(i, r, order_ids=[1]).collect()
    assert sorted((x.order_item_id, x.order_item_refund_id) for x in look) == [
        (11, 111), (11, 112), (12, None)]
    month = M.one(R.refund_rates(i, r))
    assert (month["total_orders"], month["total_refunds"], month["refund_conv_rt"]) == (2, 2, 1.0)
    pivot = M.one(R.product_refund_rates(i, r))
    assert (pivot["p1_orders"], pivot["p1_refund_rt"], pivot["p2_orders"]) == (2, 50.0, 1)
    assert pivot["month"] == "February" and pivot["p3_refund_rt"] is None


def test_heatmap_mean_skips_days_without_sessions(spark):
    s = M.sessions(spark, [
        (1, "2024-01-01 09:10:00", None, None, None, "m"),   # Monday
        (2, "2024-01-01 09:20:00", None, None, None, "m"),
        (3, "2024-01-08 09:05:00", None, None, None, "m"),   # next Monday
        (4, "2024-01-08 10:00:00", None, None, None, "m"),
    ])
    rows = M.by(T.hour_weekday_heatmap(s), "hr")
    assert rows[9]["mon"] == 1.5 and rows[9]["tues"] is None
    assert rows[10]["mon"] == 1.0  # 2024-01-01 had no 10 o'clock session: not in the mean


def test_weekly_bounce_counts_landing_rows(spark):
    s = M.sessions(spark, [
        (1, "2024-01-02 10:00:00", "gsearch", "nonbrand", "g", "d"),
        (2, "2024-01-02 11:00:00", "gsearch", "nonbrand", "g", "d"),
        (3, "2024-01-09 11:00:00", "gsearch", "nonbrand", "g", "d"),
    ])
    pv = M.pageviews(spark, [
        (10, "2024-01-02 10:00:01", 1, "/home"),
        (20, "2024-01-02 11:00:01", 2, "/lander-1"),
        (21, "2024-01-02 11:00:30", 2, "/products"),
        (30, "2024-01-09 11:00:01", 3, "/products"),     # lands elsewhere: not counted
    ])
    rows = P.bounce_rate_weekly(s, pv, None).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.bounce_rt, r.home_sessions, r.lander_sessions) == (50.0, 1, 1)


def test_incremental_orders_after_last_home_session(spark):
    s = M.sessions(spark, [(k, f"2024-01-0{k} 10:00:00", "gsearch", "nonbrand", "g", "d")
                           for k in range(1, 6)])
    pv = M.pageviews(spark, [(k * 10, f"2024-01-0{k} 10:00:01", k, "/home" if k <= 2 else
                              "/lander-1") for k in range(1, 6)])
    last = P.last_seen_session_id(s, pv, FV.HOME)
    row = M.one(X.incremental_orders(s, None, last))
    assert row["session_since_test"] == 3
    assert row["incremental_orders"] == float("0.0261")


def test_years_merge_unless_asked(spark):
    s = M.sessions(spark, [
        (1, "2023-01-05 10:00:00", "gsearch", "nonbrand", "g", "d"),
        (2, "2024-01-09 10:00:00", "gsearch", "nonbrand", "g", "d"),
        (3, "2024-02-01 10:00:00", "gsearch", "nonbrand", "g", "d"),
    ])
    o = M.orders(spark, [(100, "2023-01-05 10:05:00", 1, 1, 1, 100, 60)])
    merged = T.period_trend(s, o).collect()
    assert sorted((str(r.period_start), r.sessions, r.orders) for r in merged) == [
        ("2023-01-05", 2, 1), ("2024-02-01", 1, 0)]
    split = T.period_trend(s, o, include_year=True).collect()
    assert len(split) == 3


def test_month_totals_sorted_by_year_then_dropped(spark):
    s = M.sessions(spark, [
        (1, "2024-01-09 10:00:00", None, None, None, "d"),
        (2, "2023-01-03 10:00:00", None, None, None, "d"),
        (3, "2023-01-10 10:00:00", None, None, None, "d"),
        (4, "2023-03-10 10:00:00", None, None, None, "d"),
    ])
    o = M.orders(spark, [(100, "2023-01-03 10:05:00", 2, 1, 1, 100, 60)])
    rows = T.volume_with_month_total(s, o).collect()
    assert "_year" not in rows[0].asDict()
    # 2023 rows first (January weeks 1 and 2 tie on the sort key, then March), 2024 last;
    # January totals span both years (the window is partitioned by month only)
    assert {(r.month, r.wk) for r in rows[:2]} == {(1, 1), (1, 2)}
    assert [(r.month, r.wk) for r in rows[2:]] == [(3, 10), (1, 1)]
    assert [r.total_month_sessions for r in rows] == [3, 3, 1, 3]
    assert rows[-1].week_start.year == 2024
    assert [r.orders for r in rows if r.week_start.isoformat() == "2023-01-03"] == [1]


def test_first_seen_forms_when_page_never_seen(spark):
    pv = M.pageviews(spark, [(10, "2024-01-02 10:00:00", 1, "/home")])
    assert P.first_seen(pv, FV.LANDER_1).count() == 0
    assert M.one(P.first_seen_pv(pv, FV.LANDER_1)) == {"first_pv": None}


def test_session_crossing_midnight_lands_once_per_date(spark):
    s = M.sessions(spark, [(1, "2024-01-02 23:58:00", "gsearch", "nonbrand", "g", "d")])
    pv = M.pageviews(spark, [
        (10, "2024-01-02 23:58:00", 1, "/home"),
        (11, "2024-01-02 23:59:30", 1, "/products"),
        (12, "2024-01-03 00:00:10", 1, "/lander-1"),   # same session, next date
    ])
    rows = P.first_pageview_per_session(pv, s, by_date=True, with_url=True).collect()
    assert sorted((str(r.date), r.min_pv_id, r.landing_page) for r in rows) == [
        ("2024-01-02", 10, "/home"), ("2024-01-03", 12, "/lander-1")]
    # three pageviews: neither landing row bounces; both weeks count the session once
    weekly = P.bounce_rate_weekly(s, pv, None).collect()
    assert sorted((r.home_sessions, r.lander_sessions, r.bounce_rt) for r in weekly) == [
        (1, 1, 0.0)]
