"""Funnel and pathing analyses on the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark import fixed_values as FV
from trailmark.functions import ts
from trailmark.operators import funnels as U
from trailmark.plans.oracle_views import pct2, ratio, with_views
from trailmark.plans.oracle_views import ts as sts
from trailmark.plans.q_pages import GN, sessions_in
from trailmark.plans.registry import register

DEMO_START, DEMO_END = "2024-01-04", "2024-01-24"      # '2014-01-01' .. '2014-02-01'
LANDER_START, LANDER_END = "2024-01-03", "2024-01-28"  # '2012-06-19' .. '2012-07-28', open
FLAGS2_START, FLAGS2_END = "2024-01-05", "2024-01-25"  # '2012-08-05' .. '2012-09-05'
PRODUCT_START, PRODUCT_END = "2024-01-06", "2024-01-27"  # '2013-01-06' .. '2013-04-10', open
PATH_START, PATH_END, PATH_CUT = "2024-01-03", "2024-01-27", "2024-01-15"  # 2012-10-06..2013-04-06

C = F.col


def _gsearch_nonbrand():
    return (C("utm_source") == FV.GSEARCH) & (C("utm_campaign") == FV.NONBRAND)


N = "count(website_session_id)"  # a row without a session id is no session


def _n(flag: str) -> str:
    """Oracle: sessions (one row each) with the flag set."""
    return f"{N} FILTER (WHERE {flag} = 1)"


def _flag(url: str) -> str:
    return f"max(CAST(pageview_url = '{url}' AS INTEGER))"


# ---- W19 ----------------------------------------------------------------------------------------

DEMO_STEPS = [("products_page", FV.PRODUCTS), ("mrfuzzy_page", FV.MR_FUZZY),
              ("cart_page", FV.CART)]
DEMO_URLS = [FV.LANDER_2, FV.PRODUCTS, FV.MR_FUZZY, FV.CART]

_DEMO_SESSIONS = f"created_at BETWEEN {sts(DEMO_START)} AND {sts(DEMO_END)}"
_DEMO_URL_FILTER = "pageview_url IN ('/lander-2', '/products', '/the-original-mr-fuzzy', '/cart')"
_DEMO_PV = f"""
SELECT website_session_id, pageview_url, created_at AS pageview_created_at,
       CAST(pageview_url = '/products' AS INTEGER) AS products_page,
       CAST(pageview_url = '/the-original-mr-fuzzy' AS INTEGER) AS mrfuzzy_page,
       CAST(pageview_url = '/cart' AS INTEGER) AS cart_page
FROM website_pageviews
WHERE {_DEMO_URL_FILTER} AND {sessions_in(_DEMO_SESSIONS)}"""


def _demo_where():
    return C("created_at").between(ts(DEMO_START), ts(DEMO_END))


@register("page_step_flags", "W19", with_views(_DEMO_PV))
def page_step_flags(d):
    return U.page_step_flags(d.sessions, d.pageviews, DEMO_STEPS, _demo_where(),
                             C("pageview_url").isin(DEMO_URLS))


# ---- W20 / W22 (all, by segment) ----------------------------------------------------------------

LANDER_STEPS = [
    ("saw_homepage", FV.HOME), ("saw_custom_lander", FV.LANDER_1),
    ("product_made_it", FV.PRODUCTS), ("mrfuzzy_made_it", FV.MR_FUZZY),
    ("cart_made_it", FV.CART), ("shipping_made_it", FV.SHIPPING),
    ("billing_made_it", FV.BILLING), ("thankyou_made_it", FV.THANK_YOU),
]

_LANDER_FLAGS = ("lander_flags", f"""
SELECT s.website_session_id,
       {", ".join(f"coalesce({_flag(u)}, 0) AS {n}" for n, u in LANDER_STEPS)}
FROM website_sessions s
LEFT JOIN website_pageviews p USING (website_session_id)
WHERE s.{GN.replace(" AND ", " AND s.")}
  AND s.created_at > {sts(LANDER_START)} AND s.created_at < {sts(LANDER_END)}
GROUP BY s.website_session_id""")


def lander_flags(d):
    where = _gsearch_nonbrand() & (C("created_at") < ts(LANDER_END)) & (
        C("created_at") > ts(LANDER_START))
    return U.session_made_it_flags(d.sessions, d.pageviews, LANDER_STEPS, where,
                                   keep_sessions_without_pageviews=True)


@register("session_made_it_flags", "W20", with_views("SELECT * FROM lander_flags", _LANDER_FLAGS))
def session_made_it_flags(d):
    return lander_flags(d)


SEGMENT_RATES = ["lander_click_rt", "product_click_rt", "mrfuzzy_click_rt", "cart_click_rt",
                 "shipping_click_rt", "billing_click_rt"]
SEGMENT_FLAGS = ["product_made_it", "mrfuzzy_made_it", "cart_made_it", "shipping_made_it",
                 "billing_made_it", "thankyou_made_it"]


def _segment_sql() -> str:
    rates = ",\n       ".join(f"{pct2(_n(f), N)} AS {r}"
                              for f, r in zip(SEGMENT_FLAGS, SEGMENT_RATES))
    return with_views(f"""
SELECT CASE WHEN saw_homepage = 1 THEN 'saw_homepage'
            WHEN saw_custom_lander = 1 THEN 'saw_custom_lander'
            ELSE 'oh no... check logic' END AS segment,
       {rates}
FROM lander_flags
GROUP BY ALL""", _LANDER_FLAGS)


@register("funnel_click_rates_by_segment", "W22", _segment_sql())
def funnel_click_rates_by_segment(d):
    return U.funnel_click_rates(lander_flags(d), SEGMENT_FLAGS, SEGMENT_RATES, denominator="all",
                                segment=U.landing_segment(), rounded=True, sessions_name=None)


# ---- W21 / W23 (flags without /home) ------------------------------------------------------------

FLAGS2 = [("products_made_it", FV.PRODUCTS), ("mrfuzzy_made_it", FV.MR_FUZZY),
          ("cart_made_it", FV.CART), ("shipping_made_it", FV.SHIPPING),
          ("thankyou_made_it", FV.THANK_YOU)]
FLAGS2_COUNTS = ["click_to_products", "click_to_mrfuzzy", "click_to_cart", "click_to_shipping",
                 "click_to_thankyou"]

_FLAGS2 = ("flags_without_home", f"""
SELECT website_session_id, {", ".join(f"{_flag(u)} AS {n}" for n, u in FLAGS2)}
FROM website_pageviews
WHERE pageview_url <> '/home'
  AND {sessions_in(f"created_at BETWEEN {sts(FLAGS2_START)} AND {sts(FLAGS2_END)} AND {GN}")}
GROUP BY website_session_id""")


def flags2(d):
    where = C("created_at").between(ts(FLAGS2_START), ts(FLAGS2_END)) & _gsearch_nonbrand()
    return U.session_made_it_flags(d.sessions, d.pageviews, FLAGS2, where,
                                   pageview_where=C("pageview_url") != FV.HOME)


_COUNT_ROW = "count(*) AS sessions,\n       " + ",\n       ".join(
    f"{_n(f)} AS {n}" for (f, _), n in zip(FLAGS2, FLAGS2_COUNTS))


@register("funnel_counts", "W21", with_views(f"""
SELECT {_COUNT_ROW}
FROM flags_without_home""", _FLAGS2))
def funnel_counts(d):
    return U.funnel_counts(flags2(d), [f for f, _ in FLAGS2], FLAGS2_COUNTS)


def _report_sql() -> str:
    names = ["sessions"] + [f"n{i + 1}" for i in range(len(FLAGS2))]
    counts = ", ".join(["count(*) AS sessions"] + [f"{_n(f)} AS n{i + 1}"
                                                   for i, (f, _) in enumerate(FLAGS2)])
    as_double = ", ".join(f"CAST(n{i + 1} AS DOUBLE) AS {c}" for i, c in enumerate(FLAGS2_COUNTS))
    rates = ", ".join(f"{ratio(names[i + 1], names[i])} * 100" for i in range(len(FLAGS2)))
    return with_views(f"""
SELECT sessions, {as_double} FROM step_counts
UNION ALL
SELECT sessions, {rates} FROM step_counts""", _FLAGS2,
                      ("step_counts", f"SELECT {counts} FROM flags_without_home"))


@register("funnel_report", "W23", _report_sql())
def funnel_report(d):
    return U.funnel_report(flags2(d), [f for f, _ in FLAGS2], FLAGS2_COUNTS)


# ---- W22 (previous step, interleaved counts) ----------------------------------------------------

DEMO_FLAGS = [("product_made_it", FV.PRODUCTS), ("mrfuzzy_made_it", FV.MR_FUZZY),
              ("cart_made_it", FV.CART)]

_DEMO_FLAGS = ("demo_flags", f"""
SELECT website_session_id, {", ".join(f"{_flag(u)} AS {n}" for n, u in DEMO_FLAGS)}
FROM website_pageviews
WHERE {_DEMO_URL_FILTER} AND {sessions_in(_DEMO_SESSIONS)}
GROUP BY website_session_id""")


@register("funnel_click_rates", "W22", with_views(f"""
SELECT {N} AS sessions,
       {_n('product_made_it')} AS clicked_to_products,
       {ratio(_n('product_made_it'), N)} * 100 AS lander_clickedthrough_rate,
       {_n('mrfuzzy_made_it')} AS clicked_to_mrfuzzy,
       {ratio(_n('mrfuzzy_made_it'), _n('product_made_it'))} * 100 AS products_clickedthrough_rate,
       {_n('cart_made_it')} AS clicked_to_cart,
       {ratio(_n('cart_made_it'), _n('mrfuzzy_made_it'))} * 100 AS mrfuzzy_clickedthrough_rate
FROM demo_flags""", _DEMO_FLAGS))
def funnel_click_rates(d):
    flags = U.session_made_it_flags(d.sessions, d.pageviews, DEMO_FLAGS, _demo_where(),
                                    pageview_where=C("pageview_url").isin(DEMO_URLS))
    return U.funnel_click_rates(
        flags, [f for f, _ in DEMO_FLAGS],
        ["lander_clickedthrough_rate", "products_clickedthrough_rate",
         "mrfuzzy_clickedthrough_rate"],
        count_names=["clicked_to_products", "clicked_to_mrfuzzy", "clicked_to_cart"])


# ---- W24 / W25 ----------------------------------------------------------------------------------

PRODUCT_ENTRIES = {FV.MR_FUZZY: FV.MRFUZZY_LABEL, FV.LOVE_BEAR: FV.LOVEBEAR_LABEL}
PRODUCT_STEPS = [("cart_made_it", FV.CART), ("shipping_made_it", FV.SHIPPING),
                 ("billing_made_it", FV.BILLING_2), ("thankyou_made_it", FV.THANK_YOU)]

_PRODUCT_ENTRY = (f"created_at < {sts(PRODUCT_END)} AND created_at > {sts(PRODUCT_START)} "
                  "AND pageview_url IN ('/the-original-mr-fuzzy', '/the-forever-love-bear')")


def _later(url: str) -> str:
    return (f"CAST(EXISTS (SELECT 1 FROM website_pageviews q WHERE q.website_session_id = "
            f"e.website_session_id AND q.website_pageview_id > e.entry_id AND "
            f"q.pageview_url = '{url}') AS INTEGER)")


_PRODUCT_FLAGS = ("product_flags", f"""
SELECT e.website_session_id,
       CASE e.entry_url WHEN '/the-original-mr-fuzzy' THEN 'mrfuzzy'
                        WHEN '/the-forever-love-bear' THEN 'lovebear'
                        ELSE 'check logic' END AS product_seen,
       {", ".join(f"{_later(u)} AS {n}" for n, u in PRODUCT_STEPS)}
FROM (SELECT website_session_id, pageview_url AS entry_url, min(website_pageview_id) AS entry_id
      FROM website_pageviews WHERE {_PRODUCT_ENTRY}
      GROUP BY ALL) AS e""")


def _product_where():
    return (C("created_at") < ts(PRODUCT_END)) & (C("created_at") > ts(PRODUCT_START))


def product_flags(d):
    return U.multi_entry_flags(d.pageviews, PRODUCT_ENTRIES, PRODUCT_STEPS, _product_where())


@register("multi_entry_flags", "W24", with_views("SELECT * FROM product_flags", _PRODUCT_FLAGS))
def multi_entry_flags(d):
    return product_flags(d)


@register("multi_entry_funnel", "W24", with_views(f"""
SELECT product_seen, {N} AS sessions,
       {_n('cart_made_it')} AS to_cart, {_n('shipping_made_it')} AS to_shipping,
       {_n('billing_made_it')} AS to_billing, {_n('thankyou_made_it')} AS to_thankyou
FROM product_flags
GROUP BY product_seen""", _PRODUCT_FLAGS))
def multi_entry_funnel(d):
    return U.multi_entry_counts(product_flags(d), [f for f, _ in PRODUCT_STEPS],
                                ["to_cart", "to_shipping", "to_billing", "to_thankyou"])


PRODUCT_RATES = ["product_page_click_rt", "cart_page_click_rt", "shipping_page_click_rt",
                 "billing_page_click_rt"]


def _product_rates_sql() -> str:
    prev = [N] + [_n(f) for f, _ in PRODUCT_STEPS]
    rates = ",\n       ".join(f"{pct2(prev[i + 1], prev[i])} AS {n}"
                              for i, n in enumerate(PRODUCT_RATES))
    return with_views(f"""
SELECT product_seen,
       {rates}
FROM product_flags
GROUP BY product_seen""", _PRODUCT_FLAGS)


@register("multi_entry_click_rates", "W24", _product_rates_sql())
def multi_entry_click_rates(d):
    return U.multi_entry_click_rates(product_flags(d), [f for f, _ in PRODUCT_STEPS],
                                     PRODUCT_RATES)


@register("funnel_step_discovery", "W25", with_views(f"""
SELECT DISTINCT p.pageview_url
FROM website_pageviews p
WHERE p.website_pageview_id > (SELECT min(e.website_pageview_id) FROM website_pageviews e
                               WHERE e.website_session_id = p.website_session_id
                                 AND {_PRODUCT_ENTRY.replace("created_at", "e.created_at").replace("pageview_url IN", "e.pageview_url IN")})
UNION
SELECT NULL
WHERE EXISTS (SELECT 1 FROM website_pageviews e
              WHERE {_PRODUCT_ENTRY.replace("created_at", "e.created_at").replace("pageview_url IN", "e.pageview_url IN")}
                AND NOT EXISTS (SELECT 1 FROM website_pageviews q
                                WHERE q.website_session_id = e.website_session_id
                                  AND q.website_pageview_id > e.website_pageview_id))"""))
def funnel_step_discovery(d):
    return U.funnel_step_discovery(d.pageviews, list(PRODUCT_ENTRIES), _product_where())


# ---- W26 ----------------------------------------------------------------------------------------

_PATH_ROWS = ("path_rows", f"""
SELECT time_period, website_session_id, next_url AS next_pageview_url
FROM (SELECT website_session_id, website_pageview_id, pageview_url, created_at,
             CASE WHEN created_at < {sts(PATH_CUT)} THEN 'A. Pre_Product_2'
                  WHEN created_at >= {sts(PATH_CUT)} THEN 'B. Post_Product_2'
                  ELSE 'check logic' END AS time_period,
             CASE WHEN website_session_id IS NOT NULL
                  THEN lead(pageview_url) OVER (PARTITION BY website_session_id
                                                ORDER BY website_pageview_id) END AS next_url
      FROM website_pageviews) AS p
WHERE pageview_url = '/products'
  AND created_at > {sts(PATH_START)} AND created_at < {sts(PATH_END)}
QUALIFY row_number() OVER (PARTITION BY time_period, website_session_id
                           ORDER BY website_pageview_id) = 1""")

PATH_TARGETS = {"mrfuzzy": FV.MR_FUZZY, "lovebear": FV.LOVE_BEAR}


def _path_where():
    return (C("created_at") < ts(PATH_END)) & (C("created_at") > ts(PATH_START))


@register("next_page_rows", "W26", with_views("SELECT * FROM path_rows", _PATH_ROWS))
def next_page_rows(d):
    return U.next_page_rows(d.pageviews, FV.PRODUCTS, _path_where(), ts(PATH_CUT))


@register("next_page_pathing", "W26", with_views(f"""
SELECT time_period, {N} AS sessions,
       count(next_pageview_url) AS w_next_pg,
       {pct2('count(next_pageview_url)', N)} AS pct_w_next_pg,
       {N} FILTER (WHERE next_pageview_url = '/the-original-mr-fuzzy') AS to_mrfuzzy,
       {pct2(N + " FILTER (WHERE next_pageview_url = '/the-original-mr-fuzzy')", N)} AS pct_to_mrfuzzy,
       {N} FILTER (WHERE next_pageview_url = '/the-forever-love-bear') AS to_lovebear,
       {pct2(N + " FILTER (WHERE next_pageview_url = '/the-forever-love-bear')", N)} AS pct_to_lovebear
FROM path_rows
GROUP BY time_period""", _PATH_ROWS))
def next_page_pathing(d):
    return U.next_page_pathing(d.pageviews, FV.PRODUCTS, _path_where(), ts(PATH_CUT),
                               PATH_TARGETS)
