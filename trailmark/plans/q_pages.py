"""Page, landing-page and bounce analyses on the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark import fixed_values as FV
from trailmark.functions import ts
from trailmark.operators import pages as P
from trailmark.plans.oracle_views import ratio, week0, with_views
from trailmark.plans.oracle_views import ts as sts
from trailmark.plans.registry import register

TOP_END = "2024-01-09"                 # '2012-06-09'
LANDING_END = "2024-01-12"             # '2012-06-12'
BOUNCE_END = "2024-01-14"              # '2012-06-14'
DEMO_START, DEMO_END = "2024-01-04", "2024-01-24"      # '2014-01-01' .. '2014-02-01'
WEEKLY_START, WEEKLY_END = "2024-01-01", "2024-01-29"  # '2012-06-01' .. '2012-08-31'
TEST_END = "2024-01-28"                # '2012-07-28'
SEEN_END = "2024-01-27"                # '2012-11-27'

C = F.col

# the new landing page counts as launched on this day (the test data has it from the start)
LANDER_LAUNCH = "2024-01-05"
FIRST_LANDER_SQL = ("(SELECT min(website_pageview_id) FROM website_pageviews "
                    f"WHERE pageview_url = '/lander-1' AND created_at >= {sts(LANDER_LAUNCH)})")
GN = "utm_source = 'gsearch' AND utm_campaign = 'nonbrand'"


def sessions_in(cond: str) -> str:
    """Oracle: pageview rows of sessions passing ``cond``."""
    return f"website_session_id IN (SELECT website_session_id FROM website_sessions WHERE {cond})"


def landing_sql(pv_cond: str = "TRUE", session_cond: str | None = None,
                with_pages: bool = False, urls: str | None = None) -> str:
    """Oracle: each session's first qualifying pageview (row_number over the session), with the
    session's count of all pageviews when ``with_pages``."""
    src = ("(SELECT *, count(*) OVER (PARTITION BY website_session_id) AS pages_viewed "
           "FROM website_pageviews)" if with_pages else "website_pageviews")
    where = pv_cond + (f" AND {sessions_in(session_cond)}" if session_cond else "")
    cols = "website_session_id, pageview_url AS landing_page" + (
        ", pages_viewed" if with_pages else "")
    sql = (f"SELECT {cols} FROM {src} AS p WHERE {where} "
           "QUALIFY row_number() OVER (PARTITION BY website_session_id "
           "ORDER BY website_pageview_id) = 1")
    return sql if urls is None else f"SELECT * FROM ({sql}) AS l WHERE landing_page IN ({urls})"


def test_landing_sql(strict: bool = False, with_pages: bool = False) -> str:
    op = ">" if strict else ">="
    return landing_sql(f"website_pageview_id {op} {FIRST_LANDER_SQL}",
                       f"created_at < {sts(TEST_END)} AND {GN}", with_pages,
                       "'/home', '/lander-1'")


def demo_landing_sql(with_pages: bool = False) -> str:
    return landing_sql("TRUE", f"created_at BETWEEN {sts(DEMO_START)} AND {sts(DEMO_END)}",
                       with_pages)


def bounce_by_landing_sql(landing: str) -> str:
    return f"""
SELECT landing_page, count(*) AS total_sessions,
       count(*) FILTER (WHERE pages_viewed = 1) AS bounced_sessions,
       {ratio('count(*) FILTER (WHERE pages_viewed = 1)', 'count(*)')} * 100 AS bounce_rt
FROM ({landing}) AS l
GROUP BY landing_page
ORDER BY bounce_rt DESC"""


def gsearch_nonbrand():
    return (C("utm_source") == FV.GSEARCH) & (C("utm_campaign") == FV.NONBRAND)


@register("top_pages", "W10", with_views(f"""
SELECT pageview_url, count(DISTINCT website_pageview_id) AS pvs
FROM website_pageviews
WHERE created_at < {sts(TOP_END)}
GROUP BY pageview_url
ORDER BY pvs DESC"""))
def top_pages(d):
    return P.top_pages(d.pageviews, C("created_at") < ts(TOP_END))


@register("first_pageview_per_session", "W11", with_views("""
SELECT website_session_id, min(website_pageview_id) AS min_pv_id
FROM website_pageviews
GROUP BY website_session_id"""))
def first_pageview_per_session(d):
    return P.first_pageview_per_session(d.pageviews)


@register("first_pageview_per_session_by_date", "W11", with_views(f"""
SELECT CAST(created_at AS DATE) AS date, website_session_id,
       min(website_pageview_id) AS min_pv_id
FROM website_pageviews
WHERE {sessions_in(f"created_at BETWEEN {sts(WEEKLY_START)} AND {sts(WEEKLY_END)} AND {GN}")}
GROUP BY ALL"""))
def first_pageview_per_session_by_date(d):
    where = C("created_at").between(ts(WEEKLY_START), ts(WEEKLY_END)) & gsearch_nonbrand()
    return P.first_pageview_per_session(d.pageviews, d.sessions, where, by_date=True)


@register("first_pageview_per_session_before", "W11", with_views(f"""
SELECT website_session_id, min(website_pageview_id) AS min_pv_id
FROM website_pageviews
WHERE created_at < {sts(LANDING_END)}
GROUP BY website_session_id"""))
def first_pageview_per_session_before(d):
    return P.first_pageview_per_session(d.pageviews, where=C("created_at") < ts(LANDING_END))


@register("first_pageview_per_session_in_window", "W11", with_views(f"""
SELECT website_session_id, min(website_pageview_id) AS min_pv_id
FROM website_pageviews
WHERE {sessions_in(f"created_at BETWEEN {sts(DEMO_START)} AND {sts(DEMO_END)}")}
GROUP BY website_session_id"""))
def first_pageview_per_session_in_window(d):
    return P.first_pageview_per_session(d.pageviews, d.sessions,
                                        C("created_at").between(ts(DEMO_START), ts(DEMO_END)))


@register("first_pageview_of_sessions", "W11", with_views(f"""
SELECT s.website_session_id,
       (SELECT min(p.website_pageview_id) FROM website_pageviews p
         WHERE p.website_session_id = s.website_session_id) AS min_pv_id
FROM website_sessions s
WHERE s.created_at < {sts(BOUNCE_END)}"""))
def first_pageview_of_sessions(d):
    return P.first_pageview_of_sessions(d.sessions, d.pageviews,
                                        C("created_at") < ts(BOUNCE_END)).select(
        "website_session_id", "min_pv_id")


def test_landing(d, strict: bool = False, with_pages: bool = False):
    """Landing pages of the landing-page test sessions (original PERF Q6 / STEP test form)."""
    return P.landing_page(
        d.pageviews, d.sessions, (C("created_at") < ts(TEST_END)) & gsearch_nonbrand(),
        min_pv_id=P.first_seen_id(d.pageviews.where(C("created_at") >= ts(LANDER_LAUNCH)), FV.LANDER_1),
        strict=strict,
        urls=[FV.HOME, FV.LANDER_1], with_pages=with_pages)


@register("landing_page", "W12", with_views(test_landing_sql()))
def landing_page(d):
    return test_landing(d)


@register("landing_page_volume", "W13", with_views(f"""
SELECT landing_page AS landing_page_url, count(website_session_id) AS sessions_hitting_page
FROM ({landing_sql(f"created_at < {sts(LANDING_END)}")}) AS l
GROUP BY landing_page"""))
def landing_page_volume(d):
    return P.landing_page_volume(d.pageviews, C("created_at") < ts(LANDING_END))


# the first pageview of the whole table, kept by its own date
_BY_LANDING = f"SELECT * FROM ({landing_sql().replace('pageview_url AS', 'created_at, pageview_url AS')}) AS l WHERE created_at < {sts(LANDING_END)}"


@register("landing_page_volume_by_landing", "W13", with_views(f"""
SELECT landing_page AS landing_page_url, count(website_session_id) AS sessions_hitting_page
FROM ({_BY_LANDING}) AS l
GROUP BY landing_page"""))
def landing_page_volume_by_landing(d):
    return P.landing_page_volume_by_landing(d.pageviews, C("created_at") < ts(LANDING_END))


@register("landing_page_rows", "W13", with_views("""
SELECT website_session_id, pageview_url, website_pageview_id AS min_pv_id
FROM website_pageviews
QUALIFY website_pageview_id = min(website_pageview_id) OVER (PARTITION BY website_session_id)"""))
def landing_page_rows(d):
    return P.landing_page_rows(d.pageviews)


def demo_landing(d, with_pages: bool = False):
    return P.landing_page(d.pageviews, d.sessions,
                          C("created_at").between(ts(DEMO_START), ts(DEMO_END)),
                          with_pages=with_pages)


@register("landing_page_in_window", "W12", with_views(demo_landing_sql()))
def landing_page_in_window(d):
    return demo_landing(d)


@register("bounced_sessions", "W14", with_views(f"""
SELECT * FROM ({demo_landing_sql(with_pages=True)}) AS l WHERE pages_viewed = 1"""))
def bounced_sessions(d):
    return P.bounced_sessions(demo_landing(d, with_pages=True))


@register("bounce_rate_by_landing_page", "W15",
          with_views(bounce_by_landing_sql(demo_landing_sql(with_pages=True))))
def bounce_rate_by_landing_page(d):
    return P.bounce_rate_by_landing_page(demo_landing(d, with_pages=True))


@register("bounce_rate", "W15", with_views(f"""
SELECT count(*) AS total_sessions,
       count(*) FILTER (WHERE c.n = 1) AS bounced_sessions,
       {ratio('count(*) FILTER (WHERE c.n = 1)', 'count(*)')} * 100 AS bounce_rt
FROM website_sessions s
LEFT JOIN (SELECT website_session_id, count(*) AS n FROM website_pageviews GROUP BY 1) c
  USING (website_session_id)
WHERE s.created_at < {sts(BOUNCE_END)}"""))
def bounce_rate(d):
    landing = P.first_pageview_of_sessions(d.sessions, d.pageviews,
                                           C("created_at") < ts(BOUNCE_END))
    return P.bounce_rate(landing)


@register("bounce_rate_landing_test", "W15",
          with_views(bounce_by_landing_sql(test_landing_sql(strict=True, with_pages=True))))
def bounce_rate_landing_test(d):
    return P.bounce_rate_by_landing_page(test_landing(d, strict=True, with_pages=True))


@register("bounce_rate_weekly", "W16", with_views(f"""
SELECT min(date) AS week_start_date,
       {ratio('count(DISTINCT sid) FILTER (WHERE session_bounced)', 'count(DISTINCT sid)')} * 100 AS bounce_rt,
       count(DISTINCT sid) FILTER (WHERE url = '/home') AS home_sessions,
       count(DISTINCT sid) FILTER (WHERE url = '/lander-1') AS lander_sessions
FROM (
  SELECT *, bool_or(k * n = 1) OVER (PARTITION BY sid) AS session_bounced
  FROM (
    SELECT *, count(*) OVER (PARTITION BY sid, url) AS k
    FROM (
      SELECT CAST(created_at AS DATE) AS date, website_session_id AS sid,
             pageview_url AS url, n
      FROM (SELECT *, count(*) OVER (PARTITION BY website_session_id) AS n
            FROM website_pageviews) AS p
      WHERE {sessions_in(f"created_at BETWEEN {sts(WEEKLY_START)} AND {sts(WEEKLY_END)} AND {GN}")}
      QUALIFY row_number() OVER (PARTITION BY website_session_id, CAST(created_at AS DATE)
                                 ORDER BY website_pageview_id) = 1
    ) AS firsts
    WHERE url IN ('/home', '/lander-1')
  ) AS landing_rows
) AS flagged
GROUP BY {week0('date')}"""))
def bounce_rate_weekly(d):
    where = C("created_at").between(ts(WEEKLY_START), ts(WEEKLY_END)) & gsearch_nonbrand()
    return P.bounce_rate_weekly(d.sessions, d.pageviews, where)


@register("first_seen", "W17", with_views("""
SELECT pageview_url, min(created_at) AS first_created_at,
       min(website_pageview_id) AS first_pv_id
FROM website_pageviews
WHERE pageview_url = '/lander-1'
GROUP BY pageview_url"""))
def first_seen(d):
    return P.first_seen(d.pageviews, FV.LANDER_1)


@register("first_seen_pv", "W17", with_views("""
SELECT min(website_pageview_id) AS first_pv FROM website_pageviews WHERE pageview_url = '/lander-1'"""))
def first_seen_pv(d):
    return P.first_seen_pv(d.pageviews, FV.LANDER_1)


@register("first_seen_rows", "W17", with_views("""
SELECT website_session_id, pageview_url, created_at, min(website_pageview_id) AS min_pv_id
FROM website_pageviews
WHERE pageview_url = '/billing-2'
GROUP BY ALL
ORDER BY created_at"""))
def first_seen_rows(d):
    return P.first_seen_rows(d.pageviews, FV.BILLING_2)


@register("last_seen_session", "W18", with_views(f"""
SELECT max(website_session_id) AS most_recent_session_id
FROM website_sessions
WHERE {GN} AND created_at < {sts(SEEN_END)}
  AND website_session_id IN (SELECT website_session_id FROM website_pageviews
                             WHERE pageview_url = '/home')"""))
def last_seen_session(d):
    where = gsearch_nonbrand() & (C("created_at") < ts(SEEN_END))
    return P.last_seen_session(d.sessions, d.pageviews, FV.HOME, where)
