"""Pages, landing pages and bounces.

The landing page of a session is the url of its lowest pageview id. It is computed in one
aggregate, ``min_by(pageview_url, website_pageview_id)``, next to ``min(website_pageview_id)``:
partial aggregation runs map-side, so a session with very many pageviews is collapsed before the
shuffle, and the original's "min id, then join back on the id" self-join disappears.

A bounce is a landing row whose session has exactly one pageview in the whole pageview table; the
page count per session is another partial aggregate joined one-to-one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import fixed_values as FV
from trailmark.functions import ratio_pct, week0
from trailmark.operators.common import SESSION, apply_filter

PV = "website_pageview_id"
URL = "pageview_url"


# ---- W10 ----------------------------------------------------------------------------------------

def top_pages(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """Distinct pageviews per url, most viewed first (pageview id is the key)."""
    return (apply_filter(pageviews, where).groupBy(URL)
            .agg(F.count(PV).alias("pvs"))
            .orderBy(F.desc("pvs")))


# ---- W11 / W12 ----------------------------------------------------------------------------------

def _row_filter(where: Column | None, min_pv_id: Column | int | None,
                strict: bool) -> Column | None:
    cond = where
    if min_pv_id is not None:
        bound = F.lit(min_pv_id) if isinstance(min_pv_id, int) else min_pv_id
        b = F.col(PV) > bound if strict else F.col(PV) >= bound
        cond = b if cond is None else cond & b
    return cond


def _bounded(pageviews: DataFrame, where: Column | None, min_pv_id: Column | int | None,
             strict: bool) -> DataFrame:
    return apply_filter(pageviews, _row_filter(where, min_pv_id, strict))


def first_pageview_per_session(pageviews: DataFrame, sessions: DataFrame | None = None,
                               session_where: Column | None = None, where: Column | None = None,
                               min_pv_id: Column | int | None = None, strict: bool = False,
                               by_date: bool = False, with_url: bool = False) -> DataFrame:
    """Lowest pageview id per session (per (pageview date, session) with ``by_date``).

    ``sessions``/``session_where`` restrict to sessions passing a filter (the original's inner
    join with filters in ``ON``); ``min_pv_id`` keeps pageviews from a launch id on (``strict``:
    after it). ``with_url`` adds the landing url (W12).

    Pageviews are aggregated per session *before* the session filter is applied: the aggregate is
    partial (a session with a third of all pageviews is collapsed inside each map task), and the
    semi join that follows has one row per key on both sides.
    """
    pv = _bounded(pageviews, where, min_pv_id, strict)
    keys = [F.to_date("created_at").alias("date"), F.col(SESSION)] if by_date else [F.col(SESSION)]
    aggs = [F.min(PV).alias("min_pv_id")]
    if with_url:
        aggs.append(F.min_by(URL, PV).alias("landing_page"))
    firsts = pv.groupBy(*keys).agg(*aggs)
    if sessions is not None:
        keep = apply_filter(sessions, session_where).select(SESSION)
        firsts = firsts.join(keep, SESSION, "left_semi")
    return firsts


def first_pageview_of_sessions(sessions: DataFrame, pageviews: DataFrame,
                               session_where: Column | None = None) -> DataFrame:
    """W11, session-preserving form: every filtered session with its first pageview id, url and
    page count, NULL when the session has no pageview (sessions ⟕ pageviews, then MIN)."""
    per_session = pageviews.groupBy(SESSION).agg(
        F.min(PV).alias("min_pv_id"), F.min_by(URL, PV).alias("landing_page"),
        F.count(F.lit(1)).alias("pages_viewed"))
    s = apply_filter(sessions, session_where).select(SESSION)
    return s.join(per_session, SESSION, "left")


def landing_page(pageviews: DataFrame, sessions: DataFrame | None = None,
                 session_where: Column | None = None, where: Column | None = None,
                 min_pv_id: Column | int | None = None, strict: bool = False,
                 urls: Sequence[str] | None = None, with_pages: bool = False) -> DataFrame:
    """(website_session_id, landing_page), optionally only landing urls in ``urls``.

    With ``urls`` the landing url is found by comparing ids, see ``_url_mins``.

    ``with_pages`` adds ``pages_viewed``, the session's count of *all* pageviews, from the same
    single aggregate: the landing page only looks at pageviews passing the filters
    (``min_by(url, when(filter, id))`` skips the others) while the count takes every row. Bounce
    analyses then need one pass over pageviews instead of two plus a join.
    """
    cond = _row_filter(where, min_pv_id, strict)
    pv_id = F.col(PV) if cond is None or not with_pages else F.when(cond, F.col(PV))
    pv = pageviews if with_pages else apply_filter(pageviews, cond)
    aggs = [F.min(pv_id).alias("min_pv_id")]
    if urls is None:
        aggs.append(F.min_by(URL, pv_id).alias("landing_page"))
    else:
        aggs += _url_mins(urls, pv_id)
    if with_pages:
        aggs.append(F.count(F.lit(1)).alias("pages_viewed"))
    lp = pv.groupBy(SESSION).agg(*aggs).where(F.col("min_pv_id").isNotNull())
    if sessions is not None:
        keep = apply_filter(sessions, session_where).select(SESSION)
        lp = lp.join(keep, SESSION, "left_semi")
    if urls is not None:
        lp = lp.withColumn("landing_page", _landed_on(urls)).where("landing_page is not null")
    return lp.select(SESSION, "landing_page", *(["pages_viewed"] if with_pages else []))


def _url_mins(urls: Sequence[str], pv_id: Column) -> list[Column]:
    """Lowest pageview id of each listed url: longs, so the aggregate stays hash-based (the url of
    the lowest id, as a string, would sort every pageview)."""
    return [F.min(F.when(F.col(URL) == u, pv_id)).alias(f"_u{i}") for i, u in enumerate(urls)]


def _landed_on(urls: Sequence[str]) -> Column:
    """The listed url whose lowest id is the session's lowest; NULL for other landing pages."""
    return F.coalesce(*[F.when(F.col(f"_u{i}") == F.col("min_pv_id"), u) for i, u in enumerate(urls)])


# ---- W13 ----------------------------------------------------------------------------------------

def landing_page_volume(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """Sessions per landing url, over pageviews passing ``where``."""
    lp = first_pageview_per_session(pageviews, where=where, with_url=True)
    return _volume(lp)


def _volume(landing: DataFrame) -> DataFrame:
    # a landing row without a session id is no session: COUNT(DISTINCT id) skips it
    return landing.groupBy(F.col("landing_page").alias("landing_page_url")).agg(
        F.count(SESSION).alias("sessions_hitting_page"))


def landing_page_volume_by_landing(pageviews: DataFrame, where_landing: Column) -> DataFrame:
    """W13, second form: the first pageview is taken over the whole table, then landing rows are
    kept by a condition on that pageview (its ``created_at`` or url). It differs from filtering
    first wherever a session began outside the condition, or pageview ids are not in time order."""
    first = pageviews.groupBy(SESSION).agg(
        F.min_by(F.struct("created_at", URL), PV).alias("first"))
    first = first.select(SESSION, "first.*").where(where_landing)
    return _volume(first.withColumnRenamed(URL, "landing_page"))


def landing_page_rows(pageviews: DataFrame, where: Column | None = None) -> DataFrame:
    """W13 row level: (website_session_id, pageview_url, min_pv_id) of each first pageview."""
    lp = first_pageview_per_session(pageviews, where=where, with_url=True)
    return lp.select(SESSION, F.col("landing_page").alias(URL), "min_pv_id")


# ---- W14 / W15 ----------------------------------------------------------------------------------

def pages_per_session(pageviews: DataFrame) -> DataFrame:
    return pageviews.groupBy(SESSION).agg(F.count(F.lit(1)).alias("pages_viewed"))


def _with_pages(landing: DataFrame, pageviews: DataFrame | None) -> DataFrame:
    """Landing rows with the session's page count: taken from the landing frame when it carries
    ``pages_viewed`` (``landing_page(..., with_pages=True)``), else joined from ``pageviews``."""
    if "pages_viewed" in landing.columns:
        return landing
    return landing.join(pages_per_session(pageviews), SESSION, "left")


def bounced_sessions(landing: DataFrame, pageviews: DataFrame | None = None) -> DataFrame:
    """Landing rows (website_session_id, landing_page) whose session has exactly 1 pageview.

    Pages are counted over the whole pageview table, as the original's left join does; a
    session with no pageview counts 0 and never bounces.
    """
    return (_with_pages(landing, pageviews)
            .where(F.col("pages_viewed") == 1)
            .select(SESSION, "landing_page", "pages_viewed"))


def _with_bounce_flag(landing: DataFrame, pageviews: DataFrame | None) -> DataFrame:
    return _with_pages(landing, pageviews).withColumn(
        "bounced", F.when(F.col("pages_viewed") == 1, 1).otherwise(0))


def bounce_rate(landing: DataFrame, pageviews: DataFrame | None = None) -> DataFrame:
    """W15 overall: total sessions, bounced sessions, bounce rate (percent, unrounded)."""
    b = _with_bounce_flag(landing, pageviews)
    out = b.agg(F.count(F.lit(1)).alias("total_sessions"),
                F.sum("bounced").cast("bigint").alias("bounced_sessions"))
    return out.select(
        "total_sessions",
        F.coalesce("bounced_sessions", F.lit(0)).alias("bounced_sessions"),
        ratio_pct("bounced_sessions", "total_sessions").alias("bounce_rt"),
    )


def bounce_rate_by_landing_page(landing: DataFrame,
                                pageviews: DataFrame | None = None) -> DataFrame:
    """W15 per landing page, highest bounce rate first."""
    b = _with_bounce_flag(landing, pageviews)
    out = b.groupBy("landing_page").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum("bounced").cast("bigint").alias("bounced_sessions"))
    return (out.withColumn("bounce_rt", ratio_pct("bounced_sessions", "total_sessions"))
            .orderBy(F.desc("bounce_rt")))


# ---- W16 ----------------------------------------------------------------------------------------

def bounce_rate_weekly(sessions: DataFrame, pageviews: DataFrame, session_where: Column | None,
                       home_url: str = FV.HOME, lander_url: str = FV.LANDER_1) -> DataFrame:
    """Per week-0 of the landing date: first date, bounce rate, home and lander sessions.

    Landing rows are per (pageview date, session), as in the original, so a session spanning
    midnight lands once per date. The original marks a landing (session, url) bounced when its
    landing rows times the session's page count is exactly 1, i.e. when the session has a single
    pageview. One aggregate per (date, session) yields the landing url and that day's page count;
    the session's page count is a windowed sum over those rows (one per day of a session), so
    pageviews are read once. Two aggregation levels, (week, session) then week, replace the
    distinct counts.
    """
    urls = (home_url, lander_url)
    keep = apply_filter(sessions, session_where).select(SESSION)
    per_day = (pageviews.groupBy(F.to_date("created_at").alias("date"), SESSION)
               .agg(F.min(PV).alias("min_pv_id"), *_url_mins(urls, F.col(PV)),
                    F.count(F.lit(1)).alias("n"))
               .join(keep, SESSION, "left_semi"))
    pages = F.sum("n").over(Window.partitionBy(SESSION))
    rows = (per_day.withColumn("bounced", F.when(pages == 1, 1).otherwise(0))
            .withColumn("landing_page", _landed_on(urls)).where("landing_page is not null"))
    per_week_session = rows.groupBy(week0("date").alias("_wk"), SESSION).agg(
        F.min("date").alias("date"),
        F.max(F.when(F.col("bounced") == 1, 1).otherwise(0)).alias("bounced"),
        F.max(F.when(F.col("landing_page") == home_url, 1).otherwise(0)).alias("home"),
        F.max(F.when(F.col("landing_page") == lander_url, 1).otherwise(0)).alias("lander"),
    )
    out = per_week_session.groupBy("_wk").agg(
        F.min("date").alias("week_start_date"),
        F.sum("bounced").alias("_bounced"),
        F.count(F.lit(1)).alias("_sessions"),
        F.sum("home").cast("bigint").alias("home_sessions"),
        F.sum("lander").cast("bigint").alias("lander_sessions"),
    )
    return out.select("week_start_date", ratio_pct("_bounced", "_sessions").alias("bounce_rt"),
                      "home_sessions", "lander_sessions")


# ---- W17 / W18 ----------------------------------------------------------------------------------

def first_seen(pageviews: DataFrame, url: str) -> DataFrame:
    """First time and first pageview id at which ``url`` appears (one row, if seen)."""
    return pageviews.where(F.col(URL) == url).groupBy(URL).agg(
        F.min("created_at").alias("first_created_at"),
        F.min(PV).alias("first_pv_id"))


def first_seen_pv(pageviews: DataFrame, url: str) -> DataFrame:
    """W17 ungrouped form: one row with the first pageview id of ``url`` (NULL if never seen)."""
    return pageviews.where(F.col(URL) == url).agg(F.min(PV).alias("first_pv"))


def first_seen_id(pageviews: DataFrame, url: str) -> Column:
    """W17 as a scalar subquery Column: evaluated by Spark at run time, never collected."""
    return pageviews.where(F.col(URL) == url).agg(F.min(PV)).scalar()


def first_seen_rows(pageviews: DataFrame, url: str) -> DataFrame:
    """W17 per-row form: (session, url, time, min id) for each pageview of ``url``, by time."""
    return (pageviews.where(F.col(URL) == url)
            .groupBy(SESSION, URL, "created_at")
            .agg(F.min(PV).alias("min_pv_id"))
            .orderBy("created_at"))


def sessions_seeing(sessions: DataFrame, pageviews: DataFrame, url: str,
                    session_where: Column | None = None) -> DataFrame:
    """Filtered sessions that have at least one pageview of ``url`` (semi join on pre-deduplicated
    session ids, so a hot session ships one id per map task)."""
    seen = pageviews.where(F.col(URL) == url).select(SESSION).distinct()
    return apply_filter(sessions, session_where).join(seen, SESSION, "left_semi")


def last_seen_session(sessions: DataFrame, pageviews: DataFrame, url: str,
                      session_where: Column | None = None) -> DataFrame:
    """The highest session id in a segment that saw ``url``."""
    return sessions_seeing(sessions, pageviews, url, session_where).agg(
        F.max(SESSION).alias("most_recent_session_id"))


def last_seen_session_id(sessions: DataFrame, pageviews: DataFrame, url: str,
                         session_where: Column | None = None) -> Column:
    """W18 as a scalar subquery Column."""
    return sessions_seeing(sessions, pageviews, url, session_where).agg(
        F.max(SESSION)).scalar()
