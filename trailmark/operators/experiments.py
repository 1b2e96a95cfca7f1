"""Experiments and period comparisons.

Several original statements sum order revenue over ``pageview ⟕ order`` rows, so a session with
two billing pageviews or two orders is counted more than once (fan-out). The faithful results are
reproduced *without* materialising the fan-out: the multiplicity of each session is computed from
per-session counts (pageviews per (session, url), urls per session, orders per session) and the
sums are weighted by it. Every join is one row per session on at least one side, so the plans stay
linear and skew-tolerant while the numbers equal the row-multiplying originals. Session-grain
variants (one row per session and url) are offered next to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark import fixed_values as FV
from trailmark.functions import big, dollars, idiv, pct_round2, ratio_pct
from trailmark.operators.common import (
    SESSION,
    apply_filter,
    money_ratio,
    orders_per_session,
    sessions_with_orders,
)
from trailmark.operators.funnels import period_label, session_made_it_flags

PV = "website_pageview_id"
URL = "pageview_url"


def _bounded(pageviews: DataFrame, where: Column | None, min_pv_id: Column | int | None,
             urls: Sequence[str] | None) -> DataFrame:
    pv = apply_filter(pageviews, where)
    if min_pv_id is not None:
        bound = F.lit(min_pv_id) if isinstance(min_pv_id, int) else min_pv_id
        pv = pv.where(F.col(PV) >= bound)
    if urls is not None:
        pv = pv.where(F.col(URL).isin(list(urls)))
    return pv


# ---- W27 ----------------------------------------------------------------------------------------

def landing_test_conversion(landing: DataFrame, orders: DataFrame) -> DataFrame:
    """Per landing page, sessions, orders and conversion % rounded to 2 places."""
    j = sessions_with_orders(landing, orders)
    out = j.groupBy("landing_page").agg(F.count(F.lit(1)).alias("sessions"),
                                        F.sum("n_orders").cast("bigint").alias("orders"))
    return out.withColumn("conv_rate", pct_round2("orders", "sessions"))


# ---- W28 ----------------------------------------------------------------------------------------

def incremental_orders(sessions: DataFrame, where: Column | None, after_session_id: Column | int,
                       lift: str = FV.INCREMENTAL_LIFT) -> DataFrame:
    """Sessions of a segment after a session id, times a conversion lift."""
    bound = F.lit(after_session_id) if isinstance(after_session_id, int) else after_session_id
    n = apply_filter(sessions, where).where(F.col(SESSION) > bound).agg(
        F.count(SESSION).alias("session_since_test"))
    scale = len(lift.split(".")[1]) if "." in lift else 0
    lift_col = F.lit(lift).cast(f"decimal({max(scale, 1) + 1},{scale})")
    return n.select("session_since_test",
                    (F.col("session_since_test") * lift_col).cast("double")
                    .alias("incremental_orders"))


# ---- W29 / W30 ----------------------------------------------------------------------------------

def billing_test_rows(pageviews: DataFrame, orders: DataFrame, where: Column | None,
                      min_pv_id: Column | int | None, urls: Sequence[str]) -> DataFrame:
    """W29 row level: (session, billing page seen, order id) for each pageview ⟕ order row."""
    pv = _bounded(pageviews, where, min_pv_id, urls).select(
        SESSION, F.col(URL).alias("billing_version_seen"))
    o = orders.select(SESSION, "order_id").where(F.col(SESSION).isNotNull())
    # matched rows and rows without an order: adaptive execution can split a hot session on either
    # side of the inner part, and the other part meets one id per session
    matched = pv.join(o, SESSION, "inner")
    unmatched = pv.join(o.select(SESSION).distinct(), SESSION, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def billing_test_conversion(pageviews: DataFrame, orders: DataFrame, where: Column | None,
                            min_pv_id: Column | int | None, urls: Sequence[str]) -> DataFrame:
    """Per billing page, distinct sessions, distinct orders and orders per session (%).

    (url, session) pairs are de-duplicated map-side, then joined to per-session order counts.
    """
    seen = _bounded(pageviews, where, min_pv_id, urls).select(
        F.col(URL).alias("billing_version_seen"), SESSION).distinct()
    j = seen.join(orders_per_session(orders), SESSION, "left")
    out = j.groupBy("billing_version_seen").agg(
        F.count(SESSION).alias("sessions"),
        F.coalesce(F.sum("n_orders"), F.lit(0)).cast("bigint").alias("orders"))
    return out.withColumn("billing_to_order_rt", ratio_pct("orders", "sessions"))


def billing_test_flags(sessions: DataFrame, pageviews: DataFrame, orders: DataFrame,
                       session_where: Column | None, min_pv_id: Column | int | None,
                       old_url: str = FV.BILLING, new_url: str = FV.BILLING_2,
                       order_url: str = FV.THANK_YOU) -> DataFrame:
    """W30, first attempt: one row of two conversion rates from session flags joined wide.

    The original joins the session flags to two flag tables, each already multiplied by the
    session's orders (a left join to orders that selects no order column), so the denominators
    count m_old * max(1, m_new) rows per session, where m = max(1, orders) when the page was
    seen, else 0. Those weights are computed here from per-session counts.
    """
    steps = [("billing1", old_url), ("billing2", new_url), ("ordered", order_url)]
    pv_where = F.col(URL).isin(old_url, new_url, order_url)
    if min_pv_id is not None:
        bound = F.lit(min_pv_id) if isinstance(min_pv_id, int) else min_pv_id
        pv_where = pv_where & (F.col(PV) >= bound)
    flags = session_made_it_flags(sessions, pageviews, steps, session_where, pv_where)
    j = flags.join(orders_per_session(orders).select(SESSION, "n_orders"), SESSION, "left")
    n = big(F.greatest(F.coalesce(F.col("n_orders"), F.lit(0)), F.lit(1)))
    m1 = F.when(F.col("billing1") == 1, n).otherwise(0)
    m2 = F.when(F.col("billing2") == 1, n).otherwise(0)
    agg = j.agg(
        F.count(F.when((F.col("billing1") == 1) & (F.col("ordered") == 1), 1)).alias("og_num"),
        F.sum(m1 * F.greatest(m2, F.lit(1))).alias("og_den"),
        F.count(F.when((F.col("billing2") == 1) & (F.col("ordered") == 1), 1)).alias("new_num"),
        F.sum(m2 * F.greatest(m1, F.lit(1))).alias("new_den"),
    )
    return agg.select(
        ratio_pct("og_num", "og_den").alias("og_billing_orders_conv_rt"),
        ratio_pct("new_num", "new_den").alias("new_billing_orders_conv_rt"),
    )


def billing_test_flags_by_page(sessions: DataFrame, pageviews: DataFrame,
                               session_where: Column | None, min_pv_id: Column | int | None,
                               urls: Sequence[str] = (FV.BILLING_2, FV.BILLING)) -> DataFrame:
    """W30, second attempt: per billing page, "sessions" and "orders" as the original counts them.

    Its billing rows (one per pageview) are joined to a per-(session, page) order table on the
    session only, so each row repeats once per billing page of its session, and the order table
    always matches: orders equal sessions (its filter on the order flag is commented out). With
    c = pageviews of (session, page) and k = billing pages of the session, both counts are
    sum(c * k).
    """
    keep = apply_filter(sessions, session_where).select(SESSION)
    counts = [F.count(F.when(F.col(URL) == u, 1)).alias(f"_c{i}") for i, u in enumerate(urls)]
    per_session = (_bounded(pageviews, None, min_pv_id, urls).groupBy(SESSION).agg(*counts)
                   .join(keep, SESSION, "left_semi"))
    k = big(sum((F.when(F.col(f"_c{i}") > 0, 1).otherwise(0) for i in range(1, len(urls))),
                F.when(F.col("_c0") > 0, 1).otherwise(0)))
    one = per_session.agg(*[F.sum(big(F.col(f"_c{i}")) * k).alias(f"_s{i}") for i in range(len(urls))])
    pages = F.array(*[F.struct(F.lit(u).alias("billing_version_seen"),
                               F.col(f"_s{i}").cast("bigint").alias("sessions"))
                      for i, u in enumerate(urls)])
    out = one.select(F.explode(pages).alias("p")).select("p.*").where("sessions > 0")
    return out.select("billing_version_seen", "sessions", F.col("sessions").alias("orders"),
                      ratio_pct("sessions", "sessions").alias("billing_to_order_rt"))


# ---- W31 / W32 / W33 ----------------------------------------------------------------------------

def _page_session_revenue(pageviews: DataFrame, orders: DataFrame, where: Column | None,
                          urls: Sequence[str]) -> DataFrame:
    per_page = _bounded(pageviews, where, None, urls).groupBy(URL, SESSION).agg(
        F.count(F.lit(1)).alias("c"))
    return per_page.join(orders_per_session(orders).select(SESSION, "revenue_cents"), SESSION,
                         "left")


def revenue_per_page_session_cents(pageviews: DataFrame, orders: DataFrame,
                                   where: Column | None, urls: Sequence[str],
                                   session_grain: bool = False) -> DataFrame:
    """(billing_version_seen, sessions, rps_cents): revenue per page session in whole cents,
    rounded half up. Faithful form: revenue summed over pageview x order rows."""
    j = _page_session_revenue(pageviews, orders, where, urls)
    weight = F.lit(1) if session_grain else F.col("c")
    out = j.groupBy(F.col(URL).alias("billing_version_seen")).agg(
        F.count(SESSION).alias("sessions"),
        F.sum(big(weight) * big(F.col("revenue_cents"))).alias("revenue_cents"))
    rps = F.when(F.col("sessions") == 0, F.lit(None)).otherwise(
        idiv(F.col("revenue_cents") * 2 + F.col("sessions"), F.col("sessions") * 2))
    return out.select("billing_version_seen", "sessions", rps.alias("rps_cents"))


def revenue_per_page_session(pageviews: DataFrame, orders: DataFrame, where: Column | None,
                             urls: Sequence[str], session_grain: bool = False) -> DataFrame:
    """Per billing page, sessions and revenue per page session (round 2).

    ``session_grain=False`` reproduces the original's fan-out (each billing pageview repeats the
    session's order revenue); ``True`` counts each session's revenue once per page.
    """
    out = revenue_per_page_session_cents(pageviews, orders, where, urls, session_grain)
    return out.select("billing_version_seen", "sessions",
                      dollars("rps_cents").alias("revenue_per_billing_page_seen"))


def page_session_volume(pageviews: DataFrame, urls: Sequence[str],
                        where: Column | None = None) -> DataFrame:
    """Pageview rows on the given urls (the original counts rows, not distinct sessions)."""
    return _bounded(pageviews, where, None, urls).agg(
        F.count(SESSION).alias("billing_sessions_past_month"))


def test_lift_value(rps_cents: DataFrame, volume: DataFrame, old_url: str,
                    new_url: str) -> DataFrame:
    """Lift of the new page's revenue per session over the old one, times a session volume.

    The two one-row inputs are stacked and folded in one tiny global aggregate (no cross join).
    """
    url = F.col("billing_version_seen")
    a = rps_cents.select(F.when(url == old_url, F.col("rps_cents")).alias("old_c"),
                         F.when(url == new_url, F.col("rps_cents")).alias("new_c"),
                         F.lit(None).cast("bigint").alias("vol"))
    b = volume.select(F.lit(None).cast("bigint").alias("old_c"),
                      F.lit(None).cast("bigint").alias("new_c"),
                      F.col("billing_sessions_past_month").cast("bigint").alias("vol"))
    one = a.unionByName(b).agg(F.max("old_c").alias("old_c"), F.max("new_c").alias("new_c"),
                               F.max("vol").alias("vol"))
    lift = F.col("new_c") - F.col("old_c")
    return one.select(dollars("old_c").alias("old_rps"), dollars("new_c").alias("new_rps"),
                      dollars(lift).alias("lift"), F.col("vol").alias("billing_sessions"),
                      dollars(lift * F.col("vol")).alias("test_value"))


# ---- W34 ----------------------------------------------------------------------------------------

def pre_post_comparison(sessions: DataFrame, orders: DataFrame, where: Column | None,
                        cut: Column, labels: tuple[str, str, str] = (
                            FV.PRE_BIRTHDAY_BEAR, FV.POST_BIRTHDAY_BEAR,
                            FV.PERIOD_SENTINEL)) -> DataFrame:
    """Per period around a launch, sessions, orders, conversion %, revenue, items sold,
    average order value two ways, items per order and revenue per session."""
    s = sessions_with_orders(apply_filter(sessions, where), orders)
    g = s.groupBy(period_label(F.col("created_at"), cut, *labels).alias("time_period")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("n_orders").cast("bigint").alias("orders"),
        F.sum("n_priced").cast("bigint").alias("_priced"),
        F.sum("revenue_cents").alias("_cents"),
        F.sum("items").cast("bigint").alias("total_products_sold"),
    )
    return g.select(
        "time_period", "sessions", "orders",
        pct_round2("orders", "sessions").alias("conv_rt"),
        dollars("_cents").alias("total_revenue"),
        "total_products_sold",
        money_ratio("_cents", "orders").alias("avg_order_value"),
        money_ratio("_cents", "_priced").alias("aov"),
        F.try_divide(F.col("total_products_sold").cast("double"), F.col("orders"))
        .alias("products_per_order"),
        money_ratio("_cents", "sessions").alias("revenue_per_session"),
    )
