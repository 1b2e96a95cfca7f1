"""Funnels and pathing.

Session-grain step flags are ``max`` aggregates over the pageviews of a session (partial
aggregation, one shuffle by session id). Everything "after the entry page" avoids the original's
range self-join (quadratic in pageviews per session) and avoids a per-session window (a hot session
would be one task):

* a step is reached after an entry iff ``max(id of the step url) > min(id of the entry url)`` in
  the session: ids from one partial aggregate;
* the next page after an entry is found in windows over (session, id bucket), so that no key holds
  more than a bucket of pageviews however large the session, and then among the first pageviews of
  the session's buckets (``first_next_pages``; ``next_pageview`` for entries from another table).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark import fixed_values as FV
from trailmark.functions import pct_round2, ratio_pct
from trailmark.operators.common import SESSION, apply_filter

PV = "website_pageview_id"
URL = "pageview_url"

Steps = Sequence[tuple[str, str]]  # (flag column name, url)


def _session_filter(pageviews: DataFrame, sessions: DataFrame | None,
                    session_where: Column | None) -> DataFrame:
    if sessions is None:
        return pageviews
    keep = apply_filter(sessions, session_where).select(SESSION)
    return pageviews.join(keep, SESSION, "left_semi")


# ---- W19 / W20 ----------------------------------------------------------------------------------

def page_step_flags(sessions: DataFrame, pageviews: DataFrame, steps: Steps,
                    session_where: Column | None = None,
                    pageview_where: Column | None = None) -> DataFrame:
    """Pageview grain, one 0/1 column per step url, for pageviews passing the filters."""
    pv = _session_filter(apply_filter(pageviews, pageview_where), sessions, session_where)
    flags = [F.when(F.col(URL) == url, 1).otherwise(0).alias(name) for name, url in steps]
    return pv.select(SESSION, URL, F.col("created_at").alias("pageview_created_at"), *flags)


def session_made_it_flags(sessions: DataFrame, pageviews: DataFrame, steps: Steps,
                          session_where: Column | None = None,
                          pageview_where: Column | None = None,
                          keep_sessions_without_pageviews: bool = False) -> DataFrame:
    """Session grain, ``max`` of each step flag.

    Pageviews are reduced per session first; filtered sessions are then joined one-to-one. With
    ``keep_sessions_without_pageviews`` (the original's left join with no pageview filter) a
    session without any pageview is kept with all flags 0.
    """
    pv = apply_filter(pageviews, pageview_where)
    per_session = pv.groupBy(SESSION).agg(*[
        F.max(F.when(F.col(URL) == url, 1).otherwise(0)).alias(name) for name, url in steps])
    s = apply_filter(sessions, session_where).select(SESSION)
    if keep_sessions_without_pageviews:
        out = s.join(per_session, SESSION, "left")
        return out.select(SESSION, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n, _ in steps])
    return s.join(per_session, SESSION, "inner")


# ---- W21 / W22 / W23 ----------------------------------------------------------------------------

def funnel_counts(flags: DataFrame, flag_cols: Sequence[str], count_names: Sequence[str],
                  sessions_name: str = "sessions") -> DataFrame:
    """Sessions, then sessions that reached each step (flags are session grain)."""
    aggs = [F.count(SESSION).alias(sessions_name)]
    aggs += [_sessions_with(f).alias(n) for f, n in zip(flag_cols, count_names)]
    return flags.agg(*aggs)


def _sessions_with(flag: str) -> Column:
    """Sessions with the flag; rows without a session id are no sessions."""
    return F.count(F.when(F.col(flag) == 1, F.col(SESSION)))


def funnel_click_rates(flags: DataFrame, flag_cols: Sequence[str], rate_names: Sequence[str],
                       denominator: str = "previous", segment: Column | None = None,
                       rounded: bool = False, count_names: Sequence[str] | None = None,
                       sessions_name: str | None = "sessions") -> DataFrame:
    """Click rate of each step, over the previous step or over all sessions.

    ``denominator='previous'``: step k over step k-1 (the first step over all sessions).
    ``denominator='all'``: every step over all sessions. ``segment`` groups the rates (e.g. by
    landing page seen). ``rounded`` gives round(.., 2) percentages, else unrounded ones.
    ``count_names`` interleaves each step's count before its rate; ``sessions_name=None`` drops
    the sessions column. NULL where a denominator is 0.
    """
    if denominator not in ("previous", "all"):
        raise ValueError("denominator must be 'previous' or 'all'")
    aggs = [F.count(SESSION).alias("_n0")]
    aggs += [_sessions_with(f).alias(f"_n{i + 1}") for i, f in enumerate(flag_cols)]
    grouped = flags.groupBy(segment.alias("segment")) if segment is not None else flags
    agg = grouped.agg(*aggs)
    rate = pct_round2 if rounded else ratio_pct
    cols: list[Column] = [F.col("segment")] if segment is not None else []
    if sessions_name:
        cols.append(F.col("_n0").alias(sessions_name))
    for i, name in enumerate(rate_names):
        if count_names:
            cols.append(F.col(f"_n{i + 1}").alias(count_names[i]))
        den = f"_n{i}" if denominator == "previous" else "_n0"
        cols.append(rate(f"_n{i + 1}", den).alias(name))
    return agg.select(*cols)


def funnel_report(flags: DataFrame, flag_cols: Sequence[str], count_names: Sequence[str],
                  sessions_name: str = "sessions") -> DataFrame:
    """A count row stacked over a step-over-step rate row, named by the count row.

    Both rows come from one aggregate row (no second pass): the row is exploded into two.
    """
    aggs = [F.count(SESSION).alias("_n0")]
    aggs += [_sessions_with(f).alias(f"_n{i + 1}") for i, f in enumerate(flag_cols)]
    row = flags.agg(*aggs)
    names = [sessions_name, *count_names]
    counts = F.struct(F.col("_n0").alias(names[0]),
                      *[F.col(f"_n{i + 1}").cast("double").alias(n)
                        for i, n in enumerate(count_names)])
    rates = F.struct(F.col("_n0").alias(names[0]),
                     *[ratio_pct(f"_n{i + 1}", f"_n{i}").alias(n)
                       for i, n in enumerate(count_names)])
    return row.select(F.explode(F.array(counts, rates)).alias("r")).select("r.*")


def landing_segment(home_flag: str = "saw_homepage", lander_flag: str = "saw_custom_lander",
                    home_label: str = FV.SAW_HOMEPAGE, lander_label: str = FV.SAW_CUSTOM_LANDER,
                    other_label: str = FV.SEGMENT_SENTINEL) -> Column:
    """First matching branch wins: a session that saw both landers is a home session."""
    return (F.when(F.col(home_flag) == 1, home_label)
            .when(F.col(lander_flag) == 1, lander_label)
            .otherwise(other_label))


# ---- W24 / W25 ----------------------------------------------------------------------------------

def multi_entry_flags(pageviews: DataFrame, entries: dict[str, str], steps: Steps,
                      where: Column | None = None,
                      other_label: str = FV.PRODUCT_SENTINEL) -> DataFrame:
    """W24 session level: per (session, entry page seen), whether each step url was viewed
    *after* that entry page (any later pageview of the session, no date filter on it).

    ``entries`` maps entry url -> label. Flag = max(id of step url) > min(id of the entry url).
    One aggregate per session, of ids only, holds all of them; a session then gives a row per
    entry page it saw. Pageviews without a session id belong to no session: they keep their entry
    row, with no step reached.
    """
    entry = F.lit(True) if where is None else where
    step_urls = [u for _, u in steps]
    per_session = (pageviews.where(F.col(URL).isin([*entries, *step_urls])).groupBy(SESSION).agg(
        *[F.min(F.when((F.col(URL) == u) & entry, F.col(PV))).alias(f"_entry{i}")
          for i, u in enumerate(entries)],
        *[F.max(F.when(F.col(URL) == u, F.col(PV))).alias(f"_last{i}")
          for i, u in enumerate(step_urls)]))
    seen = F.array(*[F.struct(F.col(f"_entry{i}").alias("entry_id"), F.lit(label).alias("product_seen"))
                     for i, label in enumerate(entries.values())])
    rows = per_session.withColumn("_e", F.explode(seen)).where("_e.entry_id is not null")
    flags = [F.when(F.col(SESSION).isNotNull() & (F.col(f"_last{i}") > F.col("_e.entry_id")), 1)
             .otherwise(0).alias(name) for i, (name, _) in enumerate(steps)]
    return rows.select(SESSION, "_e.product_seen", *flags)


def multi_entry_counts(flags: DataFrame, flag_cols: Sequence[str],
                       count_names: Sequence[str]) -> DataFrame:
    """W24 counts: per entry page seen, sessions and sessions reaching each step."""
    aggs = [F.count(SESSION).alias("sessions")]
    aggs += [_sessions_with(f).alias(n) for f, n in zip(flag_cols, count_names)]
    return flags.groupBy("product_seen").agg(*aggs)


def multi_entry_click_rates(flags: DataFrame, flag_cols: Sequence[str],
                            rate_names: Sequence[str]) -> DataFrame:
    """W24 click rates: per entry page seen, step-over-step percentages rounded to 2 places."""
    out = funnel_click_rates(flags, flag_cols, rate_names, "previous", F.col("product_seen"),
                             rounded=True, sessions_name=None)
    return out.withColumnRenamed("segment", "product_seen")


def funnel_step_discovery(pageviews: DataFrame, entry_urls: Sequence[str],
                          where: Column | None = None) -> DataFrame:
    """Distinct urls viewed after an entry pageview; NULL is one of them when some entry
    pageview is the last pageview of its session (the original's left join finds no later row).

    A url was viewed after some entry of a session iff its last id there exceeds the session's
    first entry id. One (session, url) aggregate holds last ids and entry bounds; bounds of the
    session are windowed over its rows (one per distinct url). An entry without a session id has
    no later row.
    """
    entry = F.col(URL).isin(list(entry_urls))
    if where is not None:
        entry = entry & where
    by_url = pageviews.groupBy(SESSION, URL).agg(
        F.max(PV).alias("last_id"), F.min(F.when(entry, F.col(PV))).alias("_first"),
        F.max(F.when(entry, F.col(PV))).alias("_last"))
    of_session = Window.partitionBy(SESSION)
    r = by_url.select(SESSION, URL, "last_id", F.min("_first").over(of_session).alias("first_entry"),
                      F.max("_last").over(of_session).alias("last_entry"),
                      F.max("last_id").over(of_session).alias("last_pv")).where("first_entry is not null")
    known = F.col(SESSION).isNotNull()
    later = F.when(known & (F.col("last_id") > F.col("first_entry")), F.struct(F.col(URL).alias(URL)))
    none = F.when(~known | (F.col("last_entry") >= F.col("last_pv")),
                  F.struct(F.lit(None).cast("string").alias(URL)))
    found = r.select(F.explode(F.array_compact(F.array(later, none))).alias("u"))
    return found.select(f"u.{URL}").distinct()


# ---- W26 ----------------------------------------------------------------------------------------

def period_label(c: Column, cut: Column, before: str, after: str, other: str) -> Column:
    """'before' label for c < cut, 'after' for c >= cut, 'other' only for NULL c."""
    return F.when(c < cut, before).when(c >= cut, after).otherwise(other)


ID_BUCKET = 1 << 20


def next_pageview(pageviews: DataFrame, entries: DataFrame,
                  keys: Sequence[str] = ("time_period", SESSION),
                  id_bucket: int = ID_BUCKET) -> DataFrame:
    """First pageview after the first entry of each key group: ``entries`` has ``keys`` and
    ``entry_id``; returns ``keys`` + next_pageview_id, next_pageview_url (NULL when none).

    Exact and skew-proof without a window or a per-session range join: pageview ids are unique,
    so bucketing them (``id div id_bucket``) bounds every join key.
    * within the entry's bucket: pageviews ⋈ entries on (session, bucket), ``id > entry_id``;
      a key holds at most ``id_bucket`` pageviews, however large the session;
    * in later buckets: the session's first pageview id of each bucket (a partial aggregate) ⋈
      entries on session, ``bucket > entry bucket``; a key holds one row per bucket spanned.
    All aggregates carry ids only (fixed-width, hash-based); the winning id's url is fetched by
    one more join on (session, bucket), whose pageview side is the same exchange as the
    within-bucket join's.
    """
    div = lambda c: F.call_function("div", c, F.lit(id_bucket))
    first = entries.groupBy(*keys).agg(F.min("entry_id").alias("entry_id"))
    fb = first.withColumn("_b", div(F.col("entry_id")))
    # no next page lies before the first entry of all: an exact floor that reaches the scan
    floor = entries.agg(F.min("entry_id")).scalar()
    pv = pageviews.where(F.col(PV) > floor).select(
        SESSION, F.col(PV).alias("_id"), F.col(URL).alias("_url"), div(F.col(PV)).alias("_b"))
    within = (pv.join(fb, [SESSION, "_b"], "inner")
              .where(F.col("_id") > F.col("entry_id"))
              .groupBy(*keys).agg(F.min("_id").alias("_next")))
    heads = pv.groupBy(SESSION, "_b").agg(F.min("_id").alias("_head"))
    later = (heads.join(fb.withColumnRenamed("_b", "_eb"), SESSION, "inner")
             .where(F.col("_b") > F.col("_eb"))
             .groupBy(*keys).agg(F.min("_head").alias("_next")))
    # every key group, also one without a later pageview
    groups = first.select(*keys, F.lit(None).cast("long").alias("_next"))
    nxt = (later.unionByName(within).unionByName(groups).groupBy(*keys)
           .agg(F.min("_next").alias("_next")).withColumn("_b", div(F.col("_next"))))
    with_url = (nxt.where("_next is not null").join(pv, [SESSION, "_b"], "inner")
                .where(F.col("_id") == F.col("_next"))
                .select(*keys, F.col("_next").alias("next_pageview_id"),
                        F.col("_url").alias("next_pageview_url")))
    without = nxt.where("_next is null").select(
        *keys, F.col("_next").alias("next_pageview_id"), F.lit(None).cast("string").alias("next_pageview_url"))
    return with_url.unionByName(without)


def first_next_pages(pageviews: DataFrame, entry: Column, period: Column, labels: Sequence[str],
                     id_bucket: int = ID_BUCKET) -> DataFrame:
    """As ``next_pageview`` for entries that are pageviews themselves: those where ``entry`` holds, in the
    period (one of ``labels``) that ``period`` tells. One scan and two exchanges.

    * By (session, id bucket), at most ``id_bucket`` rows a key: ``lead`` gives each pageview the one after it
      in the bucket. Only the first pageview of the bucket and the first entry of each period go on.
    * By session, at most one row a bucket and label more: an entry that ends its bucket takes the first
      pageview of the next bucket; the first entry of each period is the answer.
    """
    rows = pageviews.select(SESSION, F.col(PV).alias("_id"), F.col(URL).alias("_url"), F.when(entry, period).alias("_period"),
                            F.call_function("div", F.col(PV), F.lit(id_bucket)).alias("_b"))

    def first_entries(key: Sequence[str]) -> Column:
        """Whether a row is the first entry of its period among the rows of ``key``."""
        group = Window.partitionBy(*key)
        first = [F.col("_id") == F.min(F.when(F.col("_period") == label, F.col("_id"))).over(group) for label in labels]
        return F.coalesce(reduce(lambda a, b: a | b, [(F.col("_period") == label) & f for label, f in zip(labels, first)]), F.lit(False))

    bucket = Window.partitionBy(SESSION, "_b").orderBy("_id")
    near = rows.select(
        "*", F.lead("_id").over(bucket).alias("_next"), F.lead("_url").over(bucket).alias("_next_url"),
        F.lag("_id").over(bucket).isNull().alias("_head"), first_entries([SESSION, "_b"]).alias("_first"))
    # from the last row to the first, the last head seen is the first one after a row
    after = Window.partitionBy(SESSION).orderBy(F.desc("_id")).rowsBetween(Window.unboundedPreceding, -1)
    far = near.where("_head or _first").select(
        "*", F.last(F.when(F.col("_head"), F.struct("_id", "_url")), ignorenulls=True).over(after).alias("_after"),
        first_entries([SESSION]).alias("_answer"))
    known, here = F.col(SESSION).isNotNull(), F.col("_next").isNotNull()
    return far.where("_first and _answer").select(
        F.col("_period").alias("time_period"), SESSION,
        F.when(known, F.coalesce("_next", "_after._id")).alias("next_pageview_id"),
        F.when(known, F.when(here, F.col("_next_url")).otherwise(F.col("_after._url"))).alias("next_pageview_url"))


def next_page_rows(pageviews: DataFrame, entry_url: str, where: Column | None, cut: Column,
                   labels: tuple[str, str, str] = (FV.PRE_PRODUCT_2, FV.POST_PRODUCT_2,
                                                   FV.PRODUCT_SENTINEL),
                   id_bucket: int = ID_BUCKET) -> DataFrame:
    """W26 rows: (time_period, website_session_id, next_pageview_url) per period and session
    with an ``entry_url`` pageview passing ``where``."""
    entry = F.col(URL) == entry_url
    if where is not None:
        entry = entry & where
    found = first_next_pages(pageviews, entry, period_label(F.col("created_at"), cut, *labels), labels, id_bucket)
    return found.select("time_period", SESSION, "next_pageview_url")


def next_page_pathing(pageviews: DataFrame, entry_url: str, where: Column | None, cut: Column,
                      targets: dict[str, str],
                      labels: tuple[str, str, str] = (FV.PRE_PRODUCT_2, FV.POST_PRODUCT_2,
                                                      FV.PRODUCT_SENTINEL),
                      id_bucket: int = ID_BUCKET) -> DataFrame:
    """Per period, sessions, share with any next page, and count and share per target url
    (``targets`` maps a column stem, e.g. 'mrfuzzy', to its url)."""
    rows = next_page_rows(pageviews, entry_url, where, cut, labels, id_bucket)
    nxt = F.col("next_pageview_url")
    aggs = [F.count(SESSION).alias("sessions"),
            F.count(F.when(nxt.isNotNull(), F.col(SESSION))).alias("w_next_pg")]
    aggs += [F.count(F.when(nxt == url, F.col(SESSION))).alias(f"to_{stem}")
             for stem, url in targets.items()]
    agg = rows.groupBy("time_period").agg(*aggs)
    cols = ["time_period", "sessions", "w_next_pg",
            pct_round2("w_next_pg", "sessions").alias("pct_w_next_pg")]
    for stem in targets:
        cols += [f"to_{stem}", pct_round2(f"to_{stem}", "sessions").alias(f"pct_to_{stem}")]
    return agg.select(*cols)
