"""Next-page pathing: the bucketed join equals brute force and the lead() window form."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests import micro as M
from trailmark.operators import funnels as U


def _brute(rows, entries):
    by_session = {}
    for pid, _, sid, url in rows:
        by_session.setdefault(sid, []).append((pid, url))
    out = {}
    for (period, sid), eid in entries.items():
        later = sorted(p for p in by_session.get(sid, []) if p[0] > eid)
        out[(period, sid)] = later[0] if later else (None, None)
    return out


def _random_pageviews(seed: int):
    rnd = random.Random(seed)
    urls = ["/home", "/products", "/cart", "/shipping", "/the-original-mr-fuzzy"]
    rows, pid = [], 0
    for sid in range(1, 9):
        # one "hot" session with many pageviews spread over many id buckets
        n = 60 if sid == 3 else rnd.randint(0, 6)
        for _ in range(n):
            pid += rnd.randint(1, 3)
            rows.append((pid, "2024-01-10 10:00:00", sid, rnd.choice(urls)))
    return rows


def test_bucketed_next_pageview_matches_brute_force(spark):
    rows = _random_pageviews(7)
    pv = M.pageviews(spark, rows)
    rnd = random.Random(1)
    ent_rows = []
    for pid, _, sid, url in rows:
        if url == "/products":
            ent_rows.append((rnd.choice(["A", "B"]), sid, pid))
    entries = spark.createDataFrame(ent_rows, "time_period string, website_session_id long, "
                                              "entry_id long")
    first = {}
    for period, sid, pid in ent_rows:
        first[(period, sid)] = min(pid, first.get((period, sid), pid))
    expected = _brute(rows, first)
    for bucket in (2, 5, 1 << 20):
        got = {(r.time_period, r.website_session_id): (r.next_pageview_id, r.next_pageview_url)
               for r in U.next_pageview(pv, entries, id_bucket=bucket).collect()}
        assert got == expected, bucket


def test_first_next_pages_match_brute_force(spark):
    for seed in (7, 8, 9):
        rnd = random.Random(seed)
        rows = [(pid, rnd.choice(["2024-01-10 10:00:00", "2024-01-20 10:00:00"]), None if sid == 5 else sid, url)
                for pid, _, sid, url in _random_pageviews(seed)]
        cut = F.lit("2024-01-15").cast("timestamp_ntz")
        first, by_session = {}, {}
        for pid, at, sid, url in rows:
            by_session.setdefault(sid, []).append((pid, url))
            if url == "/products":
                key = ("A" if at < "2024-01-15" else "B", sid)
                first[key] = min(pid, first.get(key, pid))
        want = {(p, sid): min((x for x in by_session[sid] if sid is not None and x[0] > e), default=(None, None)) for (p, sid), e in first.items()}
        pv = M.pageviews(spark, rows)
        for bucket in (1, 2, 5, 1 << 20):
            found = U.first_next_pages(pv, F.col("pageview_url") == "/products", U.period_label(F.col("created_at"), cut, "A", "B", "none"),
                                       ["A", "B", "none"], id_bucket=bucket).collect()
            got = {(r.time_period, r.website_session_id): (r.next_pageview_id, r.next_pageview_url) for r in found}
            assert got == want and len(found) == len(got), (seed, bucket)


def test_next_page_rows_equals_lead_form(spark, small_dir):
    from trailmark.plans import q_funnels as Q
    from trailmark.sources import CommerceData

    d = CommerceData(spark, small_dir)
    ours = {tuple(r) for r in Q.next_page_rows(d).collect()}
    # window form: lead over the session, then the first entry's next page per (period, session)
    pv = d.pageviews
    w = Window.partitionBy("website_session_id").orderBy("website_pageview_id")
    led = pv.select("*", F.lead("pageview_url").over(w).alias("nxt"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    ent = led.where((F.col("pageview_url") == "/products")
                    & (F.col("created_at") < F.lit(Q.PATH_END).cast("timestamp_ntz"))
                    & (F.col("created_at") > F.lit(Q.PATH_START).cast("timestamp_ntz")))
    ent = ent.select(U.period_label(F.col("created_at"), cut, "A. Pre_Product_2",
                                    "B. Post_Product_2", "check logic").alias("time_period"),
                     "website_session_id", "website_pageview_id", "nxt")
    lead_form = ent.groupBy("time_period", "website_session_id").agg(
        F.min_by("nxt", "website_pageview_id").alias("next_pageview_url"))
    assert ours == {tuple(r) for r in lead_form.collect()}
