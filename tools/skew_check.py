"""Empirical skew check: one session holds a third of all pageviews.

Builds a synthetic fixture in the commerce schema with Spark (no test data involved), runs the
session-keyed operators, and reads Spark's event log (written to a fresh scratch folder) to find,
for every shuffle-reading stage, the largest share of that stage's shuffled records read by a
single task. With pre-aggregation and bounded join keys no task should receive the hot session's
third of the rows. Writes a markdown table (default docs/SKEW.md).

Usage: python tools/skew_check.py [n_pageviews] [out.md]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def build(spark, n: int):
    from pyspark.sql import functions as F

    urls = ["/home", "/lander-1", "/products", "/the-original-mr-fuzzy",
            "/the-forever-love-bear", "/cart", "/shipping", "/billing", "/billing-2",
            "/thank-you-for-your-order"]
    url_arr = F.array(*[F.lit(u) for u in urls])
    ids = spark.range(n).select((F.col("id") + 1).alias("website_pageview_id"))
    sess = F.when(F.col("website_pageview_id") % 3 == 0, F.lit(1)).otherwise(
        F.col("website_pageview_id") % (n // 10) + 2)
    pageviews = ids.select(
        "website_pageview_id",
        (F.lit("2024-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(secs=F.col("website_pageview_id") % 2_000_000)).alias("created_at"),
        sess.alias("website_session_id"),
        F.element_at(url_arr, ((F.xxhash64("website_pageview_id") % len(urls) + len(urls))
                               % len(urls) + 1).cast("int")).alias("pageview_url"),
    )
    sessions = spark.range(1, n // 10 + 2).select(
        F.col("id").alias("website_session_id"),
        F.lit("2024-01-02").cast("timestamp_ntz").alias("created_at"),
        F.lit("gsearch").alias("utm_source"), F.lit("nonbrand").alias("utm_campaign"),
        F.lit("https://www.gsearch.com").alias("http_referer"), F.lit("desktop").alias("device_type"))
    orders = spark.range(n // 50).select(
        (F.col("id") + 1).alias("order_id"),
        F.lit("2024-01-03").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % (n // 10) + 2)
        .alias("website_session_id"),
        (F.col("id") % 4 + 1).alias("primary_product_id"), F.lit(1).alias("items_purchased"),
        F.lit(1000).cast("bigint").alias("price_cents"), F.lit(600).cast("bigint").alias("cogs_cents"))
    return sessions, pageviews, orders


def build_items(spark, n: int):
    """Order items where order 1 holds a third of all items, some refunded (a few twice)."""
    from pyspark.sql import functions as F

    ids = spark.range(n).select((F.col("id") + 1).alias("order_item_id"))
    order = F.when(F.col("order_item_id") % 3 == 0, F.lit(1)).otherwise(
        F.col("order_item_id") % (n // 4) + 2)
    items = ids.select(
        "order_item_id",
        (F.lit("1997-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(days=(F.col("order_item_id") % 700).cast("int"))).alias("created_at"),
        order.alias("order_id"),
        (F.col("order_item_id") % 4 + 1).alias("product_id"),
        F.when(F.col("order_item_id") % 5 == 1, 1).otherwise(0).alias("is_primary_item"),
        F.lit(1500).cast("bigint").alias("price_cents"))
    refunds = items.where(F.col("order_item_id") % 7 == 0).select(
        (F.col("order_item_id") * 10).alias("order_item_refund_id"), "order_item_id",
        "created_at", F.col("price_cents").alias("refund_cents"))
    refunds = refunds.unionByName(refunds.where(F.col("order_item_id") % 49 == 0).select(
        (F.col("order_item_refund_id") + 1).alias("order_item_refund_id"), "order_item_id",
        "created_at", "refund_cents"))
    store = spark.range(1, n // 4 + 2).select(
        F.col("id").alias("order_id"), F.lit("1997-06-01").cast("timestamp_ntz").alias("created_at"),
        (F.col("id") % 4 + 1).alias("primary_product_id"), F.lit(2).cast("bigint")
        .alias("items_purchased"), F.lit(3000).cast("bigint").alias("price_cents"),
        F.lit(1800).cast("bigint").alias("cogs_cents"))
    return items, refunds, store


def item_analyses(items, refunds, store):
    from trailmark.operators import products as R

    return {
        "cross-sell matrix (W38, hot order)": lambda: R.cross_sell_matrix(store, items),
        "item refund lookup (W41, hot order)": lambda: R.item_refund_lookup(items, refunds),
        "monthly refund rates (W42, hot order)": lambda: R.refund_rates(items, refunds),
        "product refund pivot (W42, hot order)": lambda: R.product_refund_rates(items, refunds),
    }


def analyses(sessions, pageviews, orders):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from trailmark import fixed_values as FV
    from trailmark.functions import ts
    from trailmark.operators import experiments as X
    from trailmark.operators import funnels as U
    from trailmark.operators import pages as P
    from trailmark.operators import products as R
    from trailmark.operators import traffic as T

    everything = F.col("created_at") >= ts("2024-01-01")
    return {
        "landing + bounce by landing page (W12/W15)": lambda: P.bounce_rate_by_landing_page(
            P.landing_page(pageviews, sessions, everything, with_pages=True)),
        "session step flags (W20)": lambda: U.session_made_it_flags(
            sessions, pageviews, [("a", FV.PRODUCTS), ("b", FV.CART)], everything,
            keep_sessions_without_pageviews=True),
        "multi-entry flags (W24)": lambda: U.multi_entry_flags(
            pageviews, {FV.MR_FUZZY: "mrfuzzy", FV.LOVE_BEAR: "lovebear"},
            [("cart", FV.CART), ("ship", FV.SHIPPING)]),
        "step discovery (W25)": lambda: U.funnel_step_discovery(pageviews, [FV.MR_FUZZY]),
        # id buckets scaled to this fixture: the default 2^20 ids would be a third of its whole
        # id range, whereas at 100 TB a bucket is a vanishing share of any stage
        "next page rows (W26, 2^14-id buckets)": lambda: U.next_page_rows(
            pageviews, FV.PRODUCTS, None, ts("2024-01-10"), id_bucket=1 << 14),
        "next page rows (W26, default 2^20-id buckets)": lambda: U.next_page_rows(
            pageviews, FV.PRODUCTS, None, ts("2024-01-10")),
        "billing test by page (W30)": lambda: X.billing_test_flags_by_page(
            sessions, pageviews, everything, None),
        "revenue per page session (W31)": lambda: X.revenue_per_page_session(
            pageviews, orders, None, [FV.BILLING, FV.BILLING_2]),
        "cart cross-sell (W39)": lambda: R.cart_cross_sell_performance(
            pageviews, orders, None, ts("2024-01-10")),
        "session order join (W01)": lambda: T.session_order_join(sessions, orders),
        # contrast, not used by the library: next page by a window over the whole session
        "contrast: lead() over the session window": lambda: pageviews.select(
            "website_session_id", F.lead("pageview_url").over(
                Window.partitionBy("website_session_id").orderBy("website_pageview_id"))
            .alias("next_url")),
    }


def parse(log_dir: str) -> dict[str, list[tuple[int, int, int]]]:
    """job group -> [(stage id, max task records, total records)] for shuffle-reading stages."""
    files = [f for f in glob.glob(f"{log_dir}/**", recursive=True)
             if os.path.isfile(f) and not os.path.basename(f).startswith("appstatus")]
    group_of_stage, tasks = {}, {}
    lines = (line for f in files for line in open(f))
    if True:
        for line in lines:
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    group_of_stage[sid] = group
            elif kind == "SparkListenerTaskEnd":
                m = ev.get("Task Metrics") or {}
                rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                if rec:
                    tasks.setdefault(ev["Stage ID"], []).append(rec)
    out: dict[str, list[tuple[int, int, int]]] = {}
    for sid, recs in tasks.items():
        g = group_of_stage.get(sid)
        if g:
            out.setdefault(g, []).append((sid, max(recs), sum(recs)))
    return out


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    out_path = sys.argv[2] if len(sys.argv) > 2 else "docs/SKEW.md"
    from pyspark.sql import SparkSession

    log_dir = tempfile.mkdtemp(prefix="run-skew-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").appName("trailmark-skew")
             .config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.rolling.enabled", "false")
             .config("spark.eventLog.compress", "false")
             .config("spark.sql.shuffle.partitions", "32")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
             .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1m")
             .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sessions, pageviews, orders = build(spark, n)
    base = tempfile.mkdtemp(prefix="run-skew-data-", dir="/tmp")
    for name, df in (("sessions", sessions), ("pageviews", pageviews), ("orders", orders)):
        df.repartition(16).write.parquet(f"{base}/{name}")
    sessions, pageviews, orders = (spark.read.parquet(f"{base}/{x}")
                                   for x in ("sessions", "pageviews", "orders"))
    items, refunds, store = build_items(spark, n)
    for name, df in (("items", items), ("refunds", refunds), ("store", store)):
        df.repartition(16).write.parquet(f"{base}/{name}")
    items, refunds, store = (spark.read.parquet(f"{base}/{x}")
                             for x in ("items", "refunds", "store"))
    todo = {**analyses(sessions, pageviews, orders), **item_analyses(items, refunds, store)}
    timings = {}
    for i, (name, build_df) in enumerate(todo.items()):
        spark.sparkContext.setJobGroup(f"q{i}", name)
        t0 = time.perf_counter()
        build_df().write.format("noop").mode("overwrite").save()
        timings[f"q{i}"] = (name, time.perf_counter() - t0)
    spark.stop()
    stats = parse(log_dir)
    lines = [
        "# Skew check",
        "",
        f"Generated by `tools/skew_check.py`: {n:,} synthetic pageviews of which one session holds "
        f"a third, and {n:,} order items of which one order holds a third, local[8], 32 shuffle partitions, broadcasts disabled (so every join shuffles), "
        "AQE on. For each analysis: the largest share of a shuffle stage's records read by one "
        "task, over all its shuffle-reading stages (1/32 ≈ 3% would be perfectly even; a task "
        "holding the hot session's raw rows would read ≥ 33%).",
        "",
        "| analysis | worst task share of a shuffle stage | shuffle stages | seconds |",
        "| --- | --- | --- | --- |",
    ]
    for g, (name, sec) in timings.items():
        st = [s for s in stats.get(g, []) if s[2] >= 1000]
        worst = max((m / t for _, m, t in st), default=0.0)
        lines.append(f"| {name} | {worst:.1%} | {len(st)} | {sec:.1f} |")
    os.makedirs(os.path.dirname(out_path) or ".", exist_ok=True)
    with open(out_path, "w") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()
