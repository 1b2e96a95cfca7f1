"""Reports over tables materialised once in the checkpoint folder equal reports over the raw data."""

import os

from trailmark.plans import registry
from trailmark.plans.runner import materialize, run_reports
from trailmark.sources import CommerceData


def test_materialized_tables_give_same_reports(spark, small_dir, tmp_path):
    data = CommerceData(spark, small_dir)
    stored = materialize(spark, data)
    assert stored.base.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    keys = ["next_page_pathing", "billing_test_flags", "cart_cross_sell_performance",
            "product_refund_rates", "bounce_rate_weekly", "incremental_orders"]
    out = run_reports(stored, keys, out_dir=str(tmp_path))
    for k in keys:
        expected = sorted(map(tuple, registry.REGISTRY[k].build(data).collect()))
        assert sorted(map(tuple, out[k].collect())) == expected, k
        written = spark.read.parquet(f"{tmp_path}/{k}")
        assert sorted(map(tuple, written.collect())) == expected, k


def test_bucketed_tables_remove_session_shuffles(spark, small_dir):
    registry._load_all()
    data = CommerceData(spark, small_dir)
    plain = materialize(spark, data)
    bucketed = materialize(spark, data, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def exchanges(d):
            df = registry.REGISTRY["first_pageview_of_sessions"].build(d)
            plan = df._jdf.queryExecution().executedPlan().toString()
            return sorted(map(tuple, df.collect())), plan.count("Exchange hashpartitioning")

        rows_plain, ex_plain = exchanges(plain)
        rows_bucketed, ex_bucketed = exchanges(bucketed)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows_bucketed == rows_plain
    assert ex_bucketed < ex_plain
    names = list(bucketed.tables.values())
    for d in (plain, bucketed):
        d.drop()
        assert not os.path.exists(d.base.removeprefix("file:"))
    assert not any(spark.catalog.tableExists(n) for n in names)
