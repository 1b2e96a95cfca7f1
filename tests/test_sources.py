"""The original five tables read from files give the same analyses as the derived test data."""

import pytest
from pyspark.sql import functions as F

from trailmark.plans import q_funnels, q_pages, q_products, q_traffic
from trailmark.sources import (
    TABLE_SCHEMAS,
    CommerceData,
    CommerceTables,
    file_reader,
    register_views,
)


def _usd(c):
    return (F.col(c).cast("decimal(20,0)") / 100).cast("decimal(12,2)")


@pytest.fixture(scope="module")
def written(spark, small_dir, tmp_path_factory):
    """Write the derived tables in the original shape (money in dollars) as parquet and csv."""
    d = CommerceData(spark, small_dir)
    money = {"price_usd": _usd("price_cents"), "cogs_usd": _usd("cogs_cents"),
             "refund_amount_usd": _usd("refund_cents")}
    sources = {"website_sessions": d.sessions, "website_pageviews": d.pageviews,
               "orders": d.orders, "order_items": d.order_items,
               "order_item_refunds": d.refunds}
    tables = {name: df.select(*[money.get(c, F.col(c)).alias(c)
                                for c in TABLE_SCHEMAS[name].fieldNames()])
              for name, df in sources.items()}
    base = tmp_path_factory.mktemp("tables")
    for fmt in ("parquet", "csv"):
        for name, df in tables.items():
            w = df.write.mode("overwrite")
            if fmt == "csv":
                w = w.option("header", "true")
            w.format(fmt).save(f"{base}/{fmt}/{name}")
    return d, str(base)


CHECKS = [q_traffic.channel_mix_trend_weekly, q_traffic.conversion_rate_trend_weekly,
          q_pages.bounce_rate_by_landing_page, q_funnels.next_page_pathing,
          q_funnels.multi_entry_funnel, q_products.refund_rates, q_products.cross_sell_matrix]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_original_tables_give_same_results(spark, written, fmt):
    derived, base = written
    tables = CommerceTables(file_reader(spark, f"{base}/{fmt}", fmt))
    for build in CHECKS:
        if build is q_products.cross_sell_matrix:
            # the original has one orders table; compare on the web orders written above
            derived_rows = build(type("D", (), {"store_orders": derived.orders,
                                                "order_items": derived.order_items})())
        else:
            derived_rows = build(derived)
        assert sorted(map(tuple, build(tables).collect())) == sorted(
            map(tuple, derived_rows.collect())), build.__name__


def test_register_views_for_sql_users(spark, written):
    derived, _ = written
    register_views(derived, prefix="t_")
    sql = spark.sql("""
        SELECT COUNT(DISTINCT ws.website_session_id) AS sessions,
               COUNT(DISTINCT o.order_id) AS orders, SUM(o.price_usd) AS revenue
        FROM t_website_sessions ws
        LEFT JOIN t_orders o ON ws.website_session_id = o.website_session_id""").collect()[0]
    assert sql.sessions == derived.sessions.count()
    assert sql.orders == derived.orders.count()
    cents = derived.orders.agg(F.sum("price_cents")).collect()[0][0]
    assert int(sql.revenue * 100) == cents


def test_jdbc_reader_wants_partitioning_and_all_columns(spark):
    from trailmark.sources import commerce_tables as ct

    with pytest.raises(ValueError, match="no partitioning"):
        ct.jdbc_reader(spark, "jdbc:none", {})("orders")
    with pytest.raises(ValueError, match="orders lacks .*cogs_usd"):
        ct.declared_columns(spark.range(1).withColumnRenamed("id", "order_id"), "orders")


def test_checkpoint_folder_is_local_only_without_a_cluster(monkeypatch):
    from trailmark import session

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
