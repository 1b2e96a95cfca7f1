"""Building blocks shared by the analyses.

The recurring scale idea: **aggregate to the join key before joining**. Order and pageview facts
are reduced per session with partial (map-side) aggregation, so a hot session or url is collapsed
inside each map task, and the joins that follow are one-row-per-key on at least one side.
Because ``order_id`` and ``website_session_id`` are primary keys, a count of distinct orders over a
session ⟕ order join equals the sum of per-session order counts. Facts may lack a session id; such
rows group under NULL, and counts of sessions are counts of non-null ids (``count(session)``), as
``COUNT(DISTINCT id)`` gives. The randomized tests hold every analysis against SQL that counts
distinct ids over the joined rows, on tables with NULL ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import ratio, week0

SESSION = "website_session_id"


def orders_per_session(orders: DataFrame, products: Sequence[int] = ()) -> DataFrame:
    """website_session_id, n_orders, n_priced, revenue_cents, items (one row per session), plus
    ``n_p{k}``: orders whose primary product is k, for each k in ``products``."""
    aggs = [
        F.count("order_id").alias("n_orders"),
        F.count("price_cents").alias("n_priced"),
        F.sum("price_cents").alias("revenue_cents"),
        F.sum("items_purchased").alias("items"),
    ]
    aggs += [F.count(F.when(F.col("primary_product_id") == k, 1)).alias(f"n_p{k}")
             for k in products]
    return orders.groupBy(SESSION).agg(*aggs)


def sessions_with_orders(sessions: DataFrame, orders: DataFrame,
                         products: Sequence[int] = ()) -> DataFrame:
    """Sessions ⟕ per-session order facts, zero-filled: exactly one row per session."""
    agg = orders_per_session(orders, products)
    joined = sessions.join(agg, SESSION, "left")
    fill = {c: F.coalesce(c, F.lit(0)) for c in ["n_orders", "n_priced"]
            + [f"n_p{k}" for k in products]}
    # items and revenue stay NULL for sessions without orders, like SUM over no order rows
    return joined.withColumns(fill)


def period_key(created_at: Column, grain: str) -> Column:
    """Bucket key for ``grain`` in {'month', 'week'} (no year: years merge, as in the original)."""
    if grain == "month":
        return F.month(F.to_date(created_at))
    if grain == "week":
        return week0(created_at)
    raise ValueError(f"unknown grain {grain!r}")


def period_keys(created_at: Column, grain: str, include_year: bool) -> list[Column]:
    keys = [period_key(created_at, grain).alias("_period")]
    if include_year:
        keys.insert(0, F.year(created_at).alias("_year"))
    return keys


def apply_filter(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.where(where)


def money_ratio(cents: Column | str, d: Column | str) -> Column:
    """(sum of cents / d) / 100 as double, unrounded; NULL for d = 0."""
    return ratio(cents, d) / 100
