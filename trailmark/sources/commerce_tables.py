"""Readers for the five commerce tables in their original shape.

A user who already has ``website_sessions``, ``website_pageviews``, ``orders``, ``order_items`` and
``order_item_refunds`` (money as ``DECIMAL(12,2)`` dollars) reads them here from parquet, ORC, CSV,
JSON or a JDBC source with declared schemas, and gets the same interface as the derived test data
(``CommerceData``), so every operator and every registered analysis runs on them unchanged.
Money is converted once to long cents (exact for two-decimal amounts).

``register_views`` exposes the tables under their original names for ``spark.sql`` users, with
money back in dollars.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

# Columns the analyses read, in the order of the inferred schemas (FIXTURES.md §1). Files may hold
# more columns (parquet, ORC, JSON bind by name); CSV headers are validated against this order.
TABLE_SCHEMAS: dict[str, T.StructType] = {
    "website_sessions": T.StructType([
        T.StructField("website_session_id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("utm_source", T.StringType()),
        T.StructField("utm_campaign", T.StringType()),
        T.StructField("http_referer", T.StringType()),
        T.StructField("device_type", T.StringType()),
    ]),
    "website_pageviews": T.StructType([
        T.StructField("website_pageview_id", T.LongType()),
        T.StructField("website_session_id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("pageview_url", T.StringType()),
    ]),
    "orders": T.StructType([
        T.StructField("order_id", T.LongType()),
        T.StructField("website_session_id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("primary_product_id", T.LongType()),
        T.StructField("items_purchased", T.LongType()),
        T.StructField("price_usd", MONEY),
        T.StructField("cogs_usd", MONEY),
    ]),
    "order_items": T.StructType([
        T.StructField("order_item_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("is_primary_item", T.IntegerType()),
        T.StructField("price_usd", MONEY),
        T.StructField("created_at", T.TimestampNTZType()),
    ]),
    "order_item_refunds": T.StructType([
        T.StructField("order_item_refund_id", T.LongType()),
        T.StructField("order_item_id", T.LongType()),
        T.StructField("refund_amount_usd", MONEY),
        T.StructField("created_at", T.TimestampNTZType()),
    ]),
}


def to_cents(c: str) -> F.Column:
    """Exact dollars -> long cents for DECIMAL(p,2) money."""
    return (F.col(c) * 100).cast("bigint")


def file_reader(spark: SparkSession, base_dir: str, fmt: str = "parquet",
                options: Mapping[str, str] | None = None) -> Callable[[str], DataFrame]:
    """Reader of ``{base_dir}/{table}`` (a folder or file of that name) with the declared schema."""
    opts = dict(options or {})
    if fmt == "csv":
        opts.setdefault("header", "true")
        opts.setdefault("enforceSchema", "false")

    def read(table: str) -> DataFrame:
        path = f"{base_dir.rstrip('/')}/{table}"
        return spark.read.format(fmt).options(**opts).schema(TABLE_SCHEMAS[table]).load(path)

    return read


def jdbc_reader(spark: SparkSession, url: str, partitioning: Mapping[str, tuple[str, int, int, int]],
                properties: Mapping[str, str] | None = None) -> Callable[[str], DataFrame]:
    """Reader of tables from a database the user already runs (e.g. the original MySQL server).

    ``partitioning`` maps every table that is read to (column, lower, upper, partitions), so the
    read is split into parallel range queries; a table without it, or without a declared column, is
    an error (one connection would pull it whole, or a column would go missing).
    """
    props = dict(properties or {})

    def read(table: str) -> DataFrame:
        if table not in partitioning:
            raise ValueError(f"no partitioning given for table {table}")
        col, lo, hi, n = partitioning[table]
        df = spark.read.jdbc(url, table, column=col, lowerBound=lo, upperBound=hi,
                             numPartitions=n, properties=props)
        return declared_columns(df, table)

    return read


def declared_columns(df: DataFrame, table: str) -> DataFrame:
    """The declared columns of ``table`` in their declared types; all must be there."""
    fields = TABLE_SCHEMAS[table].fields
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {table} lacks {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


@dataclass
class CommerceTables:
    """The five original tables, exposed with the interface of ``CommerceData``."""

    read: Callable[[str], DataFrame]

    @cached_property
    def sessions(self) -> DataFrame:
        return self.read("website_sessions")

    @cached_property
    def pageviews(self) -> DataFrame:
        return self.read("website_pageviews")

    @cached_property
    def orders(self) -> DataFrame:
        o = self.read("orders")
        return o.select("order_id", "created_at", "website_session_id", "primary_product_id",
                        "items_purchased", to_cents("price_usd").alias("price_cents"),
                        to_cents("cogs_usd").alias("cogs_cents"))

    @cached_property
    def store_orders(self) -> DataFrame:
        # one orders table serves both the web and the product analyses
        return self.orders

    @cached_property
    def order_items(self) -> DataFrame:
        i = self.read("order_items")
        return i.select("order_item_id", "created_at", "order_id", "product_id",
                        "is_primary_item", to_cents("price_usd").alias("price_cents"))

    @cached_property
    def refunds(self) -> DataFrame:
        r = self.read("order_item_refunds")
        return r.select("order_item_refund_id", "order_item_id", "created_at",
                        to_cents("refund_amount_usd").alias("refund_cents"))


def register_views(data, prefix: str = "") -> list[str]:
    """Temp views under the original table names (money in dollars) for ``spark.sql`` users.

    ``data`` is a ``CommerceData`` or ``CommerceTables``.
    """
    def usd(c: str, name: str) -> F.Column:
        return (F.col(c).cast("decimal(20,0)") / 100).cast(MONEY).alias(name)

    views = {
        "website_sessions": data.sessions,
        "website_pageviews": data.pageviews,
        "orders": data.orders.select("order_id", "created_at", "website_session_id",
                                     "primary_product_id", "items_purchased",
                                     usd("price_cents", "price_usd"),
                                     usd("cogs_cents", "cogs_usd")),
        "order_items": data.order_items.select("order_item_id", "created_at", "order_id",
                                               "product_id", "is_primary_item",
                                               usd("price_cents", "price_usd")),
        "order_item_refunds": data.refunds.select("order_item_refund_id", "order_item_id",
                                                  usd("refund_cents", "refund_amount_usd"),
                                                  "created_at"),
    }
    names = []
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
