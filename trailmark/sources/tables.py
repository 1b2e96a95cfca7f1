"""Typed readers for the raw parquet tables.

Schemas are declared, never inferred, so a scan costs no extra job and a changed file fails loudly.
Only columns a plan touches are read: Catalyst prunes the declared schema to the ``ReadSchema`` of
each scan and pushes comparisons on plain columns into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampNTZType()),
    T.StructField("o_orderpriority", T.StringType()),
])

LINEITEM = T.StructType([
    T.StructField("l_orderkey", T.LongType()),
    T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()),
    T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()),
    T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()),
    T.StructField("l_linestatus", T.StringType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])

SCHEMAS: dict[str, T.StructType] = {"events": EVENTS, "orders": ORDERS, "lineitem": LINEITEM}


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read ``{base_dir}/{name}.parquet`` (a file or a directory of part files)."""
    path = f"{base_dir.rstrip('/')}/{name}.parquet"
    return spark.read.schema(SCHEMAS[name]).parquet(path)
