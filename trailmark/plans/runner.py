"""Run many analyses over tables materialised once.

The original scripts keep intermediate results as temporary tables; a batch of reports here does
the same at table level: the six commerce tables are written once as parquet to the cluster's
shared checkpoint folder (``spark.checkpoint.dir``, read from the session), which also cuts their
lineage, and every report then reads those files instead of re-deriving them. Results can be
written as parquet, one folder per report.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from trailmark.plans import registry
from trailmark.session import checkpoint_dir

TABLES = ("sessions", "pageviews", "orders", "store_orders", "order_items", "refunds")


# bucketing key of each table when written bucketed: the key its joins and aggregates use
BUCKET_KEYS = {"sessions": "website_session_id", "pageviews": "website_session_id",
               "orders": "website_session_id", "store_orders": "order_id",
               "order_items": "order_id", "refunds": "order_item_id"}


@dataclass
class StoredTables:
    """The commerce tables as written by ``materialize`` (same interface as ``CommerceData``)."""

    spark: SparkSession
    base: str
    tables: dict[str, str] | None = None  # catalog names when written as bucketed tables

    def drop(self) -> None:
        """Drops the catalog tables and deletes the written files."""
        for name in (self.tables or {}).values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def _read(self, name: str) -> DataFrame:
        if self.tables:
            return self.spark.table(self.tables[name])
        return self.spark.read.parquet(f"{self.base}/{name}")

    @cached_property
    def sessions(self) -> DataFrame:
        return self._read("sessions")

    @cached_property
    def pageviews(self) -> DataFrame:
        return self._read("pageviews")

    @cached_property
    def orders(self) -> DataFrame:
        return self._read("orders")

    @cached_property
    def store_orders(self) -> DataFrame:
        return self._read("store_orders")

    @cached_property
    def order_items(self) -> DataFrame:
        return self._read("order_items")

    @cached_property
    def refunds(self) -> DataFrame:
        return self._read("refunds")


def materialize(spark: SparkSession, data, base: str | None = None,
                buckets: int | None = None) -> StoredTables:
    """Write the six tables of ``data`` under ``base`` (default: a new folder in the session's
    checkpoint folder) and return readers of the written files; their ``drop()`` deletes them again.

    With ``buckets``, each table is written bucketed (and sorted) by its join key
    (``BUCKET_KEYS``) as an external catalog table whose files stay under ``base``: joins and
    aggregates on session id (or order id) between such tables then need no shuffle.
    """
    tag = uuid.uuid4().hex[:12]
    base = base or f"{checkpoint_dir(spark).rstrip('/')}/trailmark-tables-{tag}"
    names = {}
    for name in TABLES:
        df = getattr(data, name)
        if buckets:
            key = BUCKET_KEYS[name]
            names[name] = f"trailmark_{name}_{tag}"
            (df.write.mode("overwrite").format("parquet").option("path", f"{base}/{name}")
             .bucketBy(buckets, key).sortBy(key).saveAsTable(names[name]))
        else:
            df.write.mode("overwrite").parquet(f"{base}/{name}")
    return StoredTables(spark, base, names or None)


def run_reports(data, keys: Iterable[str] | None = None,
                out_dir: str | None = None) -> dict[str, DataFrame]:
    """Build the registered analyses ``keys`` (default all) over ``data``; with ``out_dir`` write
    each result to ``{out_dir}/{key}`` as parquet. Returns the result DataFrames."""
    registry._load_all()
    out = {}
    for key in keys or list(registry.REGISTRY):
        df = registry.REGISTRY[key].build(data)
        if out_dir:
            df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{key}")
        out[key] = df
    return out
