"""trailmark: clickstream and commerce analytics expressed as Spark DataFrame plans.

Every analysis is a function ``(DataFrame..., parameters) -> DataFrame`` built from Spark's own
operators, so Catalyst plans it and the same code runs on one machine or a cluster.

Sub-packages
------------
sources    typed readers for the raw tables and the derived website / store tables
functions  Column helpers with fixed semantics (week-0, month names, exact percentages, money)
operators  the analyses: traffic, pages, funnels, experiments, products
plans      query registry (parameters bound to the test data) and the DuckDB oracle SQL
"""

from trailmark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
