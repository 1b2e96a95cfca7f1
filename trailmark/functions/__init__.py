"""Column helpers with fixed, engine-independent semantics.

All are plain ``pyspark.sql.functions`` compositions, so they stay inside whole-stage codegen.
"""

from trailmark.functions.calendar import (
    month_name,
    ts,
    week0,
    weekday0,
)
from trailmark.functions.ratios import (
    avg_round1,
    big,
    cents_ratio_round2,
    dollars,
    idiv,
    pct_round2,
    ratio,
    ratio_pct,
)

__all__ = [
    "avg_round1",
    "big",
    "cents_ratio_round2",
    "dollars",
    "idiv",
    "month_name",
    "pct_round2",
    "ratio",
    "ratio_pct",
    "ts",
    "week0",
    "weekday0",
]
