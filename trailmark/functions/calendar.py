"""Calendar expressions.

* ``ts``: a typed ``timestamp_ntz`` literal. A date string used as a timestamp bound means that
  day's midnight, so ``BETWEEN '2024-01-05' AND '2024-01-25'`` excludes the rest of the 25th, as the
  original analyses do. Casting the literal (not the column) keeps the comparison a pushed-down
  parquet filter.
* ``week0``: week number with weeks starting on Sunday, 0..53, where days before the year's first
  Sunday are week 0. Spark has no built-in for it (``weekofyear`` is ISO-8601).
* ``weekday0``: Monday = 0 .. Sunday = 6.
* ``month_name``: full English month name ("January").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(value: str) -> Column:
    """Timestamp-without-zone literal from 'YYYY-MM-DD[ hh:mm:ss]'."""
    return F.lit(value).cast("timestamp_ntz")


def week0(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # dayofweek: Sunday = 1; days since the week's Sunday = dayofweek - 1
    return F.floor((F.dayofyear(c) + 6 - (F.dayofweek(c) - 1)) / 7).cast("bigint")


def weekday0(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.weekday(c).cast("bigint")


def month_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "MMMM")
