"""Ratios, rounding and money.

Rounding a double (``round(x, 2)``) differs between engines on ties, so percentages of counts are
rounded exactly in integer arithmetic (half up, counts are non-negative). Money is carried as long
cents, summed exactly, and divided once at the end. Every ratio is NULL when its denominator is 0,
as a SQL server without ANSI errors would give; ANSI Spark would raise instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def idiv(n: Column, d: Column) -> Column:
    """Integral division (truncating), exact for longs."""
    return F.call_function("div", n, d)


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d as double, NULL for d = 0."""
    return F.try_divide(_c(n).cast("double"), _c(d))


def ratio_pct(n: Column | str, d: Column | str) -> Column:
    """(n / d) * 100 unrounded, NULL for d = 0."""
    return ratio(n, d) * 100


def pct_round2(n: Column | str, d: Column | str) -> Column:
    """round(n / d * 100, 2) half up, exactly, for counts n, d >= 0; NULL for d = 0."""
    n, d = _c(n).cast("bigint"), _c(d).cast("bigint")
    q = idiv(n * 20000 + d, d * 2)
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(q.cast("double") / 100)


def avg_round1(s: Column | str, c: Column | str) -> Column:
    """round(s / c, 1) half up, exactly, for a sum s >= 0 of c >= 0 counts; NULL for c = 0."""
    s, c = _c(s).cast("bigint"), _c(c).cast("bigint")
    q = idiv(s * 20 + c, c * 2)
    return F.when(c == 0, F.lit(None).cast("double")).otherwise(q.cast("double") / 10)


def big(x: Column) -> Column:
    """A whole number as decimal(38, 0): products of per-session counts and money exceed a long
    when one session has very many rows."""
    return x.cast("decimal(38,0)")


def dollars(cents: Column | str) -> Column:
    """Whole cents to double dollars."""
    return _c(cents).cast("double") / 100


def cents_ratio_round2(cents: Column | str, d: Column | str) -> Column:
    """round(dollars / d, 2) half up, exactly, for cents >= 0; NULL for d = 0."""
    cents, d = _c(cents).cast("bigint"), _c(d).cast("bigint")
    q = idiv(cents * 2 + d, d * 2)
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(q.cast("double") / 100)
