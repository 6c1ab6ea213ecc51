"""Scalar expressions with the null rules of the engine: NaN and infinities become NULL, division by zero gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    inf = F.lit(float("inf"))
    return F.when((F.abs(x) < inf) & ~F.isnan(x), x)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """x within [lo, hi]; NULL stays NULL, which greatest and least alone would skip."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(x.isNotNull(), F.greatest(as_col(lo), F.least(as_col(hi), x)))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero, so that results compare equal across engines."""
    return F.round(x, digits) + F.lit(0.0)


def offset_name(offset: int) -> str:
    """p5 for 5, m5 for -5."""
    return f"{'m' if offset < 0 else 'p'}{abs(offset)}"
