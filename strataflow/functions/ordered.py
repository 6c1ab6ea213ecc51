"""Window expressions over the rows of a group in order: fills, lags, rolling statistics, gradients, angles.

Each takes the group's Order, whose windows all share one partitioning and sort, so a plan of many of them has one
exchange and one sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from strataflow.functions.scalar import safe_divide


@dataclass(frozen=True)
class Order:
    """Groups by `keys`, ordered by `by` (unique within a group)."""

    keys: tuple[str, ...]
    by: tuple[str, ...]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.by)

    @property
    def whole(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def onward(self) -> WindowSpec:
        return self.window.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def trailing(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(-(n - 1), 0)

    def centered(self, n: int) -> WindowSpec:
        if n % 2 == 0:
            raise ValueError("centred windows have an odd length")
        return self.window.rowsBetween(-(n // 2), n // 2)


def previous(x: Column, o: Order) -> Column:
    """The last non-null value up to this row."""
    return F.last(x, ignorenulls=True).over(o.so_far)


def following(x: Column, o: Order) -> Column:
    """The first non-null value from this row on."""
    return F.first(x, ignorenulls=True).over(o.onward)


def fill(x: Column, o: Order) -> Column:
    """Forward, then backward."""
    return F.coalesce(previous(x, o), following(x, o))


def interpolate(x: Column, o: Order, position: Column) -> Column:
    """Linear in `position` between the nearest non-null values, the nearest one at the ends; NULL if all are NULL."""
    at = F.when(x.isNotNull(), position)
    x0, x1, p0, p1 = previous(x, o), following(x, o), previous(at, o), following(at, o)
    inside = x0 + (x1 - x0) * safe_divide(position - p0, p1 - p0)
    return F.coalesce(x, inside, x0, x1)


def diff(x: Column, o: Order, k: int = 1) -> Column:
    return x - F.lag(x, k).over(o.window)


def lag_filled(x: Column, o: Order, k: int) -> Column:
    """The value k rows before; the group's first non-null such value where there is none."""
    lagged = F.lag(x, k).over(o.window)
    return F.coalesce(lagged, F.first(x, ignorenulls=True).over(o.whole))


def lead_filled(x: Column, o: Order, k: int) -> Column:
    led = F.lead(x, k).over(o.window)
    return F.coalesce(led, F.last(x, ignorenulls=True).over(o.whole))


def rolling(x: Column, w: WindowSpec, kind: str) -> Column:
    """mean, std (sample; NULL below two values), min, max, median, sum, rms over a frame; any non-null value counts."""
    if kind == "std":
        return F.when(F.count(x).over(w) >= 2, F.stddev_samp(x).over(w))
    if kind == "median":
        return F.percentile(x, 0.5).over(w)
    if kind == "rms":
        return F.sqrt(F.avg(x * x).over(w))
    return {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[kind](x).over(w)


def slope_per(x: Column, along: Column, o: Order) -> Column:
    """Change of x by change of `along` since the row before; NULL at the start and where `along` stands still."""
    return safe_divide(diff(x, o), diff(along, o))


def stepwise(y: Column, x: Column, o: Order) -> Column:
    """Second-order differences on uneven steps, one-sided at the ends; looks one row either way."""
    y0, y1, x0, x1 = F.lag(y).over(o.window), F.lead(y).over(o.window), F.lag(x).over(o.window), F.lead(x).over(o.window)
    a, b = x - x0, x1 - x
    inner = safe_divide(-b * y0, a * (a + b)) + safe_divide((b - a) * y, a * b) + safe_divide(a * y1, b * (a + b))
    return F.when(x0.isNull(), safe_divide(y1 - y, b)).when(x1.isNull(), safe_divide(y - y0, a)).otherwise(inner)


def gradient(y: Column, x: Column, o: Order) -> Column:
    """stepwise(); 0 for groups of one row or without spread in x."""
    spread = F.stddev_pop(x).over(o.whole)
    return F.when(F.coalesce(spread, F.lit(0.0)) < 1e-9, F.lit(0.0)).otherwise(stepwise(y, x, o))


def wrapped(step: Column) -> Column:
    """An angle's step within (-pi, pi], as unwrapping takes it."""
    turn = 2 * math.pi
    moved = step - turn * F.floor((step + math.pi) / turn)
    return F.when((moved == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(moved)


def unwrapped(step: Column, start: Column, o: Order) -> Column:
    """Angles from their first value and their steps (NULL in the first row)."""
    return F.first(start).over(o.so_far) + F.coalesce(F.sum(wrapped(step)).over(o.so_far), F.lit(0.0))
