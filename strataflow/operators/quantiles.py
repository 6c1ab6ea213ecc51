"""Exact order statistics of a column over all rows, without sorting it or bringing it into one task.

The values between two bounds are counted in BINS bins of a monotone scale, with each bin's own least and largest value;
the bin that holds a rank gives the next bounds, until they are equal. Bounds are values of the column, so they fall into
different bins as long as they differ, and every pass narrows. Bounds far apart are binned by their exponent, close ones
evenly: a pass over a binade leaves a 4096th of it, so about seven passes are enough for any doubles, and two or three
for usual ones. Of a pass a task holds one row a bin, and so does the driver; equal values, however many, are one bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.scalar import finite
from strataflow.operators.staging import staged

BINS = 4096


@dataclass
class Bracket:
    """Ranks whose values lie within [lo, hi]; `below` values of the column are less than lo."""

    lo: float
    hi: float
    below: int
    ranks: list[int] = field(default_factory=list)

    def bins(self, v: Column) -> Column:
        if self.lo <= 0 <= self.hi or max(abs(self.lo), abs(self.hi)) > 4 * min(abs(self.lo), abs(self.hi)):
            # exponents lie within -1074 and 1024, so that the scale keeps the sign and the order
            scale = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1080))
            point = lambda x: math.copysign(math.log2(abs(x)) + 1080, x) if x else 0.0
        else:
            scale = lambda x: x - self.lo  # noqa: E731  of one sign and order, so that no difference overflows
            point = lambda x: x - self.lo
        a, b = point(self.lo), point(self.hi)
        at = F.floor((scale(v) - a) / (b - a) * BINS) if b > a else F.lit(0)
        # the bounds themselves take the outer bins, whatever rounding does to the scale
        return F.when(v == self.lo, 0).when(v == self.hi, BINS - 1).otherwise(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), at))).cast("int")


def order_statistics(values: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The value at each rank (from 0) of a column without nulls; values is read once a pass."""
    v = F.col(column)
    n, lo, hi = values.agg(F.count(v), F.min(v), F.max(v)).first()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"ranks beyond the {n} values")
    found: dict[int, float] = {}
    open_ = [Bracket(lo, hi, 0, sorted(set(ranks)))] if n else []
    while open_:
        for b in open_:
            if b.lo == b.hi:
                found |= dict.fromkeys(b.ranks, b.lo)
        open_ = [b for b in open_ if b.lo < b.hi]
        if not open_:
            break
        which = F.coalesce(*(F.when(v.between(b.lo, b.hi), F.lit(i)) for i, b in enumerate(open_)))
        bins = F.coalesce(*(F.when(F.col("_which") == i, b.bins(v)) for i, b in enumerate(open_)))
        counted = values.select(v, which.alias("_which")).filter("_which is not null").groupBy("_which", bins.alias("_bin")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        cells = sorted(counted.collect(), key=lambda r: (r["_which"], r["_bin"]))  # BINS rows a bracket at most
        narrower: list[Bracket] = []
        below = {i: b.below for i, b in enumerate(open_)}
        for r in cells:
            i = r["_which"]
            inside = [k for k in open_[i].ranks if below[i] <= k < below[i] + r["n"]]
            if inside:
                narrower.append(Bracket(r["lo"], r["hi"], below[i], inside))
            below[i] += r["n"]
        open_ = narrower
    return found


def quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours; nulls, NaN and infinities do not count; None without values."""
    values = staged(rows.select(finite(F.col(column).cast("double")).alias("v")).filter("v is not null"), "quantiles")
    n = values.count()
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    ends = [(math.floor(x), min(math.floor(x) + 1, n - 1)) for x in at]
    found = order_statistics(values, "v", [r for pair in ends for r in pair])
    return [found[a] + (found[b] - found[a]) * (x - a) for x, (a, b) in zip(at, ends, strict=True)]
