"""Lookups of rows in a reference curve of their group: as-of, insert position, piecewise-linear, intervals.

A lookup is a union of queries and knots sorted by (group, value) with last/first ignoring nulls, so it costs one exchange
and one sort whatever the curve's length, and never pairs rows with knots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup(rows: DataFrame, value: str, knots: DataFrame, knot: str, payload: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """rows with lo (knot, payload of the last knot at or below value), hi (of the first at or above) and below (number of knots below value).

    Rows with a NULL value have NULL lo and hi. Knots with a NULL knot are ignored.
    """
    own = [c for c in rows.columns if c not in keys]
    entry = F.struct(F.col(knot).alias("knot"), *(F.col(p).alias(p) for p in payload))
    left = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_q"), F.lit(None).alias("_k"), F.struct(*own).alias("_row"))
    right = knots.filter(F.col(knot).isNotNull()).select(*keys, F.col(knot).alias("_v"), F.lit(0).alias("_q"), entry.alias("_k"))
    both = right.unionByName(left.withColumn("_k", F.lit(None).cast(right.schema["_k"].dataType)), allowMissingColumns=True)
    up = Window.partitionBy(*keys).orderBy(F.asc("_v"), F.asc("_q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at equal values knots stand before queries for lo; for hi the query must stand before them
    down = Window.partitionBy(*keys).orderBy(F.desc("_v"), F.asc("_q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_or_below = F.count("_k").over(up)
    same = F.count("_k").over(Window.partitionBy(*keys, "_v"))
    found = both.withColumn("lo", F.last("_k", ignorenulls=True).over(up)).withColumn("hi", F.last("_k", ignorenulls=True).over(down)).withColumn("below", at_or_below - same)
    out = found.filter("_q = 1").select(*keys, "_row.*", "lo", "hi", "below")
    nothing = rows.filter(F.col(value).isNull())
    return out.unionByName(nothing, allowMissingColumns=True)


def linear(value: Column, field: str, clamp: bool = True) -> Column:
    """Piecewise-linear value of `field` from lo and hi; the end knots' beyond the curve, or NULL there without clamp."""
    lo, hi = F.col("lo"), F.col("hi")
    a, b = lo[field], hi[field]
    inside = F.when(lo["knot"] == hi["knot"], a).otherwise(a + (b - a) * F.try_divide(value - lo["knot"], hi["knot"] - lo["knot"]))
    return F.coalesce(inside, a, b) if clamp else F.when(lo.isNotNull() & hi.isNotNull(), inside)


def changes(knots: DataFrame, knot: str, code: Column, keys: Sequence[str]) -> DataFrame:
    """The knots at which the code differs from the knot before."""
    order = Window.partitionBy(*keys).orderBy(knot)
    coded = knots.withColumn("_c", code).withColumn("_b", F.lag("_c").over(order))
    return coded.filter(F.col("_b").isNotNull() & (F.col("_c") != F.col("_b"))).drop("_c", "_b")
