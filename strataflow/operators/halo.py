"""Window features of groups too large for one task: groups are cut into ranges of rows, which tasks take one by one.

Rows carry a dense number within their group (from 0); a range is `size` numbers. What looks a bounded number of rows
around (lags, rolling statistics, gradients) is computed within ranges that have the neighbours' rows at their margins
as well (`windowed`). What looks without bound (last known values, running sums) is what the range says of itself and what
one row a range carries over from all ranges before or after it (`carried`). `numbered` gives the numbers by quantiles of
the order column, so that a single group of all rows is numbered by many tasks too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.ordered import Order, previous
from strataflow.operators.staging import staged

SIZE = 1 << 18
MOST_CUTS = 1 << 12


def place_among(x: Column, cuts: Column, most: int = MOST_CUTS) -> Column:
    """How many of an ascending array's values (`most` at most) are x or less, by halving."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(most.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda k, s: F.when((k + s <= F.size(cuts)) & (F.get(cuts, k + s - 1) <= x), k + s).otherwise(k))


def numbered(rows: DataFrame, by: str, ties: Sequence[str], name: str = "row_id", size: int = SIZE) -> DataFrame:
    """rows with their number (from 0) in the order of a numeric column and ties; rows that tie in `by` share a task."""
    total = rows.count()
    n = max(1, min(MOST_CUTS, -(-total // size)))
    # cuts at shares of the rows; a few hundred numbers in one row at most
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = staged(rows.agg(F.percentile_approx(by, shares, max(10_000, 20 * n)).alias("_cuts")), "cuts")
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("_cut", F.when(F.col(by).isNull(), -1).otherwise(place_among(F.col(by), F.col("_cuts")))).drop("_cuts")
    before = Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)  # one row a cut
    counts = placed.groupBy("_cut").agg(F.count("*").alias("_n"))
    offsets = counts.select("_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_cut").orderBy(by, *ties)) - 1
    return placed.withColumn("_within", within).join(F.broadcast(offsets), "_cut").withColumn(name, F.col("_before") + F.col("_within")).drop("_cut", "_within", "_before")


def windowed(rows: DataFrame, order: Order, features: Mapping[str, Callable[[Order], Column]], before: int, after: int, size: int = SIZE) -> DataFrame:
    """rows with features of up to `before` rows before and `after` rows after each; order.by is the dense number."""
    number = F.col(order.by[0])
    own = F.floor(number / size)
    reached = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((number - after) / size)), F.floor((number + before) / size))
    spread = rows.withColumn("_range", F.explode(reached)).withColumn("_own", F.col("_range") == own)
    within = Order((*order.keys, "_range"), order.by)
    return spread.withColumns({name: feature(within) for name, feature in features.items()}).filter("_own").drop("_range", "_own")


def carried(rows: DataFrame, order: Order, last: Sequence[str] = (), following_: Sequence[str] = (), sums: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """rows with last_<c> (the last value up to the row), next_<c> (the first from it on) and sum_<c> (the running sum)."""
    number, keys = order.by[0], [*order.keys, "_range"]
    cut = rows.withColumn("_range", F.floor(F.col(number) / size))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(number))
    said = cut.groupBy(*keys).agg(
        F.lit(True).alias("_said"),
        *(F.max_by(c, at(c)).alias(f"_last_{c}") for c in last),
        *(F.min_by(c, at(c)).alias(f"_next_{c}") for c in following_),
        *(F.sum(c).alias(f"_sum_{c}") for c in sums),
    )
    # what follows is looked up in falling order: a frame from a row to the end would be read anew for every row
    groups = Window.partitionBy(*order.keys)  # one row a range
    earlier, later = (groups.orderBy(by).rowsBetween(Window.unboundedPreceding, -1) for by in (F.asc("_range"), F.desc("_range")))
    said = said.select(
        *keys,
        *(F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_last_{c}") for c in last),
        *(F.last(f"_next_{c}", ignorenulls=True).over(later).alias(f"_next_{c}") for c in following_),
        *(F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_sum_{c}") for c in sums),
    )
    within = Order(tuple(keys), order.by)
    falling = Window.partitionBy(*keys).orderBy(F.desc(number)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = cut.withColumns({f"last_{c}": previous(F.col(c), within) for c in last} | {f"next_{c}": F.last(c, ignorenulls=True).over(falling) for c in following_} | {f"sum_{c}": F.coalesce(F.sum(c).over(within.so_far), F.lit(0)) for c in sums})
    both = here.join(said, keys)
    both = both.withColumns({f"last_{c}": F.coalesce(f"last_{c}", f"_last_{c}") for c in last} | {f"next_{c}": F.coalesce(f"next_{c}", f"_next_{c}") for c in following_} | {f"sum_{c}": F.col(f"sum_{c}") + F.col(f"_sum_{c}") for c in sums})
    return both.drop("_range", *(f"_last_{c}" for c in last), *(f"_next_{c}" for c in following_), *(f"_sum_{c}" for c in sums))
