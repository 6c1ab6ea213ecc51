"""Eligibility, folds and samples of groups. A table of group sizes has one row a group; only the row counts of groups travel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.ordered import Order


def sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"))


def verdicts(rows: DataFrame, curves: DataFrame, group: str, known: str, least_known: int = 10, least_curve: int = 3) -> DataFrame:
    """group, hidden, known, curve_rows and skipped: why the group is left out (no hidden rows, few known ones, a short curve), or NULL."""
    counts = rows.groupBy(group).agg(F.count_if(F.col(known).isNull()).alias("hidden"), F.count(known).alias("known"))
    lengths = curves.groupBy(group).agg(F.count("*").alias("curve_rows"))
    both = counts.join(lengths, group, "left").withColumn("curve_rows", F.coalesce("curve_rows", F.lit(0).cast("long")))
    return both.withColumn("skipped", F.when(F.col("hidden") == 0, "no_hidden").when(F.col("known") < least_known, "few_known").when(F.col("curve_rows") < least_curve, "short_curve"))


def eligible(rows: DataFrame, curves: DataFrame, group: str, known: str, least_known: int = 10, least_curve: int = 3) -> DataFrame:
    """Groups with hidden rows, enough known rows and enough rows of their curve."""
    return verdicts(rows, curves, group, known, least_known, least_curve).filter("skipped is null").drop("skipped")


def eligible_by_gap(rows: DataFrame, group: str, place: str, known: str) -> DataFrame:
    """Groups with a gap and a known row before the first gap: group, first_gap (its place), known_before."""
    gap = F.min(F.when(F.col(known).isNull(), F.col(place))).over(Window.partitionBy(group))
    counted = rows.select(group, place, known, gap.alias("first_gap")).groupBy(group, "first_gap").agg(F.count_if(F.col(known).isNotNull() & (F.col(place) < F.col("first_gap"))).alias("known_before"))
    return counted.filter("first_gap is not null and known_before > 0")


def numbered(rows: DataFrame, key: str, major: Sequence[str] = (), name: str = "place") -> DataFrame:
    """rows with their place (from 0) in the order of major, then of the key's MD5, then of the key.

    No task sees all rows: a row's place is its place within its bucket (major and the first three digits of the MD5) and
    the number of rows in the buckets before, summed over one row a bucket.
    """
    digest = F.md5(F.col(key).cast("string"))
    bucket = [*major, "_b"]
    marked = rows.withColumn("_d", digest).withColumn("_b", F.substring("_d", 1, 3))
    counts = marked.groupBy(*bucket).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in bucket]
    starts = counts.withColumn("_o", before).drop("_k")
    joined = marked.alias("r").join(starts.alias("o"), reduce(lambda x, y: x & y, same)).select("r.*", "o._o")
    within = F.row_number().over(Window.partitionBy(*bucket).orderBy("_d", key)) - 1
    return joined.withColumn(name, (F.col("_o") + within).cast("long")).drop("_d", "_b", "_o")


def length_chunks(groups: DataFrame, group: str, k: int, seed: int | None) -> DataFrame:
    """Groups sorted by size in chunks of k; a chunk's groups take different folds, permuted by seed if given."""
    placed = numbered(groups, group, ["n"]).withColumn("chunk", F.floor(F.col("place") / k).cast("long"))
    if seed is None:
        fold = F.col("place") % k
    else:
        within = Window.partitionBy("chunk").orderBy(F.xxhash64(F.lit(seed), F.col(group)), group)
        fold = F.row_number().over(within) - 1
    return placed.select(group, "n", "chunk", fold.cast("int").alias("fold"))


def shuffled(groups: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Groups dealt to folds in the order of a seeded hash (MD5 of seed and name)."""
    named = groups.withColumn("_g", F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))
    return numbered(named, "_g").select(group, "n", (F.col("place") % k).cast("int").alias("fold"))


def packed(runs: Sequence[tuple[int, int]], k: int) -> dict[int, list[tuple[int, list[int]]]]:
    """Largest-first packing of runs (size, count) into k folds: by size, (first place in the run, folds dealt in turn from there).

    Each group goes to the lightest fold, the first of equal ones. Among groups of one size the folds within a size of the
    lightest take turns in a fixed order, until the next heavier fold comes within reach; so a run of any count has k such
    stretches at most, and no group is looked at by itself.
    """
    loads, out = [0] * k, {}
    for size, count in sorted(runs, reverse=True):
        place, stretches = 0, []
        while place < count:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            first = order[0]
            turn = [f for f in order if (loads[f], f) < (loads[first] + size, first) or f == first]
            rounds = [(loads[f] - loads[first]) // size - ((loads[f] - loads[first]) % size == 0 and f < first) for f in order if f not in turn]
            dealt = min([count - place, *(r * len(turn) for r in rounds)])
            stretches.append((place, turn))
            for i, f in enumerate(turn):
                loads[f] += size * ((dealt - i + len(turn) - 1) // len(turn))
            place += dealt
        out[size] = stretches
    return out


def balanced(groups: DataFrame, group: str, k: int) -> DataFrame:
    """Folds of nearly equal row counts by largest-first packing: groups from the largest down (ties by MD5 of their name) go to the lightest fold.

    One row for each distinct size reaches the driver, at most the square root of twice the rows; a group's place among
    those of its size is its place in a bucket of MD5 and the counts of the buckets before, so no task holds all of them.
    """
    named = groups.withColumn("_d", F.md5(F.col(group).cast("string"))).withColumn("_b", F.substring("_d", 1, 4))
    counts = named.groupBy("n", "_b").agg(F.count("*").alias("_k"))
    runs = [(r["n"], r["m"]) for r in counts.groupBy("n").agg(F.sum("_k").alias("m")).collect()]
    if not runs:
        return groups.select(group, "n", F.lit(0).alias("fold"))
    stretches = groups.sparkSession.createDataFrame([(n, list(found)) for n, found in packed(runs, k).items()], "n long, _s array<struct<start:long,turn:array<int>>>")
    before = Window.partitionBy("n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = counts.select("n", "_b", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"))
    within = F.row_number().over(Window.partitionBy("n", "_b").orderBy("_d", group)) - 1
    placed = named.withColumn("_w", within).join(starts, ["n", "_b"]).withColumn("_p", F.col("_o") + F.col("_w")).join(stretches, "n")
    last = F.element_at(F.filter("_s", lambda x: x["start"] <= F.col("_p")), -1)
    return placed.withColumn("_l", last).select(group, "n", F.get(F.col("_l.turn"), ((F.col("_p") - F.col("_l.start")) % F.size("_l.turn")).cast("int")).alias("fold"))


def stratified_rows(rows: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Rows dealt to folds within each label, in the order of a hash of their key."""
    placed = numbered(rows.select(key, label), key, [label])
    first = placed.groupBy(label).agg(F.min("place").alias("_first"))
    joined = placed.alias("r").join(F.broadcast(first).alias("f"), F.col(f"r.{label}").eqNullSafe(F.col(f"f.{label}")))
    return joined.select(f"r.{key}", ((F.col("place") - F.col("_first")) % k).cast("int").alias("fold"))


def holdout(rows: DataFrame, group: str, share: float) -> DataFrame:
    """The given share of the groups, the first in the order of a hash."""
    placed = numbered(rows.select(group).distinct(), group)
    total = placed.agg(F.count("*").alias("_m"))
    return placed.crossJoin(F.broadcast(total)).filter(F.col("place") < F.ceil(share * F.col("_m"))).select(group)


def evenly_spaced(rows: DataFrame, order: Order, most: int) -> DataFrame:
    """Up to `most` rows of each group at even distances, the first and last among them: row floor(i * (n - 1) / (m - 1)) for each i."""
    place = F.row_number().over(order.window) - 1
    placed = rows.withColumn("_p", place).withColumn("_n", F.count("*").over(order.whole))
    m = F.least(F.lit(most), F.col("_n"))
    # row p is taken if some i has floor(i * d) = p, with d = (n - 1) / (m - 1): the least i at or after p / d
    d = F.try_divide(F.col("_n") - 1, m - 1)
    i = F.ceil(F.try_divide(F.col("_p"), d))
    hit = F.floor(F.try_divide(i * (F.col("_n") - 1), m - 1)) == F.col("_p")
    return placed.filter((F.col("_p") == 0) | F.coalesce(hit & (i < m), F.lit(False))).drop("_p", "_n")
