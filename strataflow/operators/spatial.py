"""Nearest neighbours and surfaces through them.

Space is cut into cells by quantiles of the points' coordinates, so that a cell holds about `CELL` points; crowded cells are
split further. A query looks first at its own cell, which gives it a distance within which its k nearest lie, and then only
at the other cells whose points' box reaches into that distance, and of these takes nothing beyond it. A task holds one part
of a cell's points and one part of the queries that ask for it. Nothing is broadcast but the cuts and one row a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.staging import staged

CELL, QUERIES = 4096, 20_000  # points of a cell, queries of a task's part
PART = 4 * CELL  # points of a task's part
CUTS = 256  # of each coordinate at most


def _cell(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie at or below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)) if cuts else F.lit(0)


def _parts(rows: DataFrame, most: int) -> DataFrame:
    """cx, cy, _n: how many parts of about `most` rows each cell has."""
    return rows.groupBy("cx", "cy").agg(F.ceil(F.count("*") / most).cast("int").alias("_n"))


def _parted(rows: DataFrame, own: DataFrame, by: str, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """rows dealt by a hash to the parts `own` of their cell, and repeated for each of the parts `others` of the other side; both counts are of rows that are not repeated."""
    dealt = rows.join(F.broadcast(own), ["cx", "cy"]).withColumn(key, F.pmod(F.xxhash64(by), F.col("_n")).cast("int")).drop("_n")
    return dealt.join(F.broadcast(others), ["cx", "cy"]).withColumn(other_key, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def _best(asked: DataFrame, points: DataFrame, k: int, values: Sequence[str]) -> DataFrame:
    """The k nearest, at most at the distance `within` of asked, within each part of the cells that are asked for."""
    of_q, of_p = _parts(asked, QUERIES), _parts(points, PART)
    q, p = _parted(asked, of_q, "qid", "qp", of_p, "pp"), _parted(points, of_p, "pid", "pp", of_q, "qp")
    fields = ["pid", "x", "y", *values]
    types = {**dict(asked.dtypes), **dict(points.dtypes)}

    def best(key: tuple, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pid", kind="stable")
        xy, own = p[["x", "y"]].to_numpy(), p["own"].to_numpy()
        out = []
        for lo in range(0, len(q) if len(p) else 0, 256):
            part = q.iloc[lo : lo + 256]
            d = np.sqrt((part["x"].to_numpy()[:, None] - xy[:, 0]) ** 2 + (part["y"].to_numpy()[:, None] - xy[:, 1]) ** 2)
            d[part["own"].to_numpy()[:, None] == own[None]] = np.inf
            far = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(part), 1), np.inf)
            far = np.fmin(far, part["within"].to_numpy(np.float64)[:, None])
            rows, cols = np.nonzero((d <= far) & np.isfinite(d))
            by = np.lexsort((cols, d[rows, cols], rows))  # columns are in order of pid
            rows, cols = rows[by], cols[by]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols = rows[nth < k], cols[nth < k]
            out.append((rows + lo, cols, d[rows, cols]))
        rows, cols, d = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        plain = lambda frame, name, at: pd.Series(frame[name].to_numpy()[at], dtype=None if types[name] in ("bigint", "double") else object)
        return pd.DataFrame({"qid": plain(q, "qid", rows), "distance": d, **{c: plain(p, c, cols) for c in fields}})

    schema = f"qid {types['qid']}, distance double, " + ", ".join(f"{c} {types[c]}" for c in fields)
    keys = ["cx", "cy", "qp", "pp"]
    return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(best, schema)


def nearest(queries: DataFrame, points: DataFrame, k: int, values: Sequence[str] = ("value",), cell: int = CELL) -> DataFrame:
    """queries(qid, own, x, y), points(pid, own, x, y, values): qid, neighbours (array of distance, pid, x, y, values), nearest first, without points of the query's own group.

    `own` is qid or pid where it is absent. Ties fall to the smaller pid. Rows with NULL coordinates or values take no
    part; a query without any neighbour is left out; repeated qids are one query.
    """
    points = points if "own" in points.columns else points.withColumn("own", F.col("pid"))
    queries = queries if "own" in queries.columns else queries.withColumn("own", F.col("qid"))
    numbers = lambda names: (F.col(c).cast("double").alias(c) for c in names)
    points = points.select("pid", "own", *numbers(("x", "y", *values))).na.drop()
    queries = queries.select("qid", "own", *numbers(("x", "y"))).na.drop(subset=["qid", "x", "y"])
    side = min(CUTS, max(1, int(np.sqrt(points.count() / cell))))
    shares = [i / side for i in range(1, side)]
    cuts = points.approxQuantile(["x", "y"], shares, 0.25 / side) if shares else [[], []]
    cx, cy = (lambda v, c=sorted(set(c)): _cell(v, c) for c in cuts)
    placed = points.withColumn("cx", cx(F.col("x"))).withColumn("cy", cy(F.col("y")))
    home = queries.withColumn("cx", cx(F.col("x"))).withColumn("cy", cy(F.col("y")))
    found = _best(home.withColumn("within", F.lit(None).cast("double")), placed, k, values)
    if shares:
        met = found.groupBy("qid").agg(F.sort_array(F.collect_set(F.struct("distance", "pid"))).alias("met"))
        # with k in the home cell, all of the k nearest lie within the distance of the last of these
        reach = home.join(met.select("qid", F.when(F.size("met") >= k, F.col("met")[k - 1]["distance"]).alias("d")), "qid", "left")
        span = lambda v, at: F.sequence(*(F.when(F.col("d").isNull(), F.lit(e)).otherwise(at(F.col(v) + s * F.col("d"))) for s, e in ((-1, 0), (1, side))))
        wide = reach.select("qid", "own", "x", "y", F.col("cx").alias("hx"), F.col("cy").alias("hy"), F.explode(span("x", cx)).alias("cx"), "d").select("*", F.explode(span("y", cy)).alias("cy")).withColumnRenamed("d", "within")
        ends = [f(v).alias(f"{n}_{v}") for v in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
        boxes = placed.groupBy("cx", "cy").agg(*ends)
        off = lambda v: F.greatest(F.col(f"lo_{v}") - F.col(v), F.col(v) - F.col(f"hi_{v}"), F.lit(0.0))
        near = F.col("within").isNull() | (F.sqrt(off("x") * off("x") + off("y") * off("y")) <= F.col("within") * (1 + 1e-9))
        others = wide.filter("cx != hx or cy != hy").join(F.broadcast(boxes), ["cx", "cy"]).filter(near).select("qid", "own", "x", "y", "cx", "cy", "within")
        found = found.unionByName(_best(staged(others, "others"), placed, k, values))
    entry = F.struct("distance", "pid", "x", "y", *values)
    return found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k).alias("neighbours"))


def _sum(f) -> Column:
    return F.aggregate(F.transform("neighbours", f), F.lit(0.0), lambda a, v: a + v)


def weight(n: Column) -> Column:
    return 1 / (n["distance"] + 1e-3)


def inverse_distance(found: DataFrame, value: str = "value", prefix: str = "") -> DataFrame:
    """Adds idw, idw_std (weighted population deviation) and nearest."""
    total = _sum(weight)
    rows = found.withColumn(f"{prefix}idw", _sum(lambda n: weight(n) * n[value]) / total)
    spread = F.sqrt(_sum(lambda n: weight(n) * (n[value] - F.col(f"{prefix}idw")) * (n[value] - F.col(f"{prefix}idw"))) / total)
    return rows.withColumn(f"{prefix}idw_std", spread).withColumn(f"{prefix}nearest", F.col("neighbours")[0]["distance"])


def plane(found: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds surface_<value> for each of ranges {value: (lowest, highest)}: the weighted plane through the neighbours at the
    query (columns qx, qy), by Cramer's rule on coordinates centred there. Where it strays from the inverse-distance mean by
    more than half the range (200 at least), or has no solution, that mean stands; the result is kept within
    [lowest - 500, highest + 500]."""
    dx, dy = (lambda n: n["x"] - F.col("qx")), (lambda n: n["y"] - F.col("qy"))
    sums = {
        "xx": lambda n: weight(n) * dx(n) * dx(n), "xy": lambda n: weight(n) * dx(n) * dy(n), "yy": lambda n: weight(n) * dy(n) * dy(n), "x1": lambda n: weight(n) * dx(n), "y1": lambda n: weight(n) * dy(n), "w": weight,
    }
    rows = found.withColumns({f"_{k}": _sum(f) for k, f in sums.items()})
    s = {k: F.col(f"_{k}") + (1e-9 if k in ("xx", "yy", "w") else 0.0) for k in sums}
    det = s["xx"] * (s["yy"] * s["w"] - s["y1"] * s["y1"]) - s["xy"] * (s["xy"] * s["w"] - s["y1"] * s["x1"]) + s["x1"] * (s["xy"] * s["y1"] - s["yy"] * s["x1"])
    for value, (lo, hi) in ranges.items():
        rows = rows.withColumns({"_xv": _sum(lambda n: weight(n) * dx(n) * n[value]), "_yv": _sum(lambda n: weight(n) * dy(n) * n[value]), "_v": _sum(lambda n: weight(n) * n[value])})
        xv, yv, v = F.col("_xv"), F.col("_yv"), F.col("_v")
        top = s["xx"] * (s["yy"] * v - yv * s["y1"]) - s["xy"] * (s["xy"] * v - yv * s["x1"]) + xv * (s["xy"] * s["y1"] - s["yy"] * s["x1"])
        flat, mean = F.try_divide(top, F.when(F.abs(det) > 1e-12, det)), v / F.col("_w")
        chosen = F.when(F.abs(flat - mean) <= max((hi - lo) / 2, 200.0), flat).otherwise(mean)
        rows = rows.withColumn(f"surface_{value}", F.greatest(F.lit(lo - 500), F.least(F.lit(hi + 500), chosen))).drop("_xv", "_yv", "_v")
    return rows.drop(*(f"_{k}" for k in sums))
