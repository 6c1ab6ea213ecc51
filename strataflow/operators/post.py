"""Post-processing of predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.scalar import clip
from strataflow.operators.quantiles import quantiles


def smoothed(predictions: DataFrame, id_col: str, value_col: str, window: int, share: float) -> DataFrame:
    """Adds smoothed: value * (1 - share) + centred mean * share, within the group that the id names before its last underscore."""
    pattern = "^(.*)_([0-9]+)$"
    by = Window.partitionBy(F.regexp_extract(id_col, pattern, 1)).orderBy(F.regexp_extract(id_col, pattern, 2).cast("long")).rowsBetween(-(window // 2), window // 2)
    return predictions.withColumn("smoothed", (1 - share) * F.col(value_col) + share * F.avg(value_col).over(by))


def decayed(residual: Column, since: Column, alpha: float, tau: float | None) -> Column:
    """alpha * residual, damped near the anchor by 1 - exp(-since / tau)."""
    return alpha * residual if not tau else alpha * residual * (1 - F.exp(-since / tau))


def grid_search(rows: DataFrame, residual: str, target: str, since: str, alphas: Sequence[float], taus: Sequence[float]) -> DataFrame:
    """alpha, tau (0: none), rmse of every pair in one scan; the first of equals in alpha-major order ranks first.

    Each row gives three sums for each tau, from which the error of every alpha follows: sum(t^2) - 2 a sum(t p) + a^2 sum(p^2).
    """
    p = {i: F.col(residual) * (F.lit(1.0) if not tau else 1 - F.exp(-F.col(since) / tau)) for i, tau in enumerate(taus)}
    t = F.col(target)
    sums = [F.sum(t * t).alias("tt"), F.count(t).alias("n"), *(s for i in p for s in (F.sum(t * p[i]).alias(f"tp{i}"), F.sum(p[i] * p[i]).alias(f"pp{i}")))]
    once = rows.agg(*sums)
    cells = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(tau or 0)).alias("tau"), F.lit(j * len(taus) + i).alias("place"), F.sqrt((F.col("tt") - 2 * a * F.col(f"tp{i}") + a * a * F.col(f"pp{i}")) / F.col("n")).alias("rmse")) for j, a in enumerate(alphas) for i, tau in enumerate(taus)))
    return once.select(F.explode(cells).alias("x")).select("x.*")


def median_optimum(alphas: Sequence[float], taus: Sequence[float | None], least_tau: float = 12.5) -> tuple[float, float | None]:
    """Medians of the folds' optima; a missing tau counts as 0, and a median below least_tau means none."""
    middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    tau = middle([t or 0.0 for t in taus])
    return middle(list(alphas)), tau if tau >= least_tau else None


def quantile_clip(rows: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Adds clipped: value within its own exact quantiles, which are found before (a few passes over the column)."""
    least, most = quantiles(rows, value, [lo, hi])
    return rows.withColumn("clipped", F.col(value) if least is None else clip(F.col(value), least, most))


def confidence_gate(corr: Column, missing: Column, local_gap: Column, local_min: Column, path_gap: Column, curvature: Column, frac: Column) -> Column:
    """A factor within 0.55 and 1 from seven signs of trust; absent signs have neutral values."""
    share = lambda x, absent, start, width: clip((F.coalesce(x, F.lit(absent)) - start) / width, 0.0, 1.0)
    gate = (
        0.88
        + 0.08 * clip(F.coalesce(corr, F.lit(0.0)), -0.5, 1.0)
        - 0.12 * share(missing, 0.35, 0.30, 0.45)
        + 0.08 * share(local_gap, 0.0, 0.0, 8.0)
        + 0.05 * share(path_gap, 0.0, 0.0, 8.0)
        - 0.10 * share(local_min, 8.0, 6.0, 18.0)
        - 0.05 * share(F.abs(curvature), 0.0, 0.0, 0.2)
        + 0.04 * F.sin(math.pi * clip(frac, 0.0, 1.0))
    )
    return clip(gate, 0.55, 1.0)


def prior_blend(prediction: Column, endpoint: Column, frac: Column, weight: float = 0.06) -> Column:
    """Blends in a prior that eases from the anchor to an endpoint."""
    f = clip(frac, 0.0, 1.0)
    return (1 - weight) * prediction + weight * F.coalesce(endpoint * (3 * f * f - 2 * f * f * f), F.lit(0.0))
