"""The feature table of hidden rows: one partitioning by well for all window features, then the curve and the kernels joined on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.ordered import Order, diff, interpolate, lag_filled, lead_filled, rolling, slope_per

WINDOWS, LAGS = (5, 21, 51, 101), (1, 5, 15, 30)


def window_features(wells: DataFrame, order: Order) -> tuple[DataFrame, list[str]]:
    """Hidden rows with their target (depth minus the last known depth) and features; and the features' names.

    Windows see the whole well; only afterwards are known rows left out, since features may use known neighbours.
    """
    rows, names = all_rows(wells, order)
    return rows.filter("hidden").select("well_id", "row_id", "target", *names), names


def all_rows(wells: DataFrame, order: Order) -> tuple[DataFrame, list[str]]:
    """wells with features, target and hidden (whether the row is asked for), in the partitions of the windows; and the features' names."""
    c = F.col
    known = c("tvt_input").isNotNull()
    anchor = F.last(F.when(known, F.struct("tvt_input", "md", "x", "y", "z")), ignorenulls=True).over(order.whole)
    rows = wells.withColumn("grf", F.coalesce(interpolate(c("gr"), order, c("row_id")), F.lit(0.0))).withColumn("a", anchor)
    hidden_place = F.count_if(~known).over(order.so_far) - 1
    frac = hidden_place / F.greatest(F.count_if(~known).over(order.whole) - 1, F.lit(1))
    feats = {
        "md_since": c("md") - c("a.md"), "dx": c("x") - c("a.x"), "dy": c("y") - c("a.y"), "dz": c("z") - c("a.z"), "last_known": c("a.tvt_input"), "frac": frac, "grf_d1": F.coalesce(diff(c("grf"), order), F.lit(0.0)), "gr_before": F.sum(F.when(known, c("grf"))).over(order.whole),
        "gr_energy": rolling(c("grf"), order.centered(21), "rms"), "gr_envelope": rolling(c("grf"), order.centered(21), "max"), "gr_cumsum": F.sum("grf").over(order.so_far),
        **{f"grm{w}": rolling(c("grf"), order.centered(w), "mean") for w in WINDOWS}, **{f"grs{w}": F.coalesce(rolling(c("grf"), order.centered(w), "std"), F.lit(0.0)) for w in WINDOWS},
        **{f"glag{k}": lag_filled(c("grf"), order, k) for k in LAGS}, **{f"glead{k}": lead_filled(c("grf"), order, k) for k in LAGS}, **{f"d{v}_dmd": slope_per(c(v), c("md"), order) for v in "xyz"},
    }
    out = rows.withColumns(feats).withColumn("dxy", F.sqrt(c("dx") * c("dx") + c("dy") * c("dy"))).withColumn("dist", F.sqrt(c("dxy") * c("dxy") + c("dz") * c("dz")))
    out = out.withColumns({"grf_d2": F.coalesce(diff(c("grf_d1"), order), F.lit(0.0)), "frac2": c("frac") * c("frac"), "sqrt_frac": F.sqrt(F.greatest(c("frac"), F.lit(0.0))), "gr_cumsum": c("gr_cumsum") - c("gr_before")})
    out = out.withColumn("hidden", ~known & c("a").isNotNull()).withColumn("target", c("tvt") - c("last_known"))
    names = [*(f for f in feats if f != "gr_before"), "dxy", "dist", "grf_d2", "frac2", "sqrt_frac", "x", "y", "z", "grf"]
    return out, names
