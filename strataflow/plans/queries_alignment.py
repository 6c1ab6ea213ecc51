"""Kernels over wells as queries; SQL has no form for them, so tests compare them with exhaustive search and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators import alignment as al
from strataflow.plans.wellview import curve, wells


def _run(columns: str, work, hidden_only: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return al.per_well(wells(spark, sf_dir), curve(spark, sf_dir), columns, work, hidden_only)

    return query


def _run_batched(columns: str, work):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return al.per_batch(wells(spark, sf_dir), curve(spark, sf_dir), columns, work)

    return query


def savgol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.savgol_by_well(wells(spark, sf_dir).filter(F.col("tvt_input").isNull()), "tvt")


QUERIES = {
    "beam_align": _run_batched(al.BEAM_COLUMNS, al.beams_of_wells),
    "ncc_match": _run(al.TEMPLATE_COLUMNS, al.templates),
    "pf_surface": _run_batched("pf_mean double, pf_std double", al.surface_filters),
    "pf_velocity": _run_batched("pfz_mean double, pfz_std double", al.velocity_filters),
    "dtw_band": _run(al.WARP_COLUMNS, al.warps, False),
    "dtw_stochastic": _run("mean double, std double, cv double", al.random_warps, False),
    "savgol": savgol,
}
ORACLES: dict[str, str] = {}
