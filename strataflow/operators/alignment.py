"""Alignment of wells with their curves: one cogrouped map a well, rows sorted inside, or batches of wells that take each step together.

All kernels of a well share one shuffle of its rows and its curve. Random draws are seeded by the well's id, so results do
not depend on partitioning. Wells without hidden rows, with fewer than 10 known rows or 3 curve rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators import kernels

#: Fixed values of the method: (width, move cost, scale, smoothing radius) by name, and warp radii.
BEAMS = {
    "cons": (10, 20.0, 144.0, 2),
    "loose": (10, 8.0, 64.0, 2),
    "vcons": (8, 35.0, 220.0, 1),
    "sm5": (10, 14.0, 90.0, 5),
    "vloose": (20, 4.0, 36.0, 3),
    "mid": (12, 12.0, 100.0, 3),
    "stiff": (15, 25.0, 180.0, 2),
}
RADII = (20, 50, 100, 200)
GRID = 0.2  # step of regular curves
#: What a batch of wells may hold: bounds the states that are kept for the way back, and those of one step.
BATCH_ROWS, BATCH_WELLS = 20_000, 256
#: Offsets of the probes around each base.
PROBES = {
    "anchor": (-80, -40, -20, -10, -5, 0, 5, 10, 20, 40, 80),
    "beam": (-40, -20, -10, -5, -3, 0, 3, 5, 10, 20, 40),
    "ncc": (-30, -15, -8, -4, -2, 0, 2, 4, 8, 15, 30),
    "pf": (-30, -15, -8, -4, -2, 0, 2, 4, 8, 15, 30),
}
#: End offsets of straight paths, of paths beside the anchor, and of eased paths.
STRAIGHT = (-60, -40, -25, -15, -8, 0, 8, 15, 25, 40, 60)
BESIDE = (-80, -60, -40, -25, -15, -8, 0, 8, 15, 25, 40, 60, 80)
EASED = (-100, -80, -60, -45, -30, -20, -12, 0, 12, 20, 30, 45, 60, 80, 100)
SURFACES = tuple(f"s{k}" for k in range(6))
BEAM_COLUMNS = ", ".join(f"beam_{name} double" for name in (*BEAMS, "mean", "std"))
TEMPLATE_COLUMNS = "ncc8 double, ncc15 double, ncc25 double, score8 double, score15 double, score25 double, ncc double"
WARP_COLUMNS = ", ".join(f"dtw{r} double, slope{r} double" for r in RADII) + ", dtw double"


class Well:
    """A well's arrays, known rows first."""

    def __init__(self, rows: pd.DataFrame, knots: pd.DataFrame) -> None:
        rows, knots = rows.sort_values("row_id"), knots.sort_values("ctvt")
        self.id, self.row_id = (rows["well_id"].iloc[0] if len(rows) else None), rows["row_id"].to_numpy()
        self.md, self.z, self.gr, self.known = (rows[c].to_numpy(np.float64) for c in ("md", "z", "gr", "tvt_input"))
        self.depth, self.curve = knots["ctvt"].to_numpy(np.float64), knots["cgr"].to_numpy(np.float64)
        self.more = {c: rows[c].to_numpy(np.float64) for c in rows.columns if c not in ("well_id", "row_id", "md", "z", "gr", "tvt_input")}
        gaps = np.flatnonzero(~np.isfinite(self.known))
        self.k = int(gaps[0]) if len(gaps) else len(rows)
        self.usable = self.k < len(rows) and self.k >= 10 and len(knots) >= 3
        if self.usable:
            self.signal = kernels.filled_signal(self.gr, float(self.curve.mean()))
            self.last = float(self.known[self.k - 1])

    def rng(self) -> np.random.Generator:
        return np.random.default_rng(zlib.crc32(str(self.id).encode()))

    def noise(self) -> float:
        on = np.isfinite(self.gr[: self.k])
        if on.sum() < 20:
            return 30.0
        return float(np.clip(np.std(self.gr[: self.k][on] - np.interp(self.known[: self.k][on], self.depth, self.curve)), 10, 60))


def spread(rows: DataFrame) -> DataFrame:
    """rows by well, over as many tasks as shuffles have partitions: work here is far above what the bytes of rows tell, by which small partitions would be joined."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "well_id")


def per_well(wells: DataFrame, curves: DataFrame, columns: str, work: Callable[[Well], dict[str, np.ndarray]], hidden_only: bool = True, more: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """well_id, row_id and the columns that work gives for each hidden row (or each row) of a well; `more` numeric columns of wells go along. dealt: wells come from spread(), and are not moved again."""
    names = [x.split()[0] for x in columns.split(", ")]

    def apply(rows: pd.DataFrame, knots: pd.DataFrame) -> pd.DataFrame:
        well = Well(rows, knots)
        at = well.row_id[well.k if hidden_only else 0 :] if well.usable else np.zeros(0, np.int64)
        out = work(well) if well.usable else dict.fromkeys(names, np.zeros(0))
        # ids as plain objects: columns of pandas' own string type may come back in several pieces
        return pd.DataFrame({"well_id": pd.Series([well.id] * len(at), dtype=object), "row_id": at, **out})

    left = wells.select("well_id", "row_id", "md", "z", "gr", "tvt_input", *more)
    left = (left if dealt else spread(left)).groupBy("well_id")
    return left.cogroup(spread(curves).groupBy("well_id")).applyInPandas(apply, f"well_id string, row_id long, {columns}")


def per_batch(wells: DataFrame, curves: DataFrame, columns: str, work: Callable[[list[Well]], list[dict[str, np.ndarray]]]) -> DataFrame:
    """As per_well for hidden rows, with work called for batches of usable wells, of BATCH_ROWS rows or BATCH_WELLS wells and one well more at most.

    Rows and curves meet by one shuffle and one sort; a task takes whole wells from its sorted rows as they come, so wells
    need no grouping of their own and what a task holds does not grow with its rows.
    """
    names = [x.split()[0] for x in columns.split(", ")]
    c = F.col
    numbers, of_curve = ("md", "z", "gr", "tvt_input"), ("ctvt", "cgr")
    rows = wells.select(c("well_id").cast("string"), F.lit(True).alias("is_row"), c("row_id").cast("long"), *(c(n).cast("double").alias(n) for n in numbers), *(F.lit(None).cast("double").alias(n) for n in of_curve))
    knots = curves.select(c("well_id").cast("string"), F.lit(False).alias("is_row"), F.lit(0).cast("long").alias("row_id"), *(F.lit(None).cast("double").alias(n) for n in numbers), *(c(n).cast("double").alias(n) for n in of_curve))
    met = spread(rows.unionByName(knots)).sortWithinPartitions("well_id", "is_row", "row_id", "ctvt")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[Well] = []
        for frame in _whole_wells(batches):
            well = Well(frame[frame["is_row"]].drop(columns=["is_row", *of_curve]), frame[~frame["is_row"]][list(of_curve)])
            if well.usable:
                pending.append(well)
            if len(pending) >= BATCH_WELLS or sum(len(w.row_id) for w in pending) >= BATCH_ROWS:
                yield told(pending)
                pending = []
        if pending:
            yield told(pending)

    def told(batch: list[Well]) -> pd.DataFrame:
        found = work(batch)
        ids = pd.Series([w.id for w in batch for _ in w.row_id[w.k :]], dtype=object)
        return pd.DataFrame({"well_id": ids, "row_id": np.concatenate([w.row_id[w.k :] for w in batch]), **{n: np.concatenate([f[n] for f in found]) for n in names}})

    return met.mapInPandas(apply, f"well_id string, row_id long, {columns}")


def _whole_wells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame a well, of batches that are sorted by well."""
    held: list[pd.DataFrame] = []
    last: str | None = None
    for batch in batches:
        codes = pd.factorize(batch["well_id"], use_na_sentinel=False)[0]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(batch)], strict=True):
            part = batch.iloc[lo:hi]
            key = None if pd.isna(part["well_id"].iloc[0]) else part["well_id"].iloc[0]
            if held and key != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held, last = [*held, part], key
    if held:
        yield pd.concat(held, ignore_index=True)


def beams_of_wells(batch: list[Well]) -> list[dict[str, np.ndarray]]:
    """A path for each of BEAMS, their mean and deviation, for each well."""
    widths, moves, scales, radii = (np.array([b[i] for b in BEAMS.values()]) for i in range(4))
    signals = [np.stack([kernels.centered_mean(w.signal[w.k :], 2 * r + 1) if r else w.signal[w.k :] for r in radii]) for w in batch]
    starts = [min(int(np.searchsorted(w.depth, w.last)), len(w.depth) - 1) for w in batch]
    out = []
    for well, found in zip(batch, kernels.beams_of_wells(signals, [w.curve for w in batch], starts, widths, moves, scales), strict=True):
        paths = {f"beam_{name}": well.depth[path] for name, path in zip(BEAMS, found, strict=True)}
        both = np.stack(list(paths.values()), 1)
        out.append(paths | {"beam_mean": both.mean(1), "beam_std": both.std(1)})
    return out


def beams(well: Well) -> dict[str, np.ndarray]:
    return beams_of_wells([well])[0]


def templates(well: Well) -> dict[str, np.ndarray]:
    """Template matches at three scales and their blend."""
    known, depth, signal = well.signal[: well.k], well.known[: well.k], well.signal[well.k :]
    found = [kernels.template_match(known, depth, signal, half) for half in (8, 15, 25)]
    d, s = np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)
    return {"ncc8": d[:, 0], "ncc15": d[:, 1], "ncc25": d[:, 2], "score8": s[:, 0], "score15": s[:, 1], "score25": s[:, 2], "ncc": kernels.template_blend(d, s)}


def _rates(well: Well, value: np.ndarray, last: int) -> float:
    """Median rate per md over the last known rows, 0 with fewer than three steps."""
    lo = max(0, well.k - last)
    dm = np.diff(well.md[lo : well.k])
    on = dm > 0
    return float(np.median(np.diff(value[lo : well.k])[on] / dm[on])) if on.sum() >= 3 else 0.0


def surface_filters(batch: list[Well]) -> list[dict[str, np.ndarray]]:
    def given(w: Well) -> dict:
        grid, start = kernels.regular_grid(w.depth, w.curve, GRID)
        h, surface = slice(w.k, None), w.known + w.z
        return {"md": w.md[h], "z": w.z[h], "gr": w.gr[h], "curve": grid, "start": start, "noise": w.noise(), "surface": float(surface[w.k - 1]), "rate": _rates(w, surface, 30), "rng": w.rng()}

    return [{"pf_mean": mean, "pf_std": std} for mean, std in kernels.surfaces_of_wells([given(w) for w in batch], GRID)]


def surface_filter(well: Well) -> dict[str, np.ndarray]:
    return surface_filters([well])[0]


def velocity_filters(batch: list[Well]) -> list[dict[str, np.ndarray]]:
    def given(w: Well) -> dict:
        grid, start = kernels.regular_grid(w.depth, w.curve, GRID)
        smooth_grid, _ = kernels.regular_grid(w.depth, kernels.centered_mean(w.curve, 5), GRID)
        h, k = slice(w.k, None), slice(0, w.k)
        dm = np.diff(w.md[k])
        on = dm > 0
        beta, shift, spread = -1.0, 0.0, 0.1
        if on.sum() >= 10:
            a = np.column_stack([np.diff(w.z[k])[on] / dm[on], np.ones(on.sum())])
            v = np.diff(w.known[k])[on] / dm[on]
            beta, shift = np.linalg.lstsq(a, v, rcond=None)[0]
            spread = max(float(np.std(v - a @ [beta, shift])), 0.001)
        rows = {"md": w.md[h], "z": w.z[h], "gr": w.gr[h], "smooth": kernels.centered_mean(w.signal, 5)[h]}
        curves = {"curve": grid, "curve_smooth": smooth_grid, "start": start}
        return rows | curves | {"noise": w.noise(), "depth": w.last, "speed": _rates(w, w.known, 20), "beta": float(beta), "shift": float(shift), "spread": spread, "rng": w.rng()}

    return [{"pfz_mean": mean, "pfz_std": std} for mean, std in kernels.velocities_of_wells([given(w) for w in batch], GRID)]


def velocity_filter(well: Well) -> dict[str, np.ndarray]:
    return velocity_filters([well])[0]


def warps(well: Well, radii: tuple[int, ...] = RADII) -> dict[str, np.ndarray]:
    """Banded warps of the whole signal to the curve: depth and local slope by radius, and their mean."""
    out = {}
    for radius, col in zip(radii, kernels.band_paths(well.signal, well.curve, radii), strict=True):
        out[f"dtw{radius}"], out[f"slope{radius}"] = well.depth[col], kernels.local_slope(col)
    return out | {"dtw": np.mean([out[f"dtw{r}"] for r in radii], axis=0)}


def random_warps(well: Well) -> dict[str, np.ndarray]:
    """Mean, deviation and its share of the mean over 12 noisy warps."""
    paths = kernels.stochastic_warps(*kernels.band(well.signal, well.curve, 50), len(well.curve), 12, 3.0, well.rng())
    depth = well.depth[paths]
    return {"mean": depth.mean(0), "std": depth.std(0), "cv": depth.std(0) / (np.abs(depth.mean(0)) + 1e-6)}


def savgol_by_well(rows: DataFrame, value: str, window: int = 17, degree: int = 3) -> DataFrame:
    """well_id, row_id, smooth."""

    def apply(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_id")
        return pd.DataFrame({"well_id": part["well_id"], "row_id": part["row_id"], "smooth": kernels.savgol(part[value].to_numpy(np.float64), window, degree)})

    return rows.select("well_id", "row_id", value).groupBy("well_id").applyInPandas(apply, "well_id string, row_id long, smooth double")
