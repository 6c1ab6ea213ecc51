"""Operators that SQL text can call: table functions over the rows of a well.

    SELECT * FROM resampled(TABLE(knots) PARTITION BY (well_id) ORDER BY (ctvt), 2.0)
    SELECT * FROM curve_probes(TABLE(signals_and_knots) PARTITION BY (well_id), array(-5.0D, 0.0D, 5.0D))
    SELECT * FROM beam_paths(TABLE(wells_and_knots) PARTITION BY well_id)

Spark deals the wells to tasks by PARTITION BY; a function holds one well at a time, as the grouped maps do. A function has
one table, so rows and knots of a well come in one, told apart by ctvt, which only knots have; a row's other columns are
NULL then. `register` makes the functions known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from strataflow.operators import alignment


class _Well:
    """Gathers a well's rows and knots."""

    ROW: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.id: str | None = None
        self.rows: list[tuple] = []
        self.knots: list[tuple[float, float]] = []

    def add(self, row: Row) -> None:
        self.id = row["well_id"]
        if row["ctvt"] is not None:
            self.knots.append((row["ctvt"], row["cgr"]))
        else:
            self.rows.append(tuple(row[c] for c in self.ROW))


class Resampled(_Well):
    """The knots' curve at even steps from its start to its end or just beyond it."""

    RETURNS = "well_id string, i long, tvt double, gr double"

    def eval(self, row: Row, step: float) -> None:
        self.add(row)
        self.step = float(step)

    def terminate(self) -> Iterator[tuple]:
        if self.knots:
            depth, value = np.array(sorted(self.knots), float).T
            i = np.arange(int(np.ceil((depth[-1] - depth[0]) / self.step)) + 1)
            at = depth[0] + i * self.step
            for n, x, y in zip(i.tolist(), at.tolist(), np.interp(at, depth, value).tolist(), strict=True):
                yield self.id, n, x, y


class CurveProbes(_Well):
    """For each row and offset: the signal minus the curve at the anchor and the offset; NULL without a curve or a signal."""

    ROW = ("row_id", "signal", "anchor")
    RETURNS = "well_id string, row_id long, off double, diff double"

    def eval(self, row: Row, offsets: list[float]) -> None:
        self.add(row)
        self.offsets = [float(o) for o in offsets]

    def terminate(self) -> Iterator[tuple]:
        knots = np.array(sorted(self.knots), float).T if self.knots else None
        for row_id, signal, anchor in self.rows:
            whole = knots is not None and signal is not None and anchor is not None
            for off in self.offsets:
                yield self.id, row_id, off, float(signal - np.interp(anchor + off, *knots)) if whole else None


class BeamPaths(_Well):
    """alignment.beams of each hidden row of a well that is fit for it."""

    ROW = ("row_id", "md", "z", "gr", "tvt_input")
    RETURNS = f"well_id string, row_id long, {alignment.BEAM_COLUMNS}"

    def eval(self, row: Row) -> None:
        self.add(row)

    def terminate(self) -> Iterator[tuple]:
        rows = pd.DataFrame(self.rows, columns=list(self.ROW)).astype({c: float for c in self.ROW[1:]}).assign(well_id=self.id)
        well = alignment.Well(rows, pd.DataFrame(self.knots, columns=["ctvt", "cgr"], dtype=float))
        if well.usable:
            found = alignment.beams(well)
            names = [x.split()[0] for x in alignment.BEAM_COLUMNS.split(", ")]
            for at, *values in zip(well.row_id[well.k :].tolist(), *(found[n].tolist() for n in names), strict=True):
                yield (self.id, int(at), *values)


FUNCTIONS = {"resampled": Resampled, "curve_probes": CurveProbes, "beam_paths": BeamPaths}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, returnType=function.RETURNS, useArrow=True))
