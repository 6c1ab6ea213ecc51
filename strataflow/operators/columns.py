"""Choice and alignment of feature columns, from schemas alone."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chosen(df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), excluded: Sequence[str] = (), most: int | None = None) -> list[str]:
    """Numeric columns that are named or have a prefix or suffix (all numeric ones if none is given), without the excluded, in schema order."""
    rules = bool(names or prefixes or suffixes)
    numeric = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    out = [n for n in numeric if n not in excluded and (not rules or n in names or n.startswith(tuple(prefixes)) or n.endswith(tuple(suffixes)))] if rules else [n for n in numeric if n not in excluded]
    if most is not None and len(out) > most:
        raise ValueError(f"{len(out)} columns chosen, at most {most} allowed")
    return out


def common(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that both have, in the given order."""
    both = set(a.columns) & set(b.columns)
    return [c for c in columns if c in both]


def aligned(df: DataFrame, columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """df with exactly the columns; absent ones are filled, or an error without a fill."""
    absent = [c for c in columns if c not in df.columns]
    if absent and fill is None:
        raise ValueError(f"absent columns: {absent}")
    return df.select(*(F.col(c) if c not in absent else F.lit(fill).alias(c) for c in columns))


def without_groups(columns: Sequence[str], prefixes: Sequence[str]) -> tuple[list[str], dict[str, int]]:
    """Columns without those of the prefix groups, and how many each group lost."""
    dropped = {p: sum(c.startswith(p) for c in columns) for p in prefixes}
    return [c for c in columns if not c.startswith(tuple(prefixes))], dropped


def write_summary(values: dict, path: str) -> None:
    """A small JSON file of driver-side figures."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2, sort_keys=True)
