"""Largest-first packing against dealing the groups one by one; warps of several bands against one at a time."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strataflow.operators import folds, kernels


def dealt(sizes: list[int], k: int) -> list[int]:
    loads, out = [0] * k, []
    for s in sizes:
        f = min(range(k), key=lambda f: (loads[f], f))
        loads[f] += s
        out.append(f)
    return out


def test_packing_of_runs_is_dealing_one_by_one():
    for seed in range(400):
        r = random.Random(seed)
        k = r.randint(1, 7)
        runs = [(s, r.choice([1, 2, 3, 10, r.randint(1, 60)])) for s in r.sample(range(1, r.choice([8, 40, 1000])), r.randint(1, 6))]
        found = folds.packed(runs, k)
        want = dealt([s for s, m in sorted(runs, reverse=True) for _ in range(m)], k)
        got = []
        for s, m in sorted(runs, reverse=True):
            assert len(found[s]) <= k
            for p in range(m):
                start, turn = [x for x in found[s] if x[0] <= p][-1]
                got.append(turn[(p - start) % len(turn)])
        assert got == want


def test_packed_groups(spark):
    r = random.Random(5)
    pdf = pd.DataFrame([(f"g{i}", r.choice([3, 3, 3, 3, 7, 50, r.randint(1, 400)])) for i in range(700)], columns=["g", "n"])
    groups = spark.createDataFrame(pdf)
    got = folds.balanced(groups, "g", 4).toPandas()
    assert sorted(got.g) == sorted(pdf.g)
    ordered = got.assign(d=[__import__("hashlib").md5(g.encode()).hexdigest() for g in got.g]).sort_values(["n", "d"], ascending=[False, True])
    assert ordered.fold.tolist() == dealt(ordered.n.tolist(), 4)
    assert folds.balanced(groups.filter(F.lit(False)), "g", 4).count() == 0


def test_bands_of_one_call_are_those_of_single_calls():
    for seed in range(40):
        r = np.random.default_rng(seed)
        n, m = r.integers(1, 60, 2)
        a, b = (r.integers(0, 4, n).astype(float), r.integers(0, 4, m).astype(float)) if seed % 2 else (r.normal(size=n), r.normal(size=m))
        radii = (2, 9, 5, 100)
        for radius, path in zip(radii, kernels.band_paths(a, b, radii, 7), strict=True):
            cost, low = kernels.band(a, b, radius)
            np.testing.assert_array_equal(path, kernels.band_path(cost, low, m))
