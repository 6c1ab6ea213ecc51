"""Kernels against exhaustive search and invariants."""

import itertools

import numpy as np
import pandas as pd
import pytest

from strataflow.operators import kernels, models


def cost(path, signal, curve, start, move, scale):
    steps = np.diff(np.concatenate([[start], path]))
    return ((signal - curve[path]) ** 2 / scale).sum() + move * np.abs(steps).sum() if np.abs(steps).max() <= 2 else np.inf


@pytest.mark.parametrize("seed", range(5))
def test_wide_beam_is_the_cheapest_path(seed):
    rng = np.random.default_rng(seed)
    signal, curve = rng.normal(size=5), rng.normal(size=6)
    path = kernels.beam_path(signal, curve, 2, 100, 0.3, 0.5)
    best = min(cost(np.array(p), signal, curve, 2, 0.3, 0.5) for p in itertools.product(range(6), repeat=5))
    assert cost(path, signal, curve, 2, 0.3, 0.5) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(5))
def test_band_table_is_the_textbook_table(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=9), rng.normal(size=7)
    want = np.full((9, 7), np.inf)
    for i in range(9):
        for j in range(7):
            before = 0.0 if i == j == 0 else min((want[i - 1, j - 1] if i and j else np.inf), (want[i - 1, j] if i else np.inf), (want[i, j - 1] if j else np.inf))
            want[i, j] = before + (a[i] - b[j]) ** 2
    cost, low = kernels.band(a, b, 50)
    assert cost.shape == (9, 101)
    got = np.array([cost[i, -low[i] : 7 - low[i]] for i in range(9)])
    np.testing.assert_allclose(got, want)
    narrow, at = kernels.band(a, b, 2)
    assert narrow.shape == (9, 5) and narrow[-1, 6 - at[-1]] >= want[-1, -1] - 1e-12
    # the path back, cell by cell
    i, j, last = 8, 6, {8: 6}
    while i or j:
        ways = [(want[x, y] if x >= 0 and y >= 0 else np.inf, k, x, y) for k, (x, y) in enumerate(((i - 1, j - 1), (i - 1, j), (i, j - 1)))]
        _, _, i, j = min(ways)
        last.setdefault(i, j)
    assert kernels.band_path(cost, low, 7).tolist() == [last[i] for i in range(9)]


def test_warp_of_equal_sequences_is_the_diagonal():
    x = np.sin(np.arange(40) / 3)
    col = kernels.band_path(*kernels.band(x, x, 5), 40)
    np.testing.assert_array_equal(col, np.arange(40))
    np.testing.assert_allclose(kernels.local_slope(col), 1.0)
    assert kernels.local_slope(np.array([3])).tolist() == [1.0]
    long = np.sin(np.arange(4000) / 50)
    assert kernels.band(long, long[::2], 20)[0].nbytes < 2e6  # a whole table would take 64 MB


def test_beams_of_one_call_are_those_of_single_calls():
    rng = np.random.default_rng(6)
    curve, signals = rng.normal(size=30), rng.normal(size=(3, 40))
    widths, moves, scales = np.array([1, 4, 9]), np.array([0.1, 0.4, 0.2]), np.array([0.5, 1.0, 2.0])
    both = kernels.beam_paths(signals, curve, 12, widths, moves, scales)
    for k in range(3):
        assert both[k].tolist() == kernels.beam_path(signals[k], curve, 12, int(widths[k]), moves[k], scales[k]).tolist()


def test_regular_grid_lookup_is_interpolation():
    rng = np.random.default_rng(7)
    grid = rng.normal(size=50)
    at = rng.uniform(-5, 20, 500)
    np.testing.assert_allclose(kernels.on_grid(grid, 1.0, 0.2, at), np.interp(at, 1.0 + 0.2 * np.arange(50), grid))
    assert kernels.on_grid(grid[:1], 1.0, 0.2, at).tolist() == [grid[0]] * 500


def test_particles_follow_a_known_surface():
    depth = np.arange(0, 200, 1.0)
    curve = 50 + 40 * np.sin(depth / 7)
    grid, start = kernels.regular_grid(depth, curve, 0.2)
    md = np.arange(1, 150.0)
    true = 60 + 0.3 * md
    gr = np.interp(true, depth, curve)
    z = np.zeros(len(md))
    given = {"md": md, "z": z, "gr": gr, "smooth": gr, "curve": grid, "curve_smooth": grid, "start": start, "noise": 10.0}
    surface = lambda: given | {"surface": 60.0, "rate": 0.3, "rng": np.random.default_rng(1)}
    speed = lambda: given | {"depth": 60.0, "speed": 0.3, "beta": 0.0, "shift": 0.3, "spread": 0.05, "rng": np.random.default_rng(2)}
    mean, std = kernels.surfaces_of_wells([surface()], 0.2)[0]
    assert np.abs(mean - true).mean() < 2 and (std >= 0).all()
    v, _ = kernels.velocities_of_wells([speed()], 0.2)[0]
    assert np.abs(v - true).mean() < 3
    # wells of other lengths, with gaps in the signal, change nothing of a well in their batch
    short = {"md": md[:20] * 2, "z": z[:20] - 3, "gr": np.where(np.arange(20) % 3, 70.0, np.nan), "smooth": np.full(20, np.nan), "curve": grid[:90]}
    for run, well, want in ((kernels.surfaces_of_wells, surface, mean), (kernels.velocities_of_wells, speed, v)):
        other = lambda n: well() | {k: x[:n] if k != "curve" else x for k, x in short.items()} | {"rng": np.random.default_rng(n)}  # noqa: B023, E731
        got = run([other(5), well(), other(20), other(0)], 0.2)
        assert [len(m) for m, _ in got] == [5, len(md), 20, 0]
        np.testing.assert_allclose(got[1][0], want, rtol=1e-9)
        np.testing.assert_allclose(got[2][0], run([other(20)], 0.2)[0][0], rtol=1e-9)
    assert kernels.surfaces_of_wells([], 0.2) == []


def test_beams_of_a_batch_are_those_of_each_well():
    rng = np.random.default_rng(8)
    widths, moves, scales = np.array([2, 6]), np.array([0.2, 0.5]), np.array([0.5, 1.5])
    lengths, sizes = [7, 0, 31, 7, 1], [12, 4, 40, 3, 9]
    signals, curves, starts = [rng.normal(size=(2, n)) for n in lengths], [rng.normal(size=m) for m in sizes], [5, 0, 20, 2, 8]
    got = kernels.beams_of_wells(signals, curves, starts, widths, moves, scales)
    for i in range(len(lengths)):
        assert got[i].shape == (2, lengths[i])
        assert got[i].tolist() == kernels.beam_paths(signals[i], curves[i], starts[i], widths, moves, scales).tolist()


def test_template_match_finds_a_copy():
    rng = np.random.default_rng(3)
    known = rng.normal(size=120).cumsum()
    depth = np.arange(120.0)
    found, score = kernels.template_match(known, depth, known[30:71], 8, stride=1)
    assert np.abs(found[10:30] - depth[40:60]).max() <= 1 and score[10:30].min() > 0.99
    none, zero = kernels.template_match(known[:5], depth[:5], known[:4], 8)
    assert (none == depth[4]).all() and (zero == 0).all()


def test_small_kernels():
    assert kernels.filled_signal(np.array([np.nan, np.nan]), 7.0).tolist() == [7.0, 7.0]
    assert kernels.filled_signal(np.array([np.nan, 1, np.nan, 3, np.nan]), 0.0).tolist() == [1, 1, 2, 3, 3]
    x = np.random.default_rng(0).normal(size=31)
    np.testing.assert_allclose(kernels.centered_mean(x, 5), pd.Series(x).rolling(5, center=True, min_periods=1).mean())
    cubic = np.arange(40.0) ** 3
    np.testing.assert_allclose(kernels.savgol(cubic, 17, 3), cubic, rtol=1e-6, atol=1e-4)
    assert kernels.savgol(np.array([1.0, 2.0]), 17, 3).tolist() == [1.0, 2.0]
    picks = kernels.systematic(np.array([0.0, 0.5, 0.5]), np.random.default_rng(0))
    assert set(picks.tolist()) <= {1, 2}


def test_weights_from_the_gram_matrix():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(500, 3))
    t = a @ [0.7, 0.3, 0.0]
    g, b = a.T @ a, a.T @ t
    np.testing.assert_allclose(models.simplex_weights(g, b), [0.7, 0.3, 0.0], atol=1e-6)
    np.testing.assert_allclose(models.positive_ridge(g, b, 1e-9), [0.7, 0.3, 0.0], atol=1e-6)
    assert models.error(g, b, t @ t, 500, np.array([0.7, 0.3, 0.0])) == pytest.approx(0, abs=1e-6)
    assert models.robust_iterations([10, 20, 30]) == 50 and models.robust_iterations([100, 200, 300]) == 220
