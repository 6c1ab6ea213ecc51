"""Sequence kernels in NumPy, over the rows of one well or of a batch of wells. They are called from maps in operators.alignment.

A step's state (beam, particles, band of a table) is an array operation; only steps along the well are a Python loop.
"""

from __future__ import annotations

import numpy as np


def filled_signal(gr: np.ndarray, fallback: float) -> np.ndarray:
    """Gaps interpolated by position, nearest at the ends; fallback if there is no value."""
    ok = np.isfinite(gr)
    return np.interp(np.arange(len(gr)), np.flatnonzero(ok), gr[ok]) if ok.any() else np.full(len(gr), fallback)


def centered_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean over up to n // 2 values on either side."""
    h, sums = n // 2, np.concatenate([[0.0], np.cumsum(x)])
    lo, hi = np.maximum(np.arange(len(x)) - h, 0), np.minimum(np.arange(len(x)) + h + 1, len(x))
    return (sums[hi] - sums[lo]) / (hi - lo)


def regular_grid(depth: np.ndarray, value: np.ndarray, step: float) -> tuple[np.ndarray, float]:
    at = np.arange(depth[0], depth[-1] + step, step)
    return np.interp(at, depth, value), float(depth[0])


def on_grid(grid: np.ndarray, start: float, step: float, at: np.ndarray) -> np.ndarray:
    """Linear between grid values, the end values beyond; the grid is regular, so each place is computed, not searched."""
    place = np.clip((at - start) / step, 0, len(grid) - 1)
    low = np.minimum(place.astype(np.int64), max(len(grid) - 2, 0))
    return grid[low] + (grid[np.minimum(low + 1, len(grid) - 1)] - grid[low]) * (place - low)


class Ragged:
    """Rows of several wells, step by step: the longest wells come first, so those with a step t are the first active[t] ones and nothing is padded."""

    def __init__(self, lengths: list[int]) -> None:
        self.order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
        self.lengths = np.asarray(lengths, np.int64)[self.order]
        self.active = np.searchsorted(-self.lengths, -np.arange(self.lengths.max(initial=0)), side="left")
        self.first = np.concatenate([[0], np.cumsum(self.active)])

    def step(self, t: int) -> slice:
        return slice(self.first[t], self.first[t + 1])

    def pack(self, arrays: list[np.ndarray]) -> np.ndarray:
        """One array of all rows, in order of (step, well)."""
        out = np.empty((self.first[-1], *arrays[0].shape[1:]))
        for rank, i in enumerate(self.order):
            out[self.first[: self.lengths[rank]] + rank] = arrays[i]
        return out

    def unpack(self, rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [rows[:0]] * len(self.order)
        for rank, i in enumerate(self.order):
            out[i] = rows[self.first[: self.lengths[rank]] + rank]
        return out


class Curves:
    """Values of several wells' curves, in the order of ragged, end to end."""

    def __init__(self, curves: list[np.ndarray], ragged: Ragged) -> None:
        self.size = np.array([len(curves[i]) for i in ragged.order], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.values = np.concatenate([curves[i] for i in ragged.order])

    def on_grids(self, start: np.ndarray, step: float, at: np.ndarray) -> np.ndarray:
        """on_grid for the first len(at) wells, a row of places each."""
        size, offset = self.size[: len(at), None], self.offset[: len(at), None]
        place = np.clip((at - start[: len(at), None]) / step, 0, size - 1)
        low = np.minimum(place.astype(np.int64), np.maximum(size - 2, 0))
        here = self.values[offset + low]
        return here + (self.values[offset + np.minimum(low + 1, size - 1)] - here) * (place - low)


def beams_of_wells(signals: list[np.ndarray], curves: list[np.ndarray], starts: list[int], widths: np.ndarray, move_costs: np.ndarray, scales: np.ndarray, reach: int = 2) -> list[np.ndarray]:
    """Curve index of each step on the cheapest path found, for each well's rows of signals (beams x steps); row b keeps widths[b] states.

    A step costs (signal - curve)^2 / scale and the move cost for each index moved, at most `reach`. Of equal costs the
    lower index is kept. With a width of at least the curve's length the path is the cheapest of all. All beams of all
    wells take a step together: their states lie in one table, unused places at infinite cost.
    """
    ragged, beams, width = Ragged([x.shape[1] for x in signals]), len(widths), int(widths.max(initial=1))
    if not ragged.first[-1]:
        return [np.zeros(x.shape, np.int64) for x in signals]
    curve, asked = Curves(curves, ragged), ragged.pack([x.T for x in signals])
    moves = np.arange(-reach, reach + 1)
    states = np.broadcast_to(np.asarray(starts, np.int64)[ragged.order, None, None], (len(signals), beams, width))
    cost = np.full(states.shape, np.inf)
    cost[:, :, 0] = 0.0
    unused = np.arange(width) >= widths[:, None]
    step = move_costs[:, None, None] * np.abs(moves)
    kept, parents = (np.empty((ragged.first[-1], beams, width), np.int32) for _ in range(2))
    at = np.zeros((len(signals), beams), np.int64)
    for t, a in enumerate(ragged.active):
        states, cost = states[:a], cost[:a]
        to = (states[..., None] + moves).reshape(a, beams, -1)
        total = (cost[..., None] + step).reshape(a, beams, -1)
        size, offset = curve.size[:a, None, None], curve.offset[:a, None, None]
        total = np.where((to >= 0) & (to < size), total, np.inf)
        # by index, then by cost: two stable sorts, the second over few small numbers
        order = np.argsort(total, axis=2, kind="stable")
        near = to - to.min(axis=2, keepdims=True)
        near = near.astype(np.int16 if near.max() < 2**15 else np.int64)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(near, order, 2), axis=2, kind="stable"), 2)
        to, total = np.take_along_axis(to, order, 2), np.take_along_axis(total, order, 2)
        again = np.zeros(to.shape, bool)
        again[..., 1:] = to[..., 1:] == to[..., :-1]
        to = np.clip(to, 0, size - 1)
        total = np.where(again, np.inf, total + (asked[ragged.step(t)][..., None] - curve.values[offset + to]) ** 2 / scales[:, None])
        best = np.argsort(total, axis=2, kind="stable")[..., :width]
        states, cost = np.take_along_axis(to, best, 2), np.where(unused, np.inf, np.take_along_axis(total, best, 2))
        kept[ragged.step(t)], parents[ragged.step(t)] = states, np.take_along_axis(order, best, 2) // len(moves)
        ending = slice(ragged.active[t + 1] if t + 1 < len(ragged.active) else 0, a)
        at[ending] = np.lexsort((states[ending], cost[ending]), axis=2)[..., 0]
    paths = np.empty((ragged.first[-1], beams), np.int64)
    for t in range(len(ragged.active) - 1, -1, -1):
        on, rows = at[: ragged.active[t], :, None], ragged.step(t)
        paths[rows] = np.take_along_axis(kept[rows], on, 2)[..., 0]
        at[: ragged.active[t]] = np.take_along_axis(parents[rows], on, 2)[..., 0]
    return [x.T for x in ragged.unpack(paths)]


def beam_paths(signals: np.ndarray, curve: np.ndarray, start: int, widths: np.ndarray, move_costs: np.ndarray, scales: np.ndarray, reach: int = 2) -> np.ndarray:
    """beams_of_wells for one well."""
    return beams_of_wells([signals], [curve], [start], widths, move_costs, scales, reach)[0]


def beam_path(signal: np.ndarray, curve: np.ndarray, start: int, width: int, move_cost: float, scale: float, reach: int = 2) -> np.ndarray:
    return beam_paths(signal[None], curve, start, np.array([width]), np.array([move_cost]), np.array([scale]), reach)[0]


def systematic(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Indexes drawn at even distances of the cumulative weights."""
    n = len(weights)
    return np.minimum(np.searchsorted(np.cumsum(weights), rng.uniform(0, 1 / n) + np.arange(n) / n), n - 1)


def _likelihood(d: np.ndarray) -> np.ndarray:
    return np.maximum(np.exp(-0.5 * np.minimum(d * d, 600.0)), 1e-300)


def _normal(w: np.ndarray) -> np.ndarray:
    """Each row divided by its sum, even weights where that is 0."""
    total = w.sum(axis=1, keepdims=True)
    return np.where(total > 0, w / np.where(total > 0, total, 1.0), 1 / w.shape[1])


class Particles:
    """Positions, speeds and weights of n particles of each of several wells. Each well draws from its own generator, in the order in which it would alone."""

    def __init__(self, wells: list[dict], n: int, at: str, speed: str, spread_at: float, spread_speed: float) -> None:
        self.ragged, self.n = Ragged([len(w["md"]) for w in wells]), n
        self.given, self.wells = wells, [wells[i] for i in self.ragged.order]
        draws = self.normal(len(wells))
        self.pos = self.each(at)[:, None] + spread_at * draws[:, 0]
        self.vel = self.each(speed)[:, None] + spread_speed * draws[:, 1]
        self.w = np.full((len(wells), n), 1 / n)
        self.found = np.empty((self.ragged.first[-1], 2))

    def each(self, name: str) -> np.ndarray:
        return np.array([w[name] for w in self.wells], np.float64)

    def rows(self, name: str) -> np.ndarray:
        return self.ragged.pack([w[name] for w in self.given])

    def normal(self, active: int) -> np.ndarray:
        out = np.empty((active, 2, self.n))
        for w, x in zip(self.wells, out, strict=False):
            w["rng"].standard_normal(out=x)
        return out

    def keep(self, active: int) -> None:
        """Only the first wells go on."""
        self.pos, self.vel, self.w = self.pos[:active], self.vel[:active], self.w[:active]

    def weigh(self, likelihood: np.ndarray, on: np.ndarray | None = None) -> None:
        new = _normal(self.w * likelihood)
        self.w = new if on is None or on.all() else np.where(on[:, None], new, self.w)

    def resample(self, rough_pos: float, rough_vel: float) -> None:
        """Wells whose effective number of particles is below half draw new ones."""
        for k in np.flatnonzero(1 / (self.w * self.w).sum(axis=1) < 0.5 * self.n):
            rng = self.wells[k]["rng"]
            pick = systematic(self.w[k], rng)
            self.pos[k] = self.pos[k][pick] + rough_pos * rng.standard_normal(self.n)
            self.vel[k] = self.vel[k][pick] + rough_vel * rng.standard_normal(self.n)
            self.w[k] = 1 / self.n

    def tell(self, t: int, depth: np.ndarray) -> None:
        mean = np.einsum("ij,ij->i", self.w, depth)
        self.found[self.ragged.step(t)] = np.stack([mean, np.sqrt(np.einsum("ij,ij->i", self.w, (depth - mean[:, None]) ** 2))], 1)

    def told(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(x[:, 0], x[:, 1]) for x in self.ragged.unpack(self.found)]


def _limits(p: Particles, curve: Curves, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = p.each("start")
    return start, start - 50.0, start + curve.size * step + 50.0


def surfaces_of_wells(wells: list[dict], step: float, n=600, keep=0.998, rate_noise=0.002, noise_pos=0.005, rough_pos=0.1, rough_rate=0.001) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of depth along each well, from particles of a surface (depth + z) that drifts at a slowly changing rate.

    Each well: md, z, gr (rows), curve (from depth start, every step), start, noise, surface, rate, rng. Wells take a step together.
    """
    if not wells:
        return []
    p = Particles(wells, n, "surface", "rate", 0.3, 0.01)
    curve = Curves([w["curve"] for w in wells], p.ragged)
    start, lo, hi = _limits(p, curve, step)
    md, z, gr, noise = p.rows("md"), p.rows("z"), p.rows("gr"), p.each("noise")
    before = md[p.ragged.step(0)] - 1.0 if len(md) else md
    for t, a in enumerate(p.ragged.active):
        p.keep(a)
        s, draws = p.ragged.step(t), p.normal(a)
        dm, zt = np.maximum(md[s] - before[:a], 1.0)[:, None], z[s][:, None]
        p.vel = keep * p.vel + rate_noise * draws[:, 0]
        p.pos = np.clip(p.pos + p.vel * dm + noise_pos * draws[:, 1] - zt, lo[:a, None], hi[:a, None]) + zt
        p.weigh(_likelihood((gr[s][:, None] - curve.on_grids(start, step, p.pos - zt)) / noise[:a, None]), np.isfinite(gr[s]))
        p.resample(rough_pos, rough_rate)
        p.tell(t, p.pos - zt)
        before = md[s]
    return p.told()


def velocities_of_wells(wells: list[dict], step: float, n=600, keep=0.993, speed_noise=0.005, noise_pos=0.01, smooth_share=0.3, rough_pos=0.2, rough_speed=0.003) -> list[tuple[np.ndarray, np.ndarray]]:
    """As above, with particles of depth whose speed is expected to be beta * dz/dmd + shift; more of each well: smooth (rows), curve_smooth, depth, speed, beta, shift, spread."""
    if not wells:
        return []
    p = Particles(wells, n, "depth", "speed", 0.5, 0.02)
    curve, curve_smooth = (Curves([w[c] for w in wells], p.ragged) for c in ("curve", "curve_smooth"))
    start, lo, hi = _limits(p, curve, step)
    md, z, gr, smooth = (p.rows(c) for c in ("md", "z", "gr", "smooth"))
    noise, beta, shift, spread = (p.each(c) for c in ("noise", "beta", "shift", "spread"))
    first = p.ragged.step(0) if len(md) else slice(0)
    before, zb = md[first] - 1.0, z[first] - 1.0
    for t, a in enumerate(p.ragged.active):
        p.keep(a)
        s, draws = p.ragged.step(t), p.normal(a)
        dm = np.maximum(md[s] - before[:a], 1.0)
        expected = beta[:a] * (z[s] - zb[:a]) / dm + shift[:a]
        p.vel = keep * p.vel + speed_noise * draws[:, 0]
        p.pos = np.clip(p.pos + p.vel * dm[:, None] + noise_pos * draws[:, 1], lo[:a, None], hi[:a, None])
        raw = _likelihood((gr[s][:, None] - curve.on_grids(start, step, p.pos)) / noise[:a, None])
        both = (1 - smooth_share) * raw + smooth_share * _likelihood((smooth[s][:, None] - curve_smooth.on_grids(start, step, p.pos)) / (1.5 * noise[:a, None]))
        p.weigh(np.where(np.isfinite(smooth[s])[:, None], both, raw), np.isfinite(gr[s]))
        p.weigh(_likelihood((p.vel - expected[:, None]) / np.maximum(2 * spread[:a], 0.005)[:, None]))
        p.resample(rough_pos, rough_speed)
        p.tell(t, p.pos)
        before, zb = md[s], z[s]
    return p.told()


def template_match(known: np.ndarray, known_depth: np.ndarray, signal: np.ndarray, half: int, stride: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Depth at the centre of the known window that correlates best with the window around each position, and the correlation."""
    width = 2 * half + 1
    if len(known) < width + 1 or not len(signal):
        return np.full(len(signal), known_depth[-1] if len(known_depth) else np.nan), np.zeros(len(signal))
    view = np.lib.stride_tricks.sliding_window_view
    a = view(centered_mean(known, 5), width)[::stride]
    b = view(np.pad(centered_mean(signal, 5), half, mode="edge"), width)
    unit = lambda x: (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-6)
    score = unit(b) @ unit(a).T / width
    best = score.argmax(1)
    return known_depth[np.clip(best * stride + half, 0, len(known) - 1)], score.max(1)


def template_blend(depths: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Depths of several scales (columns), weighted by exp(3 * score)."""
    w = np.exp(3 * scores)
    return (depths * w).sum(1) / (w.sum(1) + 1e-9)


def band(query: np.ndarray, ref: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost, low): accumulated squared cost of rows x (2 * radius + 1) cells around the diagonal; cell k of row i is column low[i] + k, infinite outside of the table.

    Within a row the recurrence along the row is min over earlier entries, as a running minimum of (entry - prefix cost).
    """
    n, m = len(query), len(ref)
    slope = (m - 1) / max(n - 1, 1)
    low = np.rint(np.arange(n) * slope).astype(np.int64) - radius
    column = low[:, None] + np.arange(2 * radius + 1)
    inside = (column >= 0) & (column < m)
    out = np.full(column.shape, np.inf)
    for i in range(n):
        on = inside[i]
        cost = (query[i] - ref[column[i, on]]) ** 2
        if i == 0:
            enter = np.where(column[0, on] == 0, 0.0, np.inf)
        else:
            up, diagonal = (_moved(out[i - 1], int(low[i] - low[i - 1]) - back)[on] for back in (0, 1))
            enter = np.minimum(up, diagonal)
        sums = np.cumsum(cost)
        out[i, on] = np.minimum.accumulate(enter - (sums - cost)) + sums
    return out, low


def _moved(row: np.ndarray, by: int) -> np.ndarray:
    """row[k + by] for each k, infinite beyond its ends."""
    out = np.full(len(row), np.inf)
    lo, hi = max(0, -by), min(len(row), len(row) - by)
    if hi > lo:
        out[lo:hi] = row[lo + by : hi + by]
    return out


#: How a cell of a band is entered: from the row before at the column before or at the same one, or from its left.
DIAGONAL, UP, LEFT = 0, 1, 2


def _moves(row: np.ndarray, up: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Codes of a row's cells (last axis) from its costs and those of the row before: the diagonal wins ties, then the row before."""
    left = np.concatenate([np.full((*row.shape[:-1], 1), np.inf), row[..., :-1]], axis=-1)
    return np.where(np.minimum(up, diagonal) <= left, np.where(diagonal <= up, DIAGONAL, UP), LEFT).astype(np.int8)


def walked(moves: np.ndarray, low: np.ndarray, m: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """For each row the last column of the path that leads back from the table's end; cells first..last of rows are the band."""
    n, width = moves.shape
    last = width - 1 if last is None else last
    col = np.zeros(n, np.int64)
    at, starts = m - 1, low.tolist()
    for i in range(n - 1, -1, -1):
        col[i] = at
        k, row = min(max(at - starts[i], first), last), moves[i].tobytes()
        while row[k] == LEFT:
            k -= 1
        at = max(0, starts[i] + k - (row[k] == DIAGONAL))
    return col


def band_path(cost: np.ndarray, low: np.ndarray, m: int) -> np.ndarray:
    """walked() of the cheapest path through a band that band() has filled, or one with other costs."""
    k = np.arange(cost.shape[1]) + np.diff(low)[:, None]

    def before(back: int) -> np.ndarray:
        at = k - back
        return np.where((at >= 0) & (at < cost.shape[1]), np.take_along_axis(cost[:-1], np.clip(at, 0, cost.shape[1] - 1), 1), np.inf)

    moves = np.zeros(cost.shape, np.int8)
    moves[1:] = _moves(cost[1:], before(0), before(1))
    return walked(moves, low, m)


def band_paths(query: np.ndarray, ref: np.ndarray, radii: tuple[int, ...], chunk: int = 256) -> list[np.ndarray]:
    """The cheapest path through each of several bands around the diagonal.

    All bands lie within the widest, and each row of all bands is filled at once. What does not depend on the row before
    (costs, their running sums, the moves) is made for a chunk of rows; the moves of all rows are held, one byte a cell.
    """
    n, m = len(query), len(ref)
    asked = [min(r, m) for r in radii]  # a radius of m columns reaches all of the table, and so do larger ones
    radii = tuple(sorted(set(asked)))
    widest, width = max(radii), 2 * max(radii) + 1
    low = np.rint(np.arange(n) * ((m - 1) / max(n - 1, 1))).astype(np.int64) - widest
    shifts = np.diff(low, prepend=low[0])
    k = np.arange(width)
    reach = np.abs(k - widest) <= np.array(radii)[:, None]
    moves = np.zeros((n, len(radii), width), np.int8)
    # rows of costs with one infinite cell before and as many behind as a row may be shifted: a view is a shifted row
    before = np.full((len(radii), 1 + width + int(shifts.max())), np.inf)
    for start in range(0, n, chunk):
        rows = slice(start, min(n, start + chunk))
        column = low[rows, None] + k
        inside = reach & ((column >= 0) & (column < m))[:, None]
        cost = np.where(inside, ((query[rows, None] - ref[np.clip(column, 0, m - 1)]) ** 2)[:, None], 0.0)
        sums = np.cumsum(cost, axis=2)
        paid, barred = sums - cost, np.where(inside, 0.0, np.inf)
        up, diagonal, filled = (np.empty(cost.shape) for _ in range(3))
        for i in range(len(column)):
            if start + i:
                at = int(shifts[start + i])
                up[i], diagonal[i] = before[:, 1 + at : 1 + at + width], before[:, at : at + width]
            else:
                up[i] = diagonal[i] = np.where(column[0] == 0, 0.0, np.inf)
            row = np.minimum(up[i], diagonal[i], out=filled[i])
            row -= paid[i]
            row += barred[i]
            np.minimum.accumulate(row, axis=1, out=row)
            row += sums[i]
            row += barred[i]
            before[:, 1 : 1 + width] = row
        moves[rows] = _moves(filled, up, diagonal)
    paths = {r: walked(moves[:, j], low, m, widest - r, widest + r) for j, r in enumerate(radii)}
    return [paths[r] for r in asked]


def local_slope(col: np.ndarray, half: int = 2) -> np.ndarray:
    """Columns per row between the rows `half` before and after, or as many as there are; 1 for a single row."""
    place = np.arange(len(col))
    ends = np.clip(place[:, None] + [-half, half], 0, len(col) - 1)
    rows = np.diff(ends, axis=1)[:, 0]
    return np.divide(np.diff(col[ends], axis=1)[:, 0], rows, out=np.ones(len(col)), where=rows > 0)


def stochastic_warps(cost: np.ndarray, low: np.ndarray, m: int, draws: int, temperature: float, rng: np.random.Generator) -> np.ndarray:
    """Paths through the band with Gumbel noise added to its finite cells: draws x rows. One noisy band is held at a time."""
    finite = np.isfinite(cost)
    out = np.empty((draws, len(cost)), np.int64)
    for k in range(draws):
        noisy = cost.copy()
        noisy[finite] += temperature * -np.log(-np.log(rng.uniform(1e-10, 1.0, int(finite.sum()))))
        out[k] = band_path(noisy, low, m)
    return out


def savgol(x: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Local polynomial smoothing; the ends are read off the polynomial of the end windows. The window shrinks to the odd length that fits, and below degree + 2 values nothing is done."""
    n = len(x)
    window = min(window, n if n % 2 else n - 1)
    if window < degree + 2:
        return x.copy()
    h = window // 2
    basis = np.vander(np.arange(-h, h + 1), degree + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    out = x.copy()
    out[h : n - h] = np.convolve(x, fit[0][::-1], mode="valid")
    out[:h] = basis[:h] @ (fit @ x[:window])
    out[n - h :] = basis[h + 1 :] @ (fit @ x[-window:])
    return out
