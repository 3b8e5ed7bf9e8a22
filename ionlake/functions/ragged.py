"""Kernels over ragged batches: the points of many spectra end to end, and the bounds between them.

A kernel works on all spectra of a batch at once; only what is sequential within a spectrum (LOWESS, wavelets, prominences,
areas, binned noise) goes spectrum by spectrum. Null arrays count as empty, null samples as NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernels, weights

FLOOR = 0.001
#: Points that are worked through at once, about: 8 MB a column.
SLICE_POINTS = 1 << 20


class Ragged:
    """mz and x of the points of some spectra; spectrum k has the points bounds[k] to bounds[k + 1]."""

    def __init__(self, mz: np.ndarray, x: np.ndarray, bounds: np.ndarray, places: np.ndarray | None = None):
        self.mz, self.x, self.bounds = mz, x, bounds
        self.sizes = np.diff(bounds)
        self.rows = len(self.sizes)
        self.row = np.repeat(np.arange(self.rows), self.sizes)
        self.n = self.sizes[self.row]
        self.start = bounds[:-1][self.row]
        self.i = np.arange(len(x)) - self.start
        self.places = places  # where the points stood before points were left out

    def with_x(self, x: np.ndarray) -> Ragged:
        out = object.__new__(Ragged)
        out.__dict__ = self.__dict__ | {"x": x}
        return out

    def kept(self, mask: np.ndarray, x: np.ndarray | None = None) -> Ragged:
        """Only the marked points."""
        sizes = np.bincount(self.row[mask], minlength=self.rows)
        places = self.i if self.places is None else self.places
        return Ragged(self.mz[mask], (self.x if x is None else x)[mask], np.r_[0, np.cumsum(sizes)], places[mask])

    def near(self, values: np.ndarray, k: int) -> np.ndarray:
        """The values k places further on, those at the ends repeated."""
        return values[self.start + np.clip(self.i + k, 0, self.n - 1)] if len(values) else values

    def sum(self, values: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        row = self.row if where is None else self.row[where]
        return np.bincount(row, values if where is None else values[where], minlength=self.rows)

    def count(self, where: np.ndarray) -> np.ndarray:
        return np.bincount(self.row[where], minlength=self.rows)

    def most(self, values: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """The greatest value of each spectrum, -inf where there is none."""
        out = np.full(self.rows, -np.inf)
        np.maximum.at(out, self.row if where is None else self.row[where], values if where is None else values[where])
        return out

    def quantile(self, values: np.ndarray, q: float, where: np.ndarray | None = None) -> np.ndarray:
        """Each spectrum's quantile, linear between samples; NaN where there is none."""
        row = self.row if where is None else self.row[where]
        values = values if where is None else values[where]
        values = values[np.lexsort((values, row))]
        sizes = np.bincount(row, minlength=self.rows)
        first = np.cumsum(sizes) - sizes
        at = np.maximum(sizes - 1, 0) * q
        low = np.floor(at).astype(int)
        out = np.full(self.rows, np.nan)
        some = sizes > 0
        a = values[(first + low)[some]]
        b = values[(first + np.minimum(low + 1, sizes - 1))[some]]
        out[some] = a + (b - a) * (at - low)[some]
        return out

    def each(self, fn: Callable[[slice], np.ndarray]) -> np.ndarray:
        """Values that a function of a spectrum's slice gives, end to end."""
        parts = [fn(slice(a, b)) for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]
        return np.concatenate(parts) if parts else np.zeros(0)


def convolved(r: Ragged, x: np.ndarray, kernel: list[float]) -> np.ndarray:
    half = len(kernel) // 2
    out = np.zeros(len(x))
    for k, w in enumerate(kernel):
        out += w * r.near(x, k - half)
    return out


def moving_average(r: Ragged, window: int = 5, coef: list[float] | None = None) -> Ragged:
    if coef is not None:
        if len(coef) % 2 == 0:
            raise ValueError("coef must have odd length")
        return r.with_x(convolved(r, r.x, [c / sum(coef) for c in reversed(coef)]))
    window = weights.odd(window)
    return r.with_x(convolved(r, r.x, [1.0] * window) / window)


def gaussian(r: Ragged, window: int = 5, sd: float | None = None) -> Ragged:
    return r.with_x(convolved(r, r.x, weights.gaussian(window, sd)))


def savgol(r: Ragged, window: int = 5, polyorder: int = 3, deriv: int = 0, delta: float = 1.0) -> Ragged:
    table = np.array(weights.savgol(window, polyorder, deriv, delta))
    w = len(table)
    half = w // 2
    place = np.where(r.i < half, r.i, np.where(r.i >= r.n - half, w - (r.n - r.i), half))
    short = r.n < w
    place[short] = 0
    out = np.zeros(len(r.x))
    for j in range(w):
        out += table[place, j] * r.near(r.x, 0)[np.where(short, np.arange(len(r.x)), r.start + np.clip(r.i - place + j, 0, np.maximum(r.n - 1, 0)))]
    return r.with_x(np.where(short, r.x, out))


def wavelet(r: Ragged, name: str = "db4", mode: str = "soft") -> Ragged:
    return r.with_x(r.each(lambda s: kernels.wavelet(r.x[s], name, mode)))


def _windows_by_mz(r: Ragged, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first neighbour, number of neighbours) of each point's k nearest by m/z; ties to the lower one."""
    size = np.minimum(k, r.n)
    left = np.maximum(r.i - size, 0)
    for _ in range(k + 1):
        on = left + size < r.n
        a, b = r.mz[r.start + left], r.mz[r.start + np.minimum(left + size, r.n - 1)]
        move = on & (r.mz - a > b - r.mz)
        if not move.any():
            break
        left = left + move
    return left, size


def neighbour_smooth(r: Ragged, window: int = 5, sd: float | None = None, sd_intensity: float | None = None, bilateral: bool = False) -> Ragged:
    """Gaussian (or bilateral) mean over the nearest points by m/z (see ``kernels.neighbour_smooth``)."""
    if np.isnan(r.x).any():
        return r.with_x(r.each(lambda s: kernels.neighbour_smooth(r.mz[s], r.x[s], window, sd, bilateral, sd_intensity)))
    left, size = _windows_by_mz(r, window)
    at = lambda j: r.start + np.minimum(left + j, r.n - 1)
    far = np.zeros(len(r.x))
    for j in range(window):
        far = np.maximum(far, np.where(j < size, np.abs(r.mz[at(j)] - r.mz), 0))
    wide = r.quantile(far, 0.5) / 2 if sd is None else np.full(r.rows, float(sd))
    if (wide[r.sizes > 0] <= 0).any():
        raise ValueError("neighbour_smooth: sd must be positive")
    if bilateral:
        mid = r.quantile(r.x, 0.5)
        tall = 1.4826 * r.quantile(np.abs(r.x - mid[r.row]), 0.5) if sd_intensity is None else np.full(r.rows, float(sd_intensity))
    top, bottom = np.zeros(len(r.x)), np.zeros(len(r.x))
    for j in range(window):
        k = at(j)
        w = np.exp(np.maximum(-0.5 * ((r.mz[k] - r.mz) / wide[r.row]) ** 2, -88))
        if bilateral:
            t = tall[r.row]
            near = np.exp(np.maximum(-0.5 * ((r.x[k] - r.x) / np.where(t > 0, t, 1)) ** 2, -88))
            w = w * np.where(t > 0, near, 1.0)
        w = np.where(j < size, w, 0.0)
        top += w * r.x[k]
        bottom += w
    return r.with_x(top / bottom if len(top) else top)


def local_maxima(r: Ragged, x: np.ndarray, radius: int, right_edge: int) -> np.ndarray:
    """See ``operators.baseline.local_maxima``."""
    if not radius:
        return np.zeros(len(x), dtype=bool)
    ok = np.isfinite(x)
    v = np.where(ok, x, -np.inf)
    left, right = np.full(len(x), -np.inf), np.full(len(x), -np.inf)
    for k in range(1, radius + 1):
        left = np.maximum(left, np.where(r.i >= k, r.near(v, -k), -np.inf))
        right = np.maximum(right, np.where(r.i + k < r.n, r.near(v, k), -np.inf))
    return ok & (r.i >= radius) & (r.i <= r.n - 1 - right_edge) & (left < v) & (right <= v)


def locmin(r: Ragged, width: int = 5, upper: bool = False) -> np.ndarray:
    if width < 3:
        raise ValueError("locmin: width must be at least 3")
    half, ok = width // 2, np.isfinite(r.x)
    s = r.x
    if not ok.all():
        s = np.where(ok, r.x, np.nan_to_num(r.quantile(r.x, 0.5, ok))[r.row])
    if not len(s):
        return s
    anchor = local_maxima(r, s if upper else -s, half, half) | (r.i == 0) | (r.i == r.n - 1)
    at = np.arange(len(s))
    p = np.maximum.accumulate(np.where(anchor, at, 0))
    q = np.minimum.accumulate(np.where(anchor, at, len(s))[::-1])[::-1]
    line = np.where(p == q, s[p], s[p] + (s[q] - s[p]) * (at - p) / np.maximum(q - p, 1))
    flat = r.most(s) if upper else -r.most(-s)
    return np.where(r.n < 3, flat[r.row], line)


def snip(r: Ragged, m: int | None = None, decreasing: bool = True) -> np.ndarray:
    """m None: a tenth of each spectrum's length, within 10 and 100."""
    reach = np.minimum((r.n - 1) // 2, np.minimum(100, np.maximum(10, r.n // 10)) if m is None else m)
    y, most = r.x.copy(), int(reach.max(initial=0))
    for p in range(most, 0, -1) if decreasing else range(1, most + 1):
        at = np.flatnonzero((p <= reach) & (r.i >= p) & (r.i < r.n - p))
        y[at] = np.minimum(y[at], (y[at - p] + y[at + p]) / 2)
    return y


def asls(r: Ragged, lam: float = 1e7, p: float = 0.01, iterations: int = 15) -> np.ndarray:
    """Asymmetric least squares (see ``kernels.asls``): spectra of like length are solved side by side."""
    out = r.x.copy()
    order = np.argsort(r.sizes, kind="stable")
    order = order[r.sizes[order] >= 3]
    while len(order):
        longest = r.sizes[order[-1]]
        k = max(1, int(SLICE_POINTS // (4 * longest)))
        rows, order = order[-k:], order[:-k]
        sizes = r.sizes[rows]
        inside = np.arange(longest)[None, :] < sizes[:, None]
        at = np.minimum(r.bounds[rows][:, None] + np.arange(longest)[None, :], len(r.x) - 1)
        y = np.where(inside, r.x[at], 0.0)
        j, n = np.arange(longest)[None, :], sizes[:, None]
        # second differences start at places 0 to n - 3
        has = lambda k: (j - k >= 0) & (j - k <= n - 3)
        d0 = has(0) * 1.0 + has(1) * 4.0 + has(2) * 1.0
        d1 = has(0) * -2.0 + has(1) * -2.0
        d2 = has(0) * 1.0
        w, z = np.ones(y.shape), y
        for _ in range(iterations):
            z = _solve_banded(np.where(inside, w + lam * d0, 1.0), lam * d1, lam * d2, w * y)
            w = np.where(y > z, p, 1 - p)
        out[at[inside]] = z[inside]
    return out


def _solve_banded(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symmetric systems with two bands, one a row, by their LDL' factors, place by place."""
    a0, a1, a2, rhs = (np.ascontiguousarray(v.T) for v in (d0, d1, d2, b))
    n = len(a0)
    d, l1, l2, z = np.zeros_like(a0), np.zeros_like(a0), np.zeros_like(a0), np.zeros_like(a0)
    for i in range(n):
        d[i], z[i] = a0[i], rhs[i]
        if i >= 2:
            l2[i] = a2[i - 2] / d[i - 2]
        if i >= 1:
            l1[i] = (a1[i - 1] - (l2[i] * l1[i - 1] * d[i - 2] if i >= 2 else 0.0)) / d[i - 1]
            d[i] -= l1[i] * l1[i] * d[i - 1]
            z[i] -= l1[i] * z[i - 1]
        if i >= 2:
            d[i] -= l2[i] * l2[i] * d[i - 2]
            z[i] -= l2[i] * z[i - 2]
    out = np.zeros_like(a0)
    for i in range(n - 1, -1, -1):
        out[i] = z[i] / d[i]
        if i + 1 < n:
            out[i] -= l1[i + 1] * out[i + 1]
        if i + 2 < n:
            out[i] -= l2[i + 2] * out[i + 2]
    return out.T


def lowess(r: Ragged, values: np.ndarray, span: float = 0.1, over: str = "index") -> np.ndarray:
    """LOWESS of values over the sample's number, or over m/z."""
    axis = r.i.astype(float) if over == "index" else r.mz
    return r.each(lambda s: kernels.lowess(axis[s], values[s], span))


def spline(r: Ragged, values: np.ndarray, knots: int = 5) -> np.ndarray:
    """The natural cubic spline over the sample's number through every ``knots``-th value and the last one."""
    return r.each(lambda s: kernels.natural_spline(values[s], knots))


BASELINES: dict[str, Callable[..., np.ndarray]] = {"locmin": locmin, "snip": snip, "asls": asls}


def corrected(r: Ragged, method: str = "locmin", scale: float = 1.0, smooth: str = "none", span: float = 0.1, over: str = "index", knots: int = 5, **how) -> Ragged:
    base = BASELINES[method](r, **how)
    if smooth == "lowess":
        base = lowess(r, base, span, over)
    elif smooth == "spline":
        base = spline(r, base, knots)
    return r.with_x(np.maximum(r.x - scale * base, 0.0))


def normalized(r: Ragged, method: str = "tic", scale: float | None = None, ref: float | None = None, ref_tolerance: float = 0.1, strict: bool = False) -> Ragged:
    if method == "tic":
        base = r.sum(r.x)
    elif method == "rms":
        ok = ~np.isnan(r.x)
        with np.errstate(invalid="ignore", divide="ignore"):
            base = np.sqrt(r.sum(r.x * r.x, ok) / r.count(ok))
    elif method == "median":
        base = r.quantile(r.x, 0.5)
    else:
        if ref is None or ref_tolerance < 0:
            raise ValueError("normalize: ref needs a reference m/z and a tolerance")
        gap = np.abs(r.mz - ref)
        at = np.flatnonzero(gap <= ref_tolerance)
        at = at[np.lexsort((r.i[at], r.mz[at], gap[at], r.row[at]))]
        first = at[np.flatnonzero(np.diff(r.row[at], prepend=-1))]
        base = np.full(r.rows, np.nan)
        base[r.row[first]] = r.x[first]
    good = base > 0
    if strict and not good[r.sizes > 0].all():
        raise ValueError("normalize: base is not positive")
    factor = (1.0 if method == "ref" else r.n) if scale is None else scale
    with np.errstate(invalid="ignore", divide="ignore"):
        return r.with_x(np.where(good[r.row], r.x * factor / base[r.row], 0.0))


def residual(r: Ragged) -> np.ndarray:
    return np.abs(convolved(r, r.x, weights.gaussian(9, 2.0)) - r.x)


def noise(r: Ragged, method: str = "quantile") -> np.ndarray:
    """The noise of each spectrum (see ``operators.noise.with_noise``)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if method == "diff":
            ok = np.isfinite(r.x)
            step = r.x - r.near(r.x, -1)
            steps = np.isfinite(step) & (r.i > 0)
            mean = r.sum(step, steps) / r.count(steps)
            whole = (r.count(ok) == r.sizes) & (r.sizes > 0)
            ends = np.full(r.rows, np.nan)
            first, last = r.bounds[:-1][whole], r.bounds[1:][whole] - 1
            ends[whole] = (r.x[last] - r.x[first]) / (r.sizes[whole] - 1)
            mean = np.where(whole, ends, mean)
            out = r.sum(np.abs(r.x - mean[r.row]), ok) / r.count(ok)
        else:
            d = residual(r)
            ok = np.isfinite(d)
            if method == "sd":
                k = r.count(ok)
                off = d - (r.sum(d, ok) / k)[r.row]
                out = np.sqrt(r.sum(off * off, ok) / (k - 1))
            elif method == "quantile":
                out = r.quantile(d, 0.95, ok)
            elif method == "mad":
                out = 1.4826 * r.quantile(np.abs(d - r.quantile(d, 0.5, ok)[r.row]), 0.5, ok)
            else:
                raise ValueError(f"noise: unknown method {method}")
    return np.maximum(np.where(np.isfinite(out), out, FLOOR), FLOOR)


def noise_curve(r: Ragged, method: str, bins: int, overlap: float) -> np.ndarray:
    """The noise at every point, from bins along each spectrum."""
    signal = r.x if method == "diff" else residual(r)
    return r.each(lambda s: np.maximum(kernels.binned_noise(signal[s], method, bins, overlap), FLOOR))


def dynamic_curve(r: Ragged, bins: int = 4, iterations: int = 10) -> np.ndarray:
    """The noise at every point, from bins that follow the signal."""
    row, low, high, noise_ = dynamic_bins(r, bins, iterations)
    at = np.searchsorted(row, np.arange(r.rows + 1))
    parts = [kernels.noise_curve((low[a:b] + high[a:b]) / 2, noise_[a:b], n) for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), r.sizes.tolist(), strict=True) if n]
    return np.maximum(np.concatenate(parts), FLOOR) if parts else np.zeros(0)


def picked(r: Ragged, width: int = 5, snr: float | None = 2.0, noise_method: str = "quantile", relheight: float | None = None, prominence: float | None = None, return_type: str = "height", nbins: int = 1, overlap: float = 0.5, bins: str = "fixed") -> Ragged:
    """The peaks; ``places`` says where they stood."""
    half = width // 2
    peak = local_maxima(r, r.x, half, half - 1)
    value = r.x
    if prominence is not None or return_type == "area":
        by_row = [np.flatnonzero(peak[a:b]) for a, b in zip(r.bounds[:-1].tolist(), r.bounds[1:].tolist(), strict=True)]
    if prominence is not None:
        for start, stop, at in zip(r.bounds[:-1].tolist(), r.bounds[1:].tolist(), by_row, strict=True):
            peak[start + at[kernels.prominences(r.x[start:stop], at) < prominence]] = False
    if return_type == "area":
        value = np.zeros(len(r.x))
        for start, stop, at in zip(r.bounds[:-1].tolist(), r.bounds[1:].tolist(), by_row, strict=True):
            at = at[peak[start + at]]
            value[start + at] = kernels.areas(r.mz[start:stop], r.x[start:stop], at)
    with np.errstate(invalid="ignore", divide="ignore"):
        if relheight is not None:
            top = r.most(r.x, peak)[r.row]
            peak &= (top > 0) & (r.x / top >= relheight)
        if snr is not None and 0 < snr < np.inf:
            if bins == "dynamic":
                floor = dynamic_curve(r, nbins)
            else:
                floor = noise(r, noise_method)[r.row] if nbins == 1 else noise_curve(r, noise_method, nbins, overlap)
            peak &= r.x / floor >= snr
    return r.kept(peak, value)


def dynamic_bins(r: Ragged, bins: int = 4, iterations: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last, noise) of bins that follow the signal: the residual's spread in each, FLOOR at least."""
    d, rows, held = residual(r), [], []
    for k, (a, b) in enumerate(zip(r.bounds[:-1].tolist(), r.bounds[1:].tolist(), strict=True)):
        found = kernels.dynamic_bins(r.x[a:b], bins, iterations)
        rows += [k] * len(found)
        held += [(low, high, d[a + low : a + high + 1].std(ddof=1) if high > low else FLOOR) for low, high in found]
    out = np.array(held, dtype=float).reshape(-1, 3)
    return np.array(rows, dtype=int), out[:, 0].astype(int), out[:, 1].astype(int), np.maximum(out[:, 2], FLOOR)


def picked_by_shape(r: Ragged, noise_method: str = "sd", **how) -> Ragged:
    """Plateau maxima by prominence, width and Simpson area (see ``kernels.origin_peaks``), heights being the areas."""
    floor = noise(r, noise_method)
    peak, value = np.zeros(len(r.x), dtype=bool), np.zeros(len(r.x))
    for k, (a, b) in enumerate(zip(r.bounds[:-1].tolist(), r.bounds[1:].tolist(), strict=True)):
        at, size = kernels.origin_peaks(r.mz[a:b], r.x[a:b], floor[k], **how)
        peak[a + at], value[a + at] = True, size
    return r.kept(peak, value)


# alignment


def in_order(r: Ragged) -> Ragged:
    """Finite m/z only, ascending; equal m/z keep their order."""
    ok = np.isfinite(r.mz)
    if not ok.all():
        r = r.kept(ok)
    if (np.diff(r.mz) < 0)[r.i[1:] > 0].any():
        order = np.lexsort((r.i, r.mz, r.row))
        r = Ragged(r.mz[order], r.x[order], r.bounds, r.places[order] if r.places is not None else None)
    return r


def nearest(r: Ragged, row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The point (index in the batch) of a spectrum that is nearest to a value; ties to the lower one. Spectra ascend."""
    low, high = r.bounds[:-1][row], r.bounds[1:][row]
    first, last = low.copy(), high - 1
    while (low < high).any():
        mid = (low + high) // 2
        below = (low < high) & (r.mz[np.minimum(mid, len(r.mz) - 1)] < values)
        high = np.where((low < high) & ~below, mid, high)
        low = np.where(below, mid + 1, low)
    right = np.minimum(low, last)
    left = np.maximum(right - 1, first)
    return np.where(np.abs(r.mz[right] - values) < np.abs(values - r.mz[left]), right, left)


def _spread(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of all numbers of the ranges first to stop."""
    sizes = np.maximum(stop - first, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]


def matches(r: Ragged, reference: np.ndarray, tolerance: float, relative: bool = True, mode: str = "auto", fill_holes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, reference, point) of the references that spectra (in order) reach; see ``kernels.matches`` for the two ways. Work
    goes with points and matches, not with the length of the axis."""
    none = np.zeros(0, dtype=int)
    if not len(r.mz) or not len(reference):
        return none, none, none
    reach = np.abs(r.mz) * tolerance if relative else np.full(len(r.mz), tolerance)
    first, stop = np.searchsorted(reference, r.mz - 2 * reach), np.searchsorted(reference, r.mz + 2 * reach)
    if relative and tolerance > 0.5:
        first, stop = np.zeros_like(first), np.full_like(stop, len(reference))
    before = r.i > 0  # has a neighbour below
    down = np.full(r.rows, mode == "down") if mode != "auto" else len(reference) <= 2 * r.sizes
    down_point = down[r.row]

    # down: every reference near a point takes the spectrum's nearest point, if that is within the tolerance
    begun = np.where(before, np.r_[0, stop[:-1]], 0)
    begun = _running_most(begun, r)
    of, ref = _spread(np.where(down_point, np.maximum(first, begun), 0), np.where(down_point, stop, 0))
    row_d = r.row[of]
    best_d = nearest(r, row_d, reference[ref])
    ok = np.abs(r.mz[best_d] - reference[ref]) / (np.abs(reference[ref]) if relative else 1.0) <= tolerance
    row_d, ref_d, best_d = row_d[ok], ref[ok], best_d[ok]

    # up: a point takes the references within its own reach that no point before it has taken
    up = ~down_point
    within = lambda k: np.abs(reference[np.clip(k, 0, len(reference) - 1)] - r.mz) <= reach
    a, b = first.copy(), stop - 1
    while (move := up & (a <= b) & ~within(a)).any():
        a = a + move
    while (move := up & (a <= b) & ~within(b)).any():
        b = b - move
    some = up & (a <= b)
    right = np.clip(np.searchsorted(reference, r.mz), 0, len(reference) - 1)
    left = np.maximum(right - 1, 0)
    home = np.where(np.abs(reference[right] - r.mz) < np.abs(r.mz - reference[left]), right, left)
    if fill_holes:
        of, ref = _spread(np.where(some, a, 0), np.where(some, b + 1, 0))
        pairs = np.unique(r.row[of] * np.int64(len(reference)) + ref)
        row_u, ref_u = pairs // len(reference), pairs % len(reference)
        best_u = nearest(r, row_u, reference[ref_u])
        ok = np.abs(r.mz[best_u] - reference[ref_u]) <= reach[best_u]
        row_u, ref_u, best_u = row_u[ok], ref_u[ok], best_u[ok]
    else:
        taking = some & (home >= a) & (home <= b)
        at = np.flatnonzero(taking)
        end = np.full(len(at), -1)  # the last reference taken before, in the same spectrum
        if len(at):
            same = np.r_[False, r.row[at][1:] == r.row[at][:-1]]
            most = _running_most(np.where(same, np.r_[-1, b[at][:-1]], -1), r, at)
            accepted = home[at] > most
            end = most
            for k in np.flatnonzero(~accepted).tolist():  # only points in reach of another one's references
                j = k - 1
                while not accepted[j]:
                    j -= 1
                accepted[k] = home[at[k]] > b[at[j]]
            places = np.where(accepted, np.arange(len(at)), -1)
            last = np.maximum.accumulate(np.r_[-1, places[:-1]])
            held = (last >= 0) & (r.row[at][np.maximum(last, 0)] == r.row[at])
            end = np.where(held, b[at][np.maximum(last, 0)], -1)
            at, end = at[accepted], end[accepted]
        of, ref_u = _spread(np.maximum(a[at], end + 1), b[at] + 1)
        row_u = r.row[at][of]
        best_u = nearest(r, row_u, reference[ref_u])
    row, ref, best = np.r_[row_d, row_u], np.r_[ref_d, ref_u], np.r_[best_d, best_u]
    order = np.lexsort((ref, row)) if len(row_d) and len(row_u) else slice(None)
    return row[order], ref[order], best[order]


def _running_most(values: np.ndarray, r: Ragged, at: np.ndarray | None = None) -> np.ndarray:
    """The greatest value so far within the same spectrum; values are integers of at least -1."""
    row = r.row if at is None else r.row[at]
    wide = int(values.max(initial=0)) + 2
    return np.maximum.accumulate(row * np.int64(wide) + values + 1) - row * np.int64(wide) - 1


# Arrow


def ragged_slices(batch: pa.RecordBatch, mz: str = "mz", x: str = "intensity") -> Iterator[tuple[pa.RecordBatch, Ragged]]:
    """A batch in pieces of about SLICE_POINTS points, with its arrays as ragged doubles. Arrays of unequal length raise."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(x)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if mz in batch.schema.names:
        other = pc.fill_null(pc.list_value_length(batch.column(mz)), 0).to_numpy(zero_copy_only=False)
        if (sizes != other).any():
            raise ValueError(f"{mz} and {x} of a spectrum differ in length")
    cuts = np.cumsum(sizes) // SLICE_POINTS
    stops = np.r_[np.flatnonzero(np.diff(cuts)) + 1, len(sizes)] if len(sizes) else np.zeros(0, dtype=int)
    start = 0
    for stop in stops.tolist():
        part = batch.slice(start, stop - start)
        flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
        values = flat(x)
        yield part, Ragged(flat(mz) if mz in batch.schema.names else np.zeros(len(values)), values, np.r_[0, np.cumsum(sizes[start:stop])])
        start = stop


def as_list(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind) if kind else pa.array(values))
