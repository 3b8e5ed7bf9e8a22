"""Single-spectrum kernels that are sequential or need linear algebra, on numpy arrays."""

from __future__ import annotations

import math

import numpy as np


def snip(x: np.ndarray, m: int | None = None, decreasing: bool = True) -> np.ndarray:
    """The clipped baseline; m None: a tenth of the length, within 10 and 100."""
    y, n = np.array(x, dtype=float), len(x)
    if n < 3:
        return y
    m = min((n - 1) // 2, min(100, max(10, n // 10)) if m is None else m)
    for p in range(m, 0, -1) if decreasing else range(1, m + 1):
        y[p : n - p] = np.minimum(y[p : n - p], (y[: n - 2 * p] + y[2 * p :]) / 2)
    return y


def asls(x: np.ndarray, lam: float = 1e7, p: float = 0.01, iterations: int = 15) -> np.ndarray:
    """Asymmetric least squares: weights p above and 1 - p below the curve, second differences penalised.
    The pentadiagonal system is solved by a banded Cholesky factorisation."""
    y = np.array(x, dtype=float)
    n = len(y)
    if n < 3:
        return y
    d0, d1, d2 = np.zeros(n), np.zeros(n - 1), np.zeros(n - 2)
    for k, c in enumerate((1.0, -2.0, 1.0)):
        d0[k : n - 2 + k] += c * c
    d1[: n - 2] += -2.0
    d1[1:] += -2.0
    d2 += 1.0
    w, z = np.ones(n), y
    for _ in range(iterations):
        z = _solve_banded(w + lam * d0, lam * d1, lam * d2, w * y)
        w = np.where(y > z, p, 1 - p)
    return z


def _solve_banded(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a symmetric positive definite system with two bands by its LDL' factors."""
    n = len(d0)
    d, l1, l2, z = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    a0, a1, a2, rhs = d0.tolist(), d1.tolist(), d2.tolist(), b.tolist()
    for i in range(n):
        e2 = l2[i] = a2[i - 2] / d[i - 2] if i >= 2 else 0.0
        e1 = l1[i] = (a1[i - 1] - (e2 * l1[i - 1] * d[i - 2] if i >= 2 else 0.0)) / d[i - 1] if i >= 1 else 0.0
        d[i] = a0[i] - (e1 * e1 * d[i - 1] if i >= 1 else 0.0) - (e2 * e2 * d[i - 2] if i >= 2 else 0.0)
        z[i] = rhs[i] - (e1 * z[i - 1] if i >= 1 else 0.0) - (e2 * z[i - 2] if i >= 2 else 0.0)
    out = [0.0] * n
    for i in range(n - 1, -1, -1):
        out[i] = z[i] / d[i] - (l1[i + 1] * out[i + 1] if i + 1 < n else 0.0) - (l2[i + 2] * out[i + 2] if i + 2 < n else 0.0)
    return np.array(out)


def lowess(x: np.ndarray, y: np.ndarray, f: float = 0.1, robust_steps: int = 3, delta: float | None = None) -> np.ndarray:
    """Robust local linear regression with tricube weights over the nearest f of the points (x ascending);
    fitted at points more than delta apart (None: a hundredth of the range), linear in between."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    n = len(x)
    if n < 2:
        return y.copy()
    span = x[-1] - x[0]
    delta = 0.01 * span if delta is None else delta
    k = max(2, min(n, int(f * n + 1e-7)))
    anchors, last = [0], 0
    while last < n - 1:  # the farthest point within delta, else the next one
        far = int(np.searchsorted(x, x[last] + delta, side="right")) - 1
        last = max(last + 1, min(far, n - 1))
        anchors.append(last)
    robust = np.ones(n)
    fitted = y.copy()
    for step in range(robust_steps + 1):
        at = []
        left = 0
        for i in anchors:
            while left + k < n and x[i] - x[left] > x[left + k] - x[i]:
                left += 1
            h = max(x[i] - x[left], x[left + k - 1] - x[i])
            stop = max(left + k, int(np.searchsorted(x, x[i] + 0.999 * h, side="right")))
            xs, ys = x[left:stop], y[left:stop]
            r = np.abs(xs - x[i])
            w = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - np.minimum(r / h if h else r, 1.0) ** 3) ** 3, 0.0)) * robust[left:stop]
            if w.sum() <= 0:
                at.append(y[i])
                continue
            w = w / w.sum()
            mid = (w * xs).sum()
            c = (w * (xs - mid) ** 2).sum()
            if h > 0 and math.sqrt(c) > 0.001 * span:
                w = w * ((x[i] - mid) / c * (xs - mid) + 1)
            at.append(float((w * ys).sum()))
        fitted = np.interp(x, x[anchors], at)
        if step == robust_steps:
            break
        off = np.abs(y - fitted)
        limit = 6 * np.median(off)
        if limit <= 1e-7 * off.mean():
            break
        robust = np.where(off <= 0.001 * limit, 1.0, np.where(off <= 0.999 * limit, (1 - (off / limit) ** 2) ** 2, 0.0))
    return fitted


def natural_spline(y: np.ndarray, knots: int = 5) -> np.ndarray:
    """The natural cubic spline over sample numbers through every ``knots``-th sample and the last one; its second
    derivatives at the knots solve a tridiagonal system."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if knots < 1:
        raise ValueError("spline: knots must be positive")
    t = np.unique(np.r_[np.arange(0, n, knots), max(n - 1, 0)]) if n else np.zeros(0, dtype=int)
    k = len(t)
    if k < 3:
        return y.copy() if n < 2 else np.interp(np.arange(n), t, y[t])
    h, rise = np.diff(t).astype(float), np.diff(y[t]) / np.diff(t)
    # forward elimination and back substitution of (h[i-1], 2 (h[i-1] + h[i]), h[i]) m = 6 (rise[i] - rise[i-1])
    c, d, m = np.zeros(k), np.zeros(k), np.zeros(k)
    for i in range(1, k - 1):
        w = 2 * (h[i - 1] + h[i]) - h[i - 1] * c[i - 1]
        c[i] = h[i] / w
        d[i] = (6 * (rise[i] - rise[i - 1]) - h[i - 1] * d[i - 1]) / w
    for i in range(k - 2, 0, -1):
        m[i] = d[i] - c[i] * m[i + 1]
    at = np.arange(n)
    j = np.minimum(np.searchsorted(t, at, side="right") - 1, k - 2)
    a, b, g = t[j + 1] - at, at - t[j], h[j]
    return (m[j] * a**3 + m[j + 1] * b**3) / (6 * g) + (y[t[j]] / g - m[j] * g / 6) * a + (y[t[j + 1]] / g - m[j + 1] * g / 6) * b


# Scaling filters of the Haar and the 4-moment Daubechies wavelet.
WAVELETS = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db4": [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278],
}


def wavelet(x: np.ndarray, name: str = "db4", mode: str = "soft") -> np.ndarray:
    """Shrinkage of wavelet details (full depth, symmetric edges) by the universal threshold."""
    low = np.array(WAVELETS[name])
    high = np.array([(-1) ** k * c for k, c in enumerate(low[::-1])])
    size, a, n = len(low), np.asarray(x, dtype=float), len(x)
    depth = int(math.floor(math.log2(n / (size - 1)))) if n >= size - 1 and n > 1 else 0
    details = []
    for _ in range(max(0, depth)):
        wide = np.pad(a, size - 1, mode="symmetric")
        details.append((np.convolve(wide, high[::-1], "valid")[1::2], len(a)))
        a = np.convolve(wide, low[::-1], "valid")[1::2]
    if not details:
        return np.array(x, dtype=float)
    sigma = np.median(np.abs(details[0][0])) / 0.6745
    limit = sigma * math.sqrt(2 * math.log(n))
    for d, length in reversed(details):
        kept = np.sign(d) * np.maximum(np.abs(d) - limit, 0) if mode == "soft" else np.where(np.abs(d) > limit, d, 0.0)
        up_a, up_d = np.zeros(2 * len(d) - 1), np.zeros(2 * len(d) - 1)
        up_a[::2], up_d[::2] = a[: len(d)], kept
        both = np.convolve(up_a, low) + np.convolve(up_d, high)
        a = both[size - 2 : size - 2 + length]
    return a


def neighbours(mz: np.ndarray, k: int) -> np.ndarray:
    """Each point's k nearest by m/z, itself among them (mz ascending); ties to the lower one."""
    n, k = len(mz), min(k, len(mz))
    start = np.zeros(n, dtype=int)
    left = 0
    for i in range(n):
        while left + k < n and mz[i] - mz[left] > mz[left + k] - mz[i]:
            left += 1
        start[i] = left
    return start[:, None] + np.arange(k)


def neighbour_smooth(mz: np.ndarray, x: np.ndarray, window: int = 5, sd: float | None = None, bilateral: bool = False, sd_intensity: float | None = None) -> np.ndarray:
    """Gaussian (or bilateral) mean over the nearest points by m/z distance."""
    mz, x = np.asarray(mz, dtype=float), np.asarray(x, dtype=float).copy()
    if len(x) == 0:
        return x
    near = neighbours(mz, window)
    gaps = np.abs(mz[near] - mz[:, None])
    bad = np.isnan(x)
    if bad.any():
        whole = np.nanmedian(x) if not bad.all() else 0.0
        for i in np.flatnonzero(bad):
            around = x[near[i]][~np.isnan(x[near[i]])]
            x[i] = around.mean() if len(around) else whole
    sd = np.median(gaps.max(axis=1)) / 2 if sd is None else sd
    if not sd > 0:
        raise ValueError("neighbour_smooth: sd must be positive")
    w = np.exp(np.maximum(-0.5 * (gaps / sd) ** 2, -88))
    if bilateral:
        wide = 1.4826 * np.median(np.abs(x - np.median(x))) if sd_intensity is None else sd_intensity
        if wide > 0:
            w = w * np.exp(np.maximum(-0.5 * ((x[near] - x[:, None]) / wide) ** 2, -88))
    return (w * x[near]).sum(1) / w.sum(1)


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Each peak's height over the higher of the two lowest points on the way to higher ground (or the end)."""
    out = np.zeros(len(peaks))
    for j, p in enumerate(peaks.tolist()):
        above = np.flatnonzero(x[:p] > x[p])
        left = x[above[-1] + 1 if len(above) else 0 : p + 1].min()
        above = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : p + 1 + (above[0] if len(above) else len(x))].min()
        out[j] = x[p] - max(left, right)
    return out


def foot(x: np.ndarray, peak: int, step: int, reach: int = 2) -> int:
    """Where a peak ends on one side: down to the first valley that no lower sample follows within ``reach`` of it."""
    low, at, end = peak, peak + step, len(x) if step > 0 else -1
    while at != end:
        if x[at] < x[low]:
            low = at
        elif x[at] > x[low] and low != peak:
            ahead = [j for j in range(at + step, low + step * (reach + 1), step) if 0 <= j < len(x)]
            lower = next((j for j in ahead if x[j] < x[low]), None)
            if lower is None:
                break
            low = at = lower
        at += step
    return low


def areas(mz: np.ndarray, x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Trapezoid areas over m/z between each peak's feet."""
    out = []
    for p in peaks.tolist():
        a, b = foot(x, p, -1), foot(x, p, 1)
        out.append(float((0.5 * (x[a + 1 : b + 1] + x[a:b]) * np.diff(mz[a : b + 1])).sum()))
    return np.array(out)


def plateau_peaks(x: np.ndarray) -> np.ndarray:
    """Samples (plateau middles, rounded down) with lower ground on both sides."""
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return np.array(out, dtype=int)


def crossings(x: np.ndarray, peaks: np.ndarray, prominence: np.ndarray, rel_height: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Fractional positions left and right of each peak where it has fallen by a share of its prominence."""
    lefts, rights = [], []
    for p, prom in zip(peaks.tolist(), prominence.tolist(), strict=True):
        level = x[p] - rel_height * prom
        i = p
        while i > 0 and x[i] > level:
            i -= 1
        lefts.append(i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i))
        i = p
        while i < len(x) - 1 and x[i] > level:
            i += 1
        rights.append(i - (level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else float(i))
    return np.array(lefts), np.array(rights)


def simpson(t: np.ndarray, y: np.ndarray) -> float:
    """Simpson's rule on uneven points; the last interval of an even count by the parabola of the last three."""
    n = len(t)
    if n < 2:
        return 0.0
    if n == 2:
        return float(0.5 * (t[1] - t[0]) * (y[0] + y[1]))
    total = 0.0
    for i in range(0, n - 2, 2):
        h0, h1 = t[i + 1] - t[i], t[i + 2] - t[i + 1]
        total += (h0 + h1) / 6 * ((2 - h1 / h0) * y[i] + (h0 + h1) ** 2 / (h0 * h1) * y[i + 1] + (2 - h0 / h1) * y[i + 2])
    if n % 2 == 0:
        h0, h1 = t[-2] - t[-3], t[-1] - t[-2]
        total += y[-1] * (2 * h1**2 + 3 * h0 * h1) / (6 * (h0 + h1)) + y[-2] * (h1**2 + 3 * h0 * h1) / (6 * h0) - y[-3] * h1**3 / (6 * h0 * (h0 + h1))
    return float(total)


def origin_peaks(mz: np.ndarray, x: np.ndarray, noise: float, width: float = 2.0, relheight: float = 0.012, prominence: float = 0.0, snr: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(peak indices, Simpson areas between half-prominence crossings): plateau maxima of at least relheight of
    the spectrum's maximum, a prominence and a width, and strictly above snr times the noise."""
    if len(x) < 3:
        return np.zeros(0, dtype=int), np.zeros(0)
    peaks = plateau_peaks(x)
    peaks = peaks[x[peaks] >= relheight * x.max()]
    prom = prominences(x, peaks)
    peaks, prom = peaks[prom >= prominence], prom[prom >= prominence]
    left, right = crossings(x, peaks, prom)
    keep = (right - left >= width) & (x[peaks] > snr * noise)
    peaks, left, right = peaks[keep], left[keep], right[keep]
    out = []
    at = np.arange(len(x))
    for a, b in zip(left, right, strict=True):
        inner = at[(at > a) & (at < b)]
        ts = np.concatenate(([np.interp(a, at, mz)], mz[inner], [np.interp(b, at, mz)]))
        ys = np.concatenate(([np.interp(a, at, x)], x[inner], [np.interp(b, at, x)]))
        out.append(simpson(ts, ys))
    return peaks, np.array(out)


def nearest(axis: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of the nearest axis point of each value; ties to the lower one."""
    right = np.clip(np.searchsorted(axis, values), 0, len(axis) - 1)
    left = np.maximum(right - 1, 0)
    return np.where(np.abs(axis[right] - values) < np.abs(values - axis[left]), right, left)


def matches(mz: np.ndarray, x: np.ndarray, reference: np.ndarray, tolerance: float, relative: bool = True, mode: str = "auto", fill_holes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(positions on the reference axis, intensities there) of the references that a spectrum reaches.

    Down: each reference takes its nearest peak within the tolerance. Up: each peak in turn spreads over the references
    around its nearest one, right then left, as far as the tolerance reaches, stopping at references taken before; each
    takes the peak nearest to it. fill_holes takes every reference within the tolerance of a peak. Auto goes up where
    there are more than twice as many references as peaks.
    """
    if not len(mz) or not len(reference):
        return np.zeros(0, dtype=int), np.zeros(0)
    if mode == "down" or (mode == "auto" and len(reference) <= 2 * len(mz)):
        best = nearest(mz, reference)
        off = np.abs(mz[best] - reference) / (np.abs(reference) if relative else 1.0)
        at = np.flatnonzero(off <= tolerance)
        return at, x[best[at]]
    reach = np.abs(mz) * tolerance if relative else np.full(len(mz), tolerance)
    first, last = np.searchsorted(reference, mz - 2 * reach), np.searchsorted(reference, mz + 2 * reach)
    home = nearest(reference, mz)
    held: list[np.ndarray] = []
    end = -1  # the last reference taken: peaks come in ascending order, so what is taken lies at or before it
    for j, h in enumerate(home.tolist()):
        near = np.arange(first[j], last[j])
        near = near[np.abs(reference[near] - mz[j]) <= reach[j]]
        if len(near) and fill_holes:
            held.append(near)
        elif len(near) and h > end and near[0] <= h <= near[-1]:
            held.append(near[near > end])
            end = int(near[-1])
    at = np.unique(np.concatenate(held)) if held else np.zeros(0, dtype=int)
    best = nearest(mz, reference[at])
    if fill_holes:
        ok = np.abs(mz[best] - reference[at]) <= reach[best]
        at, best = at[ok], best[ok]
    return at, x[best]


def align(mz: np.ndarray, x: np.ndarray, reference: np.ndarray, tolerance: float, relative: bool = True, fill_holes: bool = False) -> np.ndarray:
    """Intensities on the whole reference axis, 0 where no peak is near (see ``matches``)."""
    out = np.zeros(len(reference))
    at, values = matches(mz, x, reference, tolerance, relative, "auto", fill_holes)
    out[at] = values
    return out


def bin_ranges(n: int, bins: int, overlap: float) -> list[tuple[int, int]]:
    """(first, last sample) of the bins of n samples."""
    bins = min(bins, n)
    if overlap == 0:
        return [(b * n // bins, (b + 1) * n // bins - 1) for b in range(bins)]
    width = n / (bins * (1 - overlap) + overlap)
    step = width * (1 - overlap)
    return [(max(0, math.floor(b * step)), min(n - 1, math.ceil(b * step + width) - 1)) for b in range(bins)]


def binned_noise(signal: np.ndarray, method: str, bins: int, overlap: float) -> np.ndarray:
    """The noise curve of a smoothing residual (of the signal itself for "diff") from estimates in bins."""
    n = len(signal)
    if n == 0:
        return np.zeros(0)
    ranges = bin_ranges(n, bins, overlap)
    steps = np.diff(signal)
    values = []
    for k, (a, b) in enumerate(ranges):
        part = signal[a : b + 1]
        part = part[np.isfinite(part)]
        if method == "sd":
            v = part.std(ddof=1) if len(part) > 1 else math.nan
        elif method == "quantile":
            v = np.quantile(part, 0.95) if len(part) else math.nan
        elif method == "mad":
            v = 1.4826 * np.median(np.abs(part - np.median(part))) if len(part) else math.nan
        else:
            low, high = bin_ranges(n - 1, bins, overlap)[min(k, min(bins, n - 1) - 1)] if n > 1 else (0, -1)
            d = steps[low : high + 1]
            d = d[np.isfinite(d)]
            v = np.abs(part - d.mean()).mean() if len(part) and len(d) else math.nan
        values.append(0.0 if math.isnan(v) else float(v))
    return noise_curve(np.array([(a + b) / 2 for a, b in ranges]), np.array(values), n)


def noise_curve(mids: np.ndarray, values: np.ndarray, n: int, degree: int = 3) -> np.ndarray:
    """The curve through bin estimates at all n samples, by local polynomials of at most the degree."""
    mids, at = np.unique(mids, return_inverse=True)
    values = np.bincount(at, values) / np.bincount(at)
    k = min(degree + 1, len(mids))
    grid = np.arange(n, dtype=float)
    first = np.clip(np.searchsorted(mids, grid) - k // 2, 0, len(mids) - k)
    out = np.zeros(n)
    for j in range(k):
        term = values[first + j].copy()
        for l_ in range(k):
            if l_ != j:
                term *= (grid - mids[first + l_]) / (mids[first + j] - mids[first + l_])
        out += term
    return out


class LineFits:
    """Squared errors of straight-line fits to any stretch of a signal, from running sums."""

    def __init__(self, x: np.ndarray):
        x = np.asarray(x, dtype=float)
        t = np.arange(len(x), dtype=float)
        self.sums = [np.concatenate(([0.0], np.cumsum(v))) for v in (np.ones(len(x)), t, t * t, x, t * x, x * x)]

    def error(self, low, stop):
        """Of the samples low to stop (exclusive); arrays give arrays."""
        n, t, tt, x, tx, xx = (s[stop] - s[low] for s in self.sums)
        n = np.maximum(n, 1)
        ct, cx, cc = tt - t * t / n, tx - t * x / n, xx - x * x / n
        return np.maximum(cc - np.where(ct > 0, cx * cx / np.where(ct > 0, ct, 1), 0.0), 0.0)


def dynamic_bins(x: np.ndarray, bins: int = 4, iterations: int = 10) -> list[tuple[int, int]]:
    """Bins (first, last sample) that follow the signal: in turn the neighbouring pair with least error is joined
    and the worst bin split where two lines fit best, as long as the total error falls. At least 3 bins."""
    n, bins = len(x), max(3, bins)
    if n == 0:
        return []
    fits = LineFits(x)
    edges = sorted({k * n // bins for k in range(bins + 1)})
    cost = lambda e: fits.error(np.array(e[:-1]), np.array(e[1:]))
    best = cost(edges)
    for _ in range(iterations):
        if len(edges) < 3:
            break
        p = int(np.argmin(best[:-1] + best[1:]))
        joined = edges[: p + 1] + edges[p + 2 :]
        for k in np.argsort(-cost(joined), kind="stable").tolist():
            low, stop = joined[k], joined[k + 1]
            if stop - low >= 2:
                at = np.arange(low + 1, stop)
                cut = int(at[np.argmin(fits.error(low, at) + fits.error(at, stop))])
                break
        else:
            break
        new = joined[: k + 1] + [cut] + joined[k + 1 :]
        if cost(new).sum() >= best.sum():
            break
        edges, best = new, cost(new)
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]
