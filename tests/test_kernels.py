import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionlake.functions import kernels, weights

SIGNAL = st.lists(st.floats(0, 100, allow_nan=False), min_size=0, max_size=60)


@given(SIGNAL)
@settings(max_examples=40, deadline=None)
def test_snip_is_never_above_the_signal(x):
    assert (kernels.snip(np.array(x), 4) <= np.array(x) + 1e-12).all()


@pytest.mark.parametrize("n", [0, 1, 2])
def test_short_spectra(n):
    x = np.arange(n, dtype=float)
    assert kernels.snip(x).tolist() == kernels.asls(x).tolist() == x.tolist()
    assert kernels.wavelet(x).tolist() == x.tolist()
    assert len(kernels.lowess(x, x)) == n


def test_asls_solves_its_system():
    rng = np.random.default_rng(1)
    y = rng.random(40)
    n, lam = 40, 50.0
    d = np.diff(np.eye(n), 2, axis=0)
    w, z = np.ones(n), y
    for _ in range(5):
        z = np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)
        w = np.where(y > z, 0.01, 0.99)
    assert np.allclose(kernels.asls(y, lam, 0.01, 5), z)


def test_savgol_rows_reproduce_polynomials():
    rows = weights.savgol(7, 3)
    x = np.arange(7.0)
    y = 2 - x + 0.5 * x**2 - 0.1 * x**3
    assert np.allclose([np.dot(r, y) for r in rows], y)


def test_wavelet_without_noise_is_exact():
    rng = np.random.default_rng(3)
    for n in (16, 33, 100):
        x = np.repeat(rng.random(4), -(-n // 4))[:n] * 50
        assert np.allclose(kernels.wavelet(np.full(n, 3.0)), 3.0)
        assert kernels.wavelet(x, "haar").shape == x.shape


def test_wavelet_filter_bank_inverts():
    rng = np.random.default_rng(4)
    x = rng.random(57)
    old = np.median
    try:
        np.median = lambda *a, **k: 0.0  # no threshold: the transform must give the signal back
        for name in kernels.WAVELETS:
            assert np.allclose(kernels.wavelet(x, name), x)
    finally:
        np.median = old


def test_lowess_follows_a_line():
    x = np.linspace(0, 10, 50)
    assert np.allclose(kernels.lowess(x, 3 * x + 1, 0.3), 3 * x + 1)


def plain_lowess(y, f, steps=3):
    """LOWESS over the samples' numbers, at most 100 of them, point by point. No slope where the weighted spread is a thousandth
    of the range or less; no further step where most residuals are rounding."""
    n = len(y)
    k, robust = max(2, min(n, int(f * n + 1e-7))), [1.0] * n
    for step in range(steps + 1):
        new = []
        for i in range(n):
            lo = next(s for s in range(n - k + 1) if s + k == n or i - s <= s + k - i)
            h = max(i - lo, lo + k - 1 - i)
            w = {j: (1 - (abs(j - i) / h) ** 3) ** 3 * robust[j] for j in range(lo, n) if abs(j - i) <= 0.999 * h}
            total = sum(w.values())
            if total <= 0:
                new.append(y[i])
                continue
            mid = sum(v * j for j, v in w.items()) / total
            spread = sum(v * (j - mid) ** 2 for j, v in w.items()) / total
            slope = sum(v * (j - mid) * y[j] for j, v in w.items()) / total / spread if spread**0.5 > 0.001 * (n - 1) else 0.0
            new.append(sum(v * y[j] for j, v in w.items()) / total + slope * (i - mid))
        off = [abs(a - b) for a, b in zip(y, new, strict=True)]
        cap = 6 * float(np.median(off))
        if step == steps or cap < 1e-7 * sum(off) / n:
            return new
        robust = [1.0 if v <= 0.001 * cap else (1 - (v / cap) ** 2) ** 2 if v <= 0.999 * cap else 0.0 for v in off]


@pytest.mark.parametrize(
    "anchors",  # baselines of users 153 and 1150 of events at sf0.1: the first stops early, the second has a point without a slope
    [
        {0: 1.71, 9: 8.88, 12: 21.16, 18: 2.27, 27: 2.18, 40: 1.37, 47: 0.18, 54: 1.9, 57: 28.06},
        {0: 17.49, 7: 4.74, 14: 2.37, 23: 12.62, 30: 1.74, 36: 3.51, 44: 5.62, 47: 8.36, 50: 12.48, 54: 39.9, 57: 39.55, 67: 8.71},
    ],
)
def test_lowess_of_broken_lines(anchors):
    x = np.arange(max(anchors) + 1.0)
    y = np.interp(x, list(anchors), list(anchors.values()))
    got = kernels.lowess(x, y, 0.2)
    assert np.allclose(got, plain_lowess(y.tolist(), 0.2), rtol=0, atol=1e-8)
    assert np.allclose(got, kernels.lowess(3 * x, y, 0.2), rtol=0, atol=1e-8)  # the axis' unit doesn't matter


def test_neighbour_smoothing_keeps_constants():
    mz = np.cumsum(np.random.default_rng(0).random(30) + 0.1)
    for bilateral in (False, True):
        assert np.allclose(kernels.neighbour_smooth(mz, np.full(30, 2.0), 5, bilateral=bilateral), 2.0)


def test_neighbours_against_sorting():
    mz = np.cumsum(np.random.default_rng(2).random(40) + 0.01)
    for i, row in enumerate(kernels.neighbours(mz, 5)):
        assert np.isclose(np.sort(np.abs(mz[row] - mz[i])), np.sort(np.abs(mz - mz[i]))[:5]).all()


def test_prominence_and_feet():
    x = np.array([0, 3, 1, 5, 2, 4, 0.0])
    assert kernels.prominences(x, np.array([1, 3, 5])).tolist() == [2, 5, 2]
    assert kernels.foot(x, 3, -1) == 0 and kernels.foot(x, 3, 1) == 6  # a lower valley within two samples
    y = np.array([0, 1, 5, 2, 3, 3, 3, 0.0])
    assert kernels.foot(y, 2, 1) == 3


def test_simpson_is_exact_on_parabolas():
    for n in (3, 4, 7, 8):
        t = np.cumsum(np.random.default_rng(n).random(n) + 0.2)
        f = lambda v: v**3 / 3 - v**2 + v
        assert np.isclose(kernels.simpson(t, t**2 - 2 * t + 1), f(t[-1]) - f(t[0]))


def test_plateau_peak_is_the_middle():
    assert kernels.plateau_peaks(np.array([0, 1, 1, 1, 0, 2, 0.0])).tolist() == [2, 5]


def test_align_down_and_idempotence():
    axis = np.array([100.0, 200.0, 300.0])
    got = kernels.align(np.array([100.0001, 299.9]), np.array([5.0, 7.0]), axis, 1e-5)
    assert got.tolist() == [5, 0, 0]
    assert kernels.align(axis, np.array([1.0, 2, 3]), axis, 1e-5).tolist() == [1, 2, 3]


def test_align_up_leaves_a_hole_between_close_peaks():
    axis = np.linspace(99.99, 100.02, 61)
    mz, x = np.array([100.0, 100.0007]), np.array([1.0, 2.0])
    seq, filled = kernels.align(mz, x, axis, 1e-5), kernels.align(mz, x, axis, 1e-5, fill_holes=True)
    assert (seq != 0).sum() <= (filled != 0).sum()
    assert kernels.align(np.zeros(0), np.zeros(0), axis, 1e-5).sum() == 0


def test_nearest_ties_go_down():
    assert kernels.nearest(np.array([1.0, 2.0, 3.0]), np.array([1.5, 2.6, 9.0])).tolist() == [0, 2, 2]


def test_noise_curve_passes_through_its_nodes():
    got = kernels.noise_curve(np.array([0.0, 3, 6, 9]), np.array([1.0, 4, 2, 5]), 10)
    assert np.allclose(got[[0, 3, 6, 9]], [1, 4, 2, 5])


def test_line_fits_against_polyfit():
    x = np.random.default_rng(1).random(30)
    fits = kernels.LineFits(x)
    for a, b in ((0, 30), (3, 9), (4, 6), (7, 8)):
        line = np.polyval(np.polyfit(np.arange(a, b), x[a:b], 1), np.arange(a, b)) if b - a > 1 else x[a:b]
        assert np.isclose(fits.error(a, b), ((x[a:b] - line) ** 2).sum(), atol=1e-9)


def test_dynamic_bins_cover_the_signal_and_find_a_kink():
    x = np.concatenate((np.zeros(37), np.arange(23) * 2.0))
    got = kernels.dynamic_bins(x, 3)
    assert got[0][0] == 0 and got[-1][1] == 59 and all(b[0] == a[1] + 1 for a, b in zip(got, got[1:]))
    fits = kernels.LineFits(x)
    static = sum(fits.error(k * 20, k * 20 + 20) for k in range(3))
    assert sum(fits.error(a, b + 1) for a, b in got) <= static
    assert kernels.dynamic_bins(np.zeros(0)) == [] and kernels.dynamic_bins(np.ones(1)) == [(0, 0)]
