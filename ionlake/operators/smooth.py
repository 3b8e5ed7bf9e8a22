"""Smoothing along a spectrum with window functions (edges repeat the outermost sample)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import weights
from .layout import per_spectrum, in_order, whole


def moving_average(points: DataFrame, window: int = 5, coef: list[float] | None = None) -> DataFrame:
    """Centred mean, or a convolution with ``coef`` (odd length, made to sum to 1, flipped as convolutions are)."""
    if coef is not None:
        if len(coef) % 2 == 0:
            raise ValueError("coef must have odd length")
        return _convolve(points, [c / sum(coef) for c in reversed(coef)])
    window = weights.odd(window)
    r = window // 2
    x, i, n = F.col("intensity"), F.col("i"), F.col("n")
    inside = F.sum(x).over(in_order().rowsBetween(-r, r))
    left, right = F.greatest(F.lit(0), F.lit(r) - i), F.greatest(F.lit(0), F.lit(r) - (n - 1 - i))
    return points.withColumn("intensity", (inside + left * F.first(x).over(whole()) + right * F.last(x).over(whole())) / window)


def gaussian(points: DataFrame, window: int = 5, sd: float | None = None) -> DataFrame:
    return _convolve(points, weights.gaussian(window, sd))


def _convolve(points: DataFrame, kernel: list[float]) -> DataFrame:
    return points.withColumn("intensity", convolved(F.col("intensity"), kernel))


def convolved(x: Column, kernel: list[float]) -> Column:
    r = len(kernel) // 2
    first, last = F.first(x).over(whole()), F.last(x).over(whole())

    def at(k: int) -> Column:
        if k == 0:
            return x
        return F.coalesce(F.lag(x, -k).over(in_order()), first) if k < 0 else F.coalesce(F.lead(x, k).over(in_order()), last)

    return reduce(add, (F.lit(w) * at(k - r) for k, w in enumerate(kernel)))


def savgol(points: DataFrame, window: int = 5, polyorder: int = 3, deriv: int = 0, delta: float = 1.0) -> DataFrame:
    """Least-squares polynomial smoothing; the first and last half window take the outermost window's
    polynomial; spectra shorter than the window stay as they are."""
    rows = weights.savgol(window, polyorder, deriv, delta)
    w = len(rows)
    half = w // 2
    x, i, n = F.col("intensity"), F.col("i"), F.col("n")
    near = {0: x} | {d: (F.lead(x, d) if d > 0 else F.lag(x, -d)).over(in_order()) for d in range(1 - w, w) if d}
    held = points.select("*", *(c.alias(f"at_{d + w}") for d, c in near.items()))
    place = F.when(i < half, i).when(i >= n - half, w - (n - i)).otherwise(half)
    value = F.when(n < w, x)
    for p, row in enumerate(rows):
        value = value.when(place == p, reduce(add, (F.lit(k) * F.col(f"at_{j - p + w}") for j, k in enumerate(row))))
    return held.withColumn("intensity", value).drop(*(f"at_{d + w}" for d in near))
