"""Arrow UDFs over array columns for the kernels: no shuffle, one spectrum a row, column pruning kept."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels

DOUBLES = "array<double>"


def one(fn: Callable[[np.ndarray], np.ndarray], kind: str = DOUBLES):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else fn(np.asarray(v, dtype=float)) for v in x])

    return run


def two(fn: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str = DOUBLES):
    @F.pandas_udf(kind)
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or w is None else fn(np.asarray(v, dtype=float), np.asarray(w, dtype=float)) for v, w in zip(x, y, strict=True)])

    return run


def snip(intensity: Column, m: int | None = None, decreasing: bool = True) -> Column:
    return one(lambda x: kernels.snip(x, m, decreasing))(intensity)


def asls(intensity: Column, lam: float = 1e7, p: float = 0.01, iterations: int = 15) -> Column:
    return one(lambda x: kernels.asls(x, lam, p, iterations))(intensity)


def wavelet(intensity: Column, name: str = "db4", mode: str = "soft") -> Column:
    return one(lambda x: kernels.wavelet(x, name, mode))(intensity)


def lowess(mz: Column, intensity: Column, f: float = 0.1, robust_steps: int = 3) -> Column:
    return two(lambda m, x: kernels.lowess(m, x, f, robust_steps))(mz, intensity)


def neighbour_smooth(mz: Column, intensity: Column, window: int = 5, sd: float | None = None, bilateral: bool = False, sd_intensity: float | None = None) -> Column:
    return two(lambda m, x: kernels.neighbour_smooth(m, x, window, sd, bilateral, sd_intensity))(mz, intensity)


def natural_spline(values: Column, knots: int = 5) -> Column:
    return one(lambda x: kernels.natural_spline(x, knots))(values)


def marked_prominences(intensity: Column, peak: Column) -> Column:
    """The prominence of the samples marked as peaks, 0 of the others."""

    def run(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(marks > 0)
        out = np.zeros(len(x))
        out[at] = kernels.prominences(x, at)
        return out

    return two(run)(intensity, peak)


def marked_areas(mz: Column, intensity: Column, peak: Column) -> Column:
    """The area of the samples marked as peaks, 0 of the others."""

    @F.pandas_udf(DOUBLES)
    def run(m: pd.Series, x: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(m, x, p, strict=True):
            at = np.flatnonzero(np.asarray(c, dtype=float) > 0)
            held = np.zeros(len(b))
            held[at] = kernels.areas(np.asarray(a), np.asarray(b), at)
            out.append(held)
        return pd.Series(out)

    return run(mz, intensity, peak)


def binned_noise(signal: Column, method: str, bins: int, overlap: float, floor: float) -> Column:
    return one(lambda x: np.maximum(kernels.binned_noise(x, method, bins, overlap), floor))(signal)


def align(mz: Column, intensity: Column, reference: list[float], tolerance: float, relative: bool = True, fill_holes: bool = False) -> Column:
    axis = np.array(reference)
    return two(lambda m, x: kernels.align(m, x, axis, tolerance, relative, fill_holes))(mz, intensity)
