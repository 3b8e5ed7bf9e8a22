"""Peak picking: local maxima, then prominence, relative height and signal to noise, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectrum_udfs
from .baseline import local_maxima
from .layout import nest_points, per_spectrum
from .noise import METHODS, with_noise, with_noise_curve


def checked(width: int, nbins: int, return_type: str, noise: str) -> None:
    if return_type not in ("height", "area"):
        raise ValueError("pick: return_type is height or area")
    if width < 1 or nbins < 1:
        raise ValueError("pick: width and nbins must be positive")
    if noise not in METHODS:
        raise ValueError(f"pick: unknown noise {noise}")


def pick(
    points: DataFrame,
    width: int = 5,
    snr: float | None = 2.0,
    noise: str = "quantile",
    relheight: float | None = None,
    prominence: float | None = None,
    return_type: str = "height",
    nbins: int = 1,
    overlap: float = 0.5,
) -> DataFrame:
    """(spectrum_id, i, mz, intensity) of the peaks; noise is computed only if asked for, along the spectrum if nbins > 1.

    return_type "area" puts the area between a peak's feet in place of its height. Prominence and area need the whole
    spectrum around a peak: the points, already together by spectrum, are then nested once.
    """
    checked(width, nbins, return_type, noise)
    wanted = snr is not None and 0 < snr < float("inf")
    held = points
    if wanted:
        held = with_noise(points, noise) if nbins == 1 else with_noise_curve(points, noise, nbins, overlap)
    r = width // 2
    peaks = held.withColumn("peak", local_maxima(F.col("intensity"), r, r - 1))
    if prominence is not None or return_type == "area":
        peaks = _measured(peaks, prominence is not None, return_type == "area", wanted)
    if prominence is not None:
        peaks = peaks.withColumn("peak", F.col("peak") & (F.col("prominence") >= prominence))
    if relheight is not None:
        top = F.max(F.when(F.col("peak"), F.col("intensity"))).over(per_spectrum())
        peaks = peaks.withColumn("top", top).where((F.col("top") > 0) & (F.col("intensity") / F.col("top") >= relheight)).drop("top")
    peaks = peaks.where("peak")
    if wanted:
        peaks = peaks.where(F.col("intensity") / F.col("noise") >= snr)
    value = F.col("area") if return_type == "area" else F.col("intensity")
    return peaks.select("spectrum_id", "i", "mz", value.alias("intensity"))


def _measured(points: DataFrame, prominence: bool, area: bool, noise: bool) -> DataFrame:
    """Points with the prominence and the area of those marked as peaks."""
    kept = ["mz", "intensity", "peak", *(["noise"] if noise else [])]
    held = nest_points(points, *kept)
    new = []
    if prominence:
        held = held.withColumn("prominence", spectrum_udfs.marked_prominences(F.col("intensity"), F.col("peak")))
        new.append("prominence")
    if area:
        held = held.withColumn("area", spectrum_udfs.marked_areas(F.col("mz"), F.col("intensity"), F.col("peak")))
        new.append("area")
    at = held.select("spectrum_id", F.size("mz").alias("n"), F.posexplode(F.arrays_zip(*kept, *new)).alias("i", "p"))
    return at.select("spectrum_id", "i", "n", *(f"p.{c}" for c in (*kept, *new)))
