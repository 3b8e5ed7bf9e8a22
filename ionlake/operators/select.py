"""Choosing points, spectra and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import per_spectrum, in_order


def crop_mz(points: DataFrame, low: float, high: float) -> DataFrame:
    """Points within [low, high], numbered anew."""
    if low > high:
        raise ValueError("crop_mz: low is above high")
    kept = points.where(F.col("mz").between(low, high))
    return kept.select("spectrum_id", (F.row_number().over(in_order()) - 1).alias("i"), F.count(F.lit(1)).over(per_spectrum()).cast("int").alias("n"), "mz", "intensity")


def sort_by_mz(points: DataFrame) -> DataFrame:
    """Points renumbered in ascending m/z; equal m/z keep their order."""
    return points.withColumn("i", F.row_number().over(per_spectrum().orderBy("mz", "i")) - 1)


def is_sorted(points: DataFrame) -> DataFrame:
    """(spectrum_id, is_sorted): of every spectrum, not of a sample."""
    steps = points.withColumn("back", F.coalesce(F.lag("mz").over(in_order()) > F.col("mz"), F.lit(False)))
    return steps.groupBy("spectrum_id").agg((~F.bool_or("back")).alias("is_sorted"))


def spatial_window(spectra: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """Spectra of an inclusive box of pixels; z is free."""
    if x1 > x2 or y1 > y2:
        raise ValueError("spatial_window: corners must ascend")
    return spectra.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))


def pixel(spectra: DataFrame, x: int, y: int, z: int | None = None) -> DataFrame:
    found = spectra.where((F.col("x") == x) & (F.col("y") == y))
    return found if z is None else found.where(F.col("z") == z)


def rows_slice(spectra: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    """Spectra by file order, as a slice start:stop:step."""
    sid = F.col("spectrum_id")
    return spectra.where((sid >= start) & (sid < stop) & ((sid - start) % step == 0))


def upsert(spectra: DataFrame) -> DataFrame:
    """One spectrum a pixel: the first one's position, the last one's content."""
    others = [c for c in spectra.columns if c not in ("x", "y", "z", "spectrum_id")]
    last = F.max_by(F.struct(*others), "spectrum_id").alias("p")
    return spectra.groupBy("x", "y", "z").agg(F.min("spectrum_id").alias("spectrum_id"), last).select("spectrum_id", "x", "y", "z", "p.*")


def clamp_negative(points: DataFrame) -> DataFrame:
    return points.withColumn("intensity", F.greatest(F.col("intensity"), F.lit(0.0)))
