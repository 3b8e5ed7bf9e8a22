"""Between one row a spectrum (arrays) and one row a point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import spectrum_udfs


def per_spectrum() -> WindowSpec:
    return Window.partitionBy("spectrum_id")


def in_order() -> WindowSpec:
    return per_spectrum().orderBy("i")


def whole() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def explode_points(spectra: DataFrame) -> DataFrame:
    """Spectra with arrays mz and intensity to points; no shuffle."""
    at = spectra.select("spectrum_id", F.size("intensity").alias("n"), F.posexplode(F.arrays_zip("mz", "intensity")).alias("i", "p"))
    return at.select("spectrum_id", "i", "n", "p.mz", "p.intensity")


def nest_points(points: DataFrame, *values: str) -> DataFrame:
    """Points to one row a spectrum with arrays in point order; a spectrum is bounded by its instrument's axis."""
    names = values or ("mz", "intensity")
    held = points.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("p"))
    return held.select("spectrum_id", *(F.col(f"p.{v}").alias(v) for v in names))


def as_arrays(spectra: DataFrame, *values: str) -> DataFrame:
    """Spectra with arrays as they are, points nested."""
    return spectra if isinstance(spectra.schema["mz"].dataType, ArrayType) else nest_points(spectra, *values)


def through_arrays(points: DataFrame, value: Callable[[Column, Column], Column], into: str = "intensity") -> DataFrame:
    """Points with a value for each that a function of whole spectra (arrays mz and intensity) gives. Points that a window
    has partitioned by spectrum are nested and exploded again without a further shuffle."""
    held = nest_points(points).withColumn("value", value(F.col("mz"), F.col("intensity")))
    at = held.select("spectrum_id", F.size("mz").alias("n"), F.posexplode(F.arrays_zip("mz", "intensity", "value")).alias("i", "p"))
    return at.select("spectrum_id", "i", "n", "p.mz", "p.intensity", F.col("p.value").alias("new")).withColumn(into, F.col("new")).drop("new")


def padded(spectra: DataFrame, width: int | None = None) -> DataFrame:
    """Rows of a matrix: (spectrum_id, n, mz, intensity) with arrays of one width, zeros behind a spectrum's n points. The
    width is that of the longest spectrum (one number comes to the driver), or given; a longer spectrum then raises."""
    held = as_arrays(spectra).select("spectrum_id", "mz", "intensity")
    if width is None:
        width = held.agg(F.max(F.size("intensity"))).first()[0] or 0
    n = F.size("intensity")
    n = F.when(n <= width, n).otherwise(F.raise_error(F.lit("padded: a spectrum is longer than the width")).cast("int"))
    fill = lambda c: F.concat(F.col(c).cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(width) - n)).alias(c)
    return held.select("spectrum_id", F.size("intensity").alias("n"), fill("mz"), fill("intensity"))


def smoothed_baseline(points: DataFrame, way: str, span: float = 0.1, over: str = "index", knots: int = 5) -> DataFrame:
    """Points with their column ``baseline`` smoothed by LOWESS (over the samples' numbers or m/z) or by a spline."""
    nested = nest_points(points, "mz", "intensity", "baseline")
    if way == "lowess":
        axis = F.col("mz") if over == "mz" else F.transform("mz", lambda _, i: i.cast("double"))
        value = spectrum_udfs.lowess(axis, F.col("baseline"), span)
    else:
        value = spectrum_udfs.natural_spline(F.col("baseline"), knots)
    at = nested.withColumn("value", value).select("spectrum_id", F.size("mz").alias("n"), F.posexplode(F.arrays_zip("mz", "intensity", "value")).alias("i", "p"))
    return at.select("spectrum_id", "i", "n", "p.mz", "p.intensity", F.col("p.value").alias("baseline"))


def finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
