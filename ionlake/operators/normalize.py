"""Intensity normalization; a spectrum whose base is not positive becomes all zeros, or raises if strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import per_spectrum

METHODS = ("tic", "rms", "ref", "median")


def normalize(points: DataFrame, method: str = "tic", scale: float | None = None, ref: float | None = None, ref_tolerance: float = 0.1, strict: bool = False) -> DataFrame:
    """Intensities times scale over the spectrum's base. scale None: the spectrum's length, 1 for ref."""
    if method not in METHODS:
        raise ValueError(f"normalize: unknown method {method}")
    if scale is not None and not 0 <= scale < float("inf"):
        raise ValueError("normalize: scale must be finite and not negative")
    x = F.col("intensity")
    if method == "tic":
        base = F.sum(x).over(per_spectrum())
    elif method == "rms":
        base = F.sqrt(F.avg(F.when(~F.isnan(x), x * x)).over(per_spectrum()))  # NaN samples take no part
    elif method == "median":
        base = F.median(x).over(per_spectrum())
    else:
        if ref is None or ref_tolerance < 0:
            raise ValueError("normalize: ref needs a reference m/z and a tolerance")
        gap = F.abs(F.col("mz") - ref)
        near = F.when(gap <= ref_tolerance, F.struct(gap.alias("gap"), "mz", "i", "intensity"))
        base = F.min(near).over(per_spectrum())["intensity"]  # ties go to the lower m/z
    factor = F.lit(1.0 if method == "ref" else None).cast("double") if scale is None else F.lit(float(scale))
    if scale is None and method != "ref":
        factor = F.col("n").cast("double")
    return points.withColumn("base", base).withColumn("intensity", _scaled(x, factor, F.col("base"), strict)).drop("base")


def _scaled(x: Column, factor: Column, base: Column, strict: bool) -> Column:
    bad = F.raise_error(F.lit("normalize: base is not positive")).cast("double") if strict else F.lit(0.0)
    return F.when((base > 0) & ~F.isnan(base), x * factor / base).otherwise(bad)
