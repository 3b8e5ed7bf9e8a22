"""Noise of a spectrum: the spread of what smoothing removes, or of first differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ragged, spectrum_udfs, weights
from .layout import finite, in_order, nest_points, per_spectrum
from .smooth import convolved

METHODS = ("sd", "mad", "quantile", "diff")
FLOOR = 0.001


def residual(x: Column, window: int = 9, sd: float = 2.0) -> Column:
    return F.abs(convolved(x, weights.gaussian(window, sd)) - x)


def _floored(v: Column) -> Column:
    return F.greatest(F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(FLOOR)), F.lit(FLOOR))


def with_noise_curve(points: DataFrame, method: str = "sd", bins: int = 4, overlap: float = 0.5) -> DataFrame:
    """Points with the noise at each: estimates in bins (see ``bin_bounds``), put at their midpoints and joined by local
    cubic polynomials, never below the floor. Non-finite samples take no part."""
    if method not in METHODS:
        raise ValueError(f"noise: unknown method {method}")
    bin_bounds(F.col("n"), bins, overlap)  # checks the parameters
    signal = F.col("intensity") if method == "diff" else residual(F.col("intensity"))
    held = points.withColumn("own", F.col("intensity")).withColumn("intensity", signal)
    own = held.select("spectrum_id", "i", "n", "mz", F.col("own").alias("intensity"), F.col("intensity").alias("s"))
    nested = nest_points(own, "mz", "intensity", "s").withColumn("noise", spectrum_udfs.binned_noise(F.col("s"), method, bins, overlap, FLOOR))
    at = nested.select("spectrum_id", F.size("mz").alias("n"), F.posexplode(F.arrays_zip("mz", "intensity", "noise")).alias("i", "p"))
    return at.select("spectrum_id", "i", "n", "p.mz", "p.intensity", "p.noise")


def with_noise(points: DataFrame, method: str = "sd") -> DataFrame:
    """Points with their spectrum's noise; every window runs over the same partitions. Non-finite samples take no part."""
    if method not in METHODS:
        raise ValueError(f"noise: unknown method {method}")
    x = F.col("intensity")
    if method == "diff":
        # the mean step of finite neighbours: from end to end where all samples are finite
        ends = F.max_by(x, "i").over(per_spectrum()) - F.min_by(x, "i").over(per_spectrum())
        step = x - F.lag(x).over(in_order())
        held = points.withColumn("step", F.when(finite(step), step)).withColumn("whole", F.min(finite(x)).over(per_spectrum()))
        held = held.withColumn("mean_step", F.when(F.col("whole"), F.when(F.col("n") > 1, ends / (F.col("n") - 1))).otherwise(F.avg("step").over(per_spectrum())))
        off = F.when(finite(x), F.abs(x - F.col("mean_step")))
        return held.withColumn("noise", _floored(F.avg(off).over(per_spectrum()))).drop("mean_step", "step", "whole")
    held = points.withColumn("r", residual(x)).withColumn("r", F.when(finite(F.col("r")), F.col("r")))  # the others take no part
    r = F.col("r")
    if method == "sd":
        out = held.withColumn("noise", _floored(F.stddev_samp(r).over(per_spectrum())))
    elif method == "quantile":
        out = held.withColumn("noise", _floored(F.percentile(r, 0.95).over(per_spectrum())))
    else:
        held = held.withColumn("mid", F.median(r).over(per_spectrum()))
        out = held.withColumn("noise", _floored(F.lit(1.4826) * F.median(F.abs(r - F.col("mid"))).over(per_spectrum()))).drop("mid")
    return out.drop("r")


def noise(points: DataFrame, method: str = "sd") -> DataFrame:
    """(spectrum_id, noise)."""
    return with_noise(points, method).groupBy("spectrum_id").agg(F.first("noise").alias("noise"))


def bin_bounds(n: Column, bins: int, overlap: float = 0.0) -> Column:
    """Array of (b, low, high) index ranges, inclusive, of a spectrum of n points."""
    if not 0 <= overlap < 1 or bins < 1:
        raise ValueError("bins must be positive and overlap in [0, 1)")
    ks = F.sequence(F.lit(0), F.lit(bins - 1))
    if overlap == 0:
        return F.transform(ks, lambda b: F.struct(b.alias("b"), F.floor(b * n / bins).cast("int").alias("low"), (F.floor((b + 1) * n / bins) - 1).cast("int").alias("high")))
    width = n / (bins * (1 - overlap) + overlap)
    step = width * (1 - overlap)
    return F.transform(ks, lambda b: F.struct(b.alias("b"), F.greatest(F.lit(0), F.floor(b * step)).cast("int").alias("low"), F.least(n - 1, F.ceil(b * step + width) - 1).cast("int").alias("high")))


def binned_noise(points: DataFrame, bins: int = 4, overlap: float = 0.0, method: str = "sd") -> DataFrame:
    """(spectrum_id, b, mid, noise): the estimate in each bin at its midpoint."""
    x = F.col("intensity")
    held = points.withColumn("r", residual(x) if method != "diff" else x).withColumn("at", F.explode(bin_bounds(F.col("n"), bins, overlap)))
    held = held.where((F.col("i") >= F.col("at.low")) & (F.col("i") <= F.col("at.high")))
    r = F.col("r")
    spread = {"sd": F.stddev_samp(r), "quantile": F.percentile(r, 0.95), "mad": F.lit(1.4826) * F.median(F.abs(r - F.col("m")))}
    if method == "mad":
        from pyspark.sql import Window

        held = held.withColumn("m", F.median(r).over(Window.partitionBy("spectrum_id", "at.b")))
    elif method not in spread:
        raise ValueError(f"binned_noise: unknown method {method}")
    else:
        held = held.withColumn("m", F.lit(0.0))
    return held.groupBy("spectrum_id", F.col("at.b").alias("b"), ((F.col("at.low") + F.col("at.high")) / 2).alias("mid")).agg(_floored(spread[method]).alias("noise"))


def dynamic_bins(spectra: DataFrame, bins: int = 4, iterations: int = 10) -> DataFrame:
    """(spectrum_id, low, high, noise) of spectra with arrays: bins that follow the signal, and the noise in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, r in ragged.ragged_slices(batch):
                row, low, high, value = ragged.dynamic_bins(r, bins, iterations)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(value)], ["spectrum_id", "low", "high", "noise"])

    kind = spectra.schema["spectrum_id"].dataType.simpleString()
    return spectra.select("spectrum_id", "mz", "intensity").mapInArrow(run, f"spectrum_id {kind}, low int, high int, noise double")


def snr(points: DataFrame, method: str = "sd") -> DataFrame:
    """(spectrum_id, signal, noise, snr): the 95th percentile of intensity over the mean noise."""
    held = with_noise(points, method)
    out = held.groupBy("spectrum_id").agg(F.percentile("intensity", 0.95).alias("signal"), F.avg("noise").alias("noise"))
    return out.withColumn("snr", F.when(F.col("noise") <= 0, float("inf")).otherwise(F.col("signal") / F.col("noise")))
