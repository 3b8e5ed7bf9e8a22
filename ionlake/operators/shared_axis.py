"""Spectra on shared m/z axes: each axis is stored once, spectra name it.

What depends on m/z alone (resolution, bins, the matches with a reference axis) is found once an axis and weighted by its
spectra; aligning a spectrum is then one gather by its axis's index. With as many axes as spectra this is the
ordinary way with a join more, so it is meant for images of one or a few axes. Null m/z is the axis of no points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import align
from .align import Domain

#: Points of all axes together that are broadcast: 128 MB of m/z.
MOST_BROADCAST = 16_000_000


def dictionary(spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spectra, axes) of spectra with arrays mz: axis_id in the place of mz, and a row (axis_id, mz) for each different
    array. An id is made of the array's content (two 64-bit hashes and the length), the same in every run."""
    mz = F.coalesce(F.col("mz").cast("array<double>"), F.array().cast("array<double>"))
    named = F.concat_ws("-", F.hex(F.xxhash64(mz)), F.hex(F.xxhash64(F.lit(1), mz)), F.size(mz).cast("string"))
    held = spectra.withColumn("axis_id", named)
    axes = held.select("axis_id", mz.alias("mz")).groupBy("axis_id").agg(F.first("mz").alias("mz"))
    return held.drop("mz"), axes


def _small(axes: DataFrame, array: str = "mz") -> DataFrame:
    """axes, to be broadcast if all of them together are small enough."""
    points = axes.agg(F.sum(F.size(array))).first()[0] or 0
    return F.broadcast(axes) if points <= MOST_BROADCAST else axes


def attach(spectra: DataFrame, axes: DataFrame) -> DataFrame:
    """Spectra with their m/z arrays again."""
    return spectra.join(_small(axes), "axis_id").drop("axis_id")


def weights(spectra: DataFrame) -> DataFrame:
    """(axis_id, spectra): how many spectra lie on each axis."""
    return spectra.groupBy("axis_id").agg(F.count(F.lit(1)).alias("spectra"))


def domain(axes: DataFrame, weight: DataFrame, units: str = "ppm", binfun: str = "median", binratio: float = 2.0) -> Domain:
    """The grid that all spectra give, from one row an axis."""
    spread = align.resolution(axes.select(F.col("axis_id").alias("spectrum_id"), "mz"), units).withColumnRenamed("spectrum_id", "axis_id").join(weight, "axis_id")
    r = F.col("resolution")
    pick = {"median": F.percentile(r, 0.5, F.col("spectra")), "min": F.min(r), "max": F.max(r)}.get(binfun, F.sum(r * F.col("spectra")) / F.sum(F.when(r.isNotNull(), F.col("spectra"))))
    return align.grid_of(*spread.agg(pick, F.min("low"), F.max("high")).first(), units, binratio)


def bins(axes: DataFrame, weight: DataFrame, grid: Domain) -> DataFrame:
    """(bin, mz, count) over all spectra (see ``align.bins``), each axis binned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, mz = align._best_bins(batch, grid)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place), pa.array(mz)], ["axis_id", "bin", "mz"])

    got = axes.select("axis_id", F.col("mz").cast("array<double>").alias("mz")).mapInArrow(run, "axis_id string, bin long, mz double").join(weight, "axis_id")
    return got.groupBy("bin").agg((F.sum(F.col("mz") * F.col("spectra")) / F.sum("spectra")).alias("mz"), F.sum("spectra").alias("count"))


def reference(spectra: DataFrame, axes: DataFrame, units: str = "ppm", binfun: str = "median", binratio: float = 2.0, tolerance: float | None = None) -> tuple[DataFrame, Domain]:
    """The reference peaks and the grid (see ``align.reference``). Of the spectra only the axis ids are read."""
    weight = weights(spectra).persist()  # a row an axis
    grid = domain(axes, weight, units, binfun, binratio)
    if tolerance is not None:
        grid = grid._replace(tolerance=tolerance * 1e-6 if units == "ppm" else tolerance)
    axis = align.merge(bins(axes, weight, grid), grid)
    weight.unpersist()
    return axis, grid


def gather_index(axes: DataFrame, axis: DataFrame | list[float], tolerance: float, relative: bool = True, mode: str = "auto", fill_holes: bool = False) -> DataFrame:
    """(axis_id, peaks, points): for each axis the references that it reaches and the places of the points they take."""

    def rows(part: pa.RecordBatch, r, reference, row, peak, point) -> Iterator[pa.RecordBatch]:
        bounds = np.r_[0, np.cumsum(np.bincount(row, minlength=r.rows))]
        yield pa.RecordBatch.from_arrays([part.column(0), align.ragged.as_list(peak.astype(np.int32), bounds), align.ragged.as_list(r.x[point].astype(np.int32), bounds)], ["axis_id", "peaks", "points"])

    # a point's place stands for its intensity
    held = axes.select("axis_id", F.col("mz").cast("array<double>").alias("mz"), F.transform("mz", lambda _, i: i.cast("double")).alias("intensity"))
    return align._matched(held, axis, tolerance, relative, mode, fill_holes, rows, "axis_id string, peaks array<int>, points array<int>")


def on_axis(spectra: DataFrame, index: DataFrame) -> DataFrame:
    """(spectrum_id, peaks, intensity): each spectrum's intensities at the references that its axis reaches. A spectrum whose
    array is not as long as its axis raises no error; a place beyond it gives null."""
    held = spectra.join(_small(index, "points"), "axis_id")
    return held.select("spectrum_id", "peaks", F.transform("points", lambda p: F.get("intensity", p).cast("double")).alias("intensity"))
