"""The registered queries over the driver's tables; ``oracles`` has the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ragged
from .operators import align, baseline, layout, noise, normalize, peaks, select, shared_axis, smooth, summary
from .oracles import ORACLES  # noqa: F401
from .plans.pipeline import Pipeline, fused
from .sources import tables as t
from .sources import tiles

Query = Callable[[SparkSession, str], DataFrame]


def rounded(c: str, digits: int = 6):
    """Rounded, and without a negative zero."""
    return (F.round(F.col(c), digits) + F.lit(0.0)).alias(c)


def curve(points: DataFrame, value: str = "intensity", digits: int = 6) -> DataFrame:
    return points.select("spectrum_id", "i", rounded(value, digits))


def peak_list(found: DataFrame) -> DataFrame:
    return found.select("spectrum_id", "i", rounded("mz", 6), rounded("intensity", 6))


def events(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(t.event_points(spark, sf_dir))


def lines(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(t.lineitem_points(spark, sf_dir))


def event_arrays(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(t.event_spectra(spark, sf_dir))


def line_arrays(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(t.lineitem_spectra(spark, sf_dir))


def stored_lines(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """For alignment, which passes over all spectra three times: these are rows here, so they are put together once."""
    return lambda spark, sf_dir: fn(t.stored(t.lineitem_spectra(spark, sf_dir)))


def vector_arrays(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """Over embeddings with their shared axis in each row."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = t.embedding_spectra(spark, sf_dir)
        return fn(held.withColumn("mz", F.transform("intensity", lambda _, i: F.lit(100.0) + F.lit(0.5) * i)))

    return run


def array_curve(spectra: DataFrame, value: str = "intensity") -> DataFrame:
    """Spectra with arrays, point by point."""
    out = spectra.select("spectrum_id", F.posexplode("intensity").alias("i", value))
    return out.select("spectrum_id", "i", rounded(value))


def array_peaks(found: DataFrame) -> DataFrame:
    out = found.select("spectrum_id", F.explode(F.arrays_zip("i", "mz", "intensity")).alias("p"))
    return out.select("spectrum_id", "p.i", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity")).select("spectrum_id", "i", rounded("mz"), rounded("intensity"))


def baseline_of(fn: Callable[[ragged.Ragged], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """The estimate itself, in one pass over batches."""
    return lambda s: array_curve(fused(s, [lambda r: r.with_x(fn(r))]), "baseline")


def embeddings(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(t.embedding_points(spark, sf_dir))


def spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.spatial_window(t.embedding_spectra(spark, sf_dir), 3, 2, 12, 6).select("spectrum_id", "x", "y", "z")


def pixel_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors dealt to fewer pixels than there are, so that later ones replace earlier ones."""
    s = t.embedding_spectra(spark, sf_dir).withColumn("x", (F.col("spectrum_id") % 5).cast("int")).withColumn("y", (F.col("spectrum_id") % 7).cast("int"))
    out = select.upsert(s)
    return out.select("spectrum_id", "x", "y", "z", "region", F.posexplode("intensity").alias("i", "intensity")).withColumn("intensity", rounded("intensity"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.duplicates(t.embedding_spectra(spark, sf_dir), "region", "intensity")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.dense_mask(t.embedding_spectra(spark, sf_dir))


def ion_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.ion_image(t.embedding_points(spark, sf_dir), t.embedding_spectra(spark, sf_dir), 110.0, 1.0).select("x", "y", rounded("intensity"))


def align_domain(points: DataFrame) -> DataFrame:
    g = align.domain(points)
    return points.sparkSession.createDataFrame([(g.low, g.high, g.step, g.tolerance)], "low double, high double, step double, tolerance double")


def align_bins(points: DataFrame) -> DataFrame:
    return align.bins(points, align.domain(points)).select("bin", rounded("mz", 9), "count")


def align_merge(points: DataFrame) -> DataFrame:
    axis, _ = align.reference(points)
    return axis.select("peak", rounded("mz", 9), "count")


def align_down(points: DataFrame) -> DataFrame:
    axis, grid = align.reference(points)
    return align.align_down(points, axis, grid).select("spectrum_id", "peak", rounded("intensity"))


def on_axis(mode: str) -> Callable[[DataFrame], DataFrame]:
    """Spectra on the reference axis that they give."""

    def run(points: DataFrame) -> DataFrame:
        axis, grid = align.reference(points)
        return align.on_axis(points, axis, grid.tolerance, grid.relative, mode).select("spectrum_id", "peak", rounded("intensity"))

    return run


def align_dense(spectra: DataFrame) -> DataFrame:
    """The filled axis of every spectrum, summed up by block."""
    axis, grid = align.reference(spectra)
    blocks = align.dense_blocks(spectra, axis, grid.tolerance, grid.relative, block=1000)
    reached = F.aggregate("aligned", F.lit(0), lambda n, v: n + (v != 0).cast("int"))
    total = F.aggregate("aligned", F.lit(0.0), lambda n, v: n + v)
    return blocks.select("spectrum_id", "block", F.size("aligned").alias("references"), reached.alias("reached"), F.round(total, 6).alias("total"))


def align_shared_axis(spectra: DataFrame) -> DataFrame:
    """Spectra on three axes, each stored, binned and matched once."""
    held, axes = shared_axis.dictionary(spectra)
    axes = axes.persist()
    axis, grid = shared_axis.reference(held, axes, binratio=0.6)
    out = shared_axis.on_axis(held, shared_axis.gather_index(axes, axis, grid.tolerance, grid.relative))
    at = out.select("spectrum_id", F.explode(F.arrays_zip("peaks", "intensity")).alias("p"))
    return at.select("spectrum_id", F.col("p.peaks").alias("peak"), F.col("p.intensity").alias("intensity")).select("spectrum_id", "peak", rounded("intensity"))


def aligned_pipeline(spectra: DataFrame) -> DataFrame:
    out = Pipeline(spectra).peak_align().peak_pick(width=3, snr=None).start()
    at = out.select("spectrum_id", F.explode(F.arrays_zip("i", "mz", "intensity")).alias("p"))
    return at.select("spectrum_id", F.col("p.i").alias("peak"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity")).select("spectrum_id", "peak", rounded("mz", 9), rounded("intensity"))


def full_plan(spectra: DataFrame) -> DataFrame:
    """Called out of order on purpose: the plan sorts its steps."""
    return Pipeline(spectra).peak_pick(width=5, snr=2.0, noise="sd").normalization("tic").noise_reduction("gaussian", window=5).baseline_correction("locmin", width=5).start()


def peaks_area(points: DataFrame) -> DataFrame:
    return peaks.pick(points, 5, 2.0, "sd", return_type="area").select("spectrum_id", "i", F.round("intensity", 6).alias("area"))


def peaks_prominence(points: DataFrame) -> DataFrame:
    marked = points.withColumn("peak", baseline.local_maxima(F.col("intensity"), 2, 1))
    out = peaks._measured(marked, True, False, False).where("peak").select("spectrum_id", "i", F.round("prominence", 6).alias("prominence"))
    return out.where(F.col("prominence") >= 20)


def peaks_origin(spectra: DataFrame) -> DataFrame:
    """Peaks by shape, with their heights and areas."""
    areas = Pipeline(spectra.withColumn("height", F.col("intensity"))).peak_pick("shape", noise="sd").start()
    height = F.transform("i", lambda k: F.get("height", k))
    out = areas.select("spectrum_id", F.explode(F.arrays_zip("i", "mz", height.alias("height"), F.col("intensity").alias("area"))).alias("p"))
    return out.select("spectrum_id", "p.i", F.round("p.mz", 6).alias("mz"), F.round("p.height", 6).alias("intensity"), F.round("p.area", 6).alias("area"))


def noise_curve(points: DataFrame) -> DataFrame:
    return noise.with_noise_curve(points, "sd", 4, 0.5).select("spectrum_id", "i", rounded("noise"))


def matrix(points: DataFrame) -> DataFrame:
    """The padded matrix, cell by cell."""
    cells = layout.padded(points).select("spectrum_id", F.posexplode(F.arrays_zip("mz", "intensity")).alias("i", "c"))
    return cells.select("spectrum_id", "i", "c.mz", "c.intensity").select("spectrum_id", "i", rounded("mz"), rounded("intensity"))


def smoothed_baseline(points: DataFrame) -> DataFrame:
    """The local-minimum baseline, then LOWESS over the samples' numbers."""
    return curve(layout.smoothed_baseline(baseline.locmin(points, 5), "lowess", 0.2), "baseline")


def dynamic_bins(spectra: DataFrame) -> DataFrame:
    """Bins that follow the signal, with the noise of the smoothing residual in each."""
    return noise.dynamic_bins(spectra).select("spectrum_id", "low", "high", F.round("noise", 6).alias("noise"))


def metrics(points: DataFrame) -> DataFrame:
    out = summary.before_after(points, smooth.gaussian(points, 5))
    return out.select("spectrum_id", rounded("correlation"), rounded("tic_ratio"), rounded("snr_before", 4), rounded("snr_after", 4), rounded("snr_gain", 4))


def statistics(points: DataFrame) -> DataFrame:
    return summary.statistics(points).select("spectrum_id", "n", rounded("mz_min"), rounded("mz_max"), rounded("base_mz"), rounded("base_intensity"), rounded("tic", 4))


def noise_of(method: str) -> Callable[[DataFrame], DataFrame]:
    return lambda p: noise.noise(p, method).select("spectrum_id", rounded("noise"))


def picked_by(method: str) -> Callable[[DataFrame], DataFrame]:
    return lambda s: array_peaks(Pipeline(s).peak_pick(width=5, snr=2.0, noise=method).start())


def peaks_of(method: str) -> Callable[[DataFrame], DataFrame]:
    return lambda p: peak_list(peaks.pick(p, 5, 2.0, method))


def imzml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's spectra written as imzML, each axis once a file, and read again by several tasks a file."""
    folder = t.as_imzml(spark, t.shifted_spectra(spark, sf_dir), mode="auto", dedup="true")
    back = spark.read.format("imzml").option("splitBytes", 100_000).load(folder)
    return back.select("x", "y", F.posexplode(F.arrays_zip("mz", "intensity")).alias("i", "p")).select("x", "y", "i", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity")).select("x", "y", "i", rounded("mz"), rounded("intensity"))


def imzml_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of pixels: filters reach the reader, which reads no array of other pixels, and no m/z at all."""
    folder = t.as_imzml(spark, t.shifted_spectra(spark, sf_dir))
    back = spark.read.format("imzml").schema("x int, y int, intensity array<double>").load(folder).where("x >= 3 and x <= 12 and y in (2, 4, 6)")
    return back.select("x", "y", F.round(F.aggregate("intensity", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def imzml_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the arrays lie: lengths and types of every pixel's arrays, from the headers alone."""
    found = t.imzml.layout(spark, t.as_imzml(spark, t.shifted_spectra(spark, sf_dir), mode="processed"))
    return found.select("x", "y", "mz_length", "mz_bytes", "mz_type", "intensity_length", "intensity_bytes", "intensity_type")


def tiles_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image stored by tiles of 8 by 8 pixels, and a window of it read from few of them."""
    path = t.scratch(spark)
    tiles.write_tiles(t.embedding_spectra(spark, sf_dir), path, 8)
    found = tiles.read_tiles(spark, path, (3, 2, 12, 6), 8)
    return found.select("spectrum_id", "x", "y", "region", F.round(F.aggregate("intensity", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


QUERIES: dict[str, Query] = {
    "tiles_window": tiles_window,
    "imzml_round_trip": imzml_round_trip,
    "imzml_window": imzml_window,
    "imzml_layout": imzml_layout,
    "points_events": events(lambda p: p.select("spectrum_id", "i", "n", rounded("mz"), rounded("intensity"))),
    "points_embeddings": embeddings(lambda p: p.select("spectrum_id", "i", "n", rounded("mz"), rounded("intensity"))),
    "points_lineitem": lines(lambda p: p.select("spectrum_id", "i", "n", rounded("mz"), rounded("intensity"))),
    "matrix_scan": events(matrix),
    "crop_mz": events(lambda p: select.crop_mz(p, 500.0, 1500.0).select("spectrum_id", "i", "n", rounded("mz"), rounded("intensity"))),
    "is_sorted": events(select.is_sorted),
    "spatial_window": spatial,
    "pixel_upsert": pixel_upsert,
    "rows_slice": lambda s, d: select.rows_slice(t.embedding_spectra(s, d), 10, 200, 3).select("spectrum_id", "x", "y"),
    "clamp_negative": events(lambda p: curve(select.clamp_negative(p.withColumn("intensity", F.col("intensity") - 20)))),
    "spectrum_stats": events(statistics),
    "norm_tic": event_arrays(lambda s: array_curve(Pipeline(s).normalization("tic").start())),
    "norm_rms": event_arrays(lambda s: array_curve(Pipeline(s).normalization("rms").start())),
    "norm_ref": event_arrays(lambda s: array_curve(Pipeline(s).normalization("ref", ref=1000.0, ref_tolerance=20.0).start())),
    "norm_median": event_arrays(lambda s: array_curve(Pipeline(s).normalization("median").start())),
    "smooth_ma": event_arrays(lambda s: array_curve(Pipeline(s).noise_reduction("ma", window=5).start())),
    "smooth_ma_coef": event_arrays(lambda s: array_curve(Pipeline(s).noise_reduction("ma", coef=[1.0, 2.0, 4.0]).start())),
    "smooth_gaussian": event_arrays(lambda s: array_curve(Pipeline(s).noise_reduction("gaussian", window=5).start())),
    "smooth_savgol": vector_arrays(lambda s: array_curve(Pipeline(s).noise_reduction("savgol", window=7, polyorder=2).start())),
    # the same over points, by windows
    "norm_tic_points": events(lambda p: curve(normalize.normalize(p, "tic"))),
    "norm_rms_points": events(lambda p: curve(normalize.normalize(p, "rms"))),
    "norm_ref_points": events(lambda p: curve(normalize.normalize(p, "ref", ref=1000.0, ref_tolerance=20.0))),
    "norm_median_points": events(lambda p: curve(normalize.normalize(p, "median"))),
    "smooth_ma_points": events(lambda p: curve(smooth.moving_average(p, 5))),
    "smooth_gaussian_points": events(lambda p: curve(smooth.gaussian(p, 5))),
    "smooth_savgol_points": embeddings(lambda p: curve(smooth.savgol(p, 7, 2))),
    "smooth_wavelet": event_arrays(lambda s: array_curve(Pipeline(s).noise_reduction("wavelet").start(), "value")),
    "smooth_gaussian_ns": event_arrays(lambda s: array_curve(Pipeline(s).noise_reduction("gaussian_ns", window=5).start(), "value")),
    "smooth_bi_ns": event_arrays(lambda s: array_curve(Pipeline(s).noise_reduction("bi_ns", window=5).start(), "value")),
    "noise_sd": events(noise_of("sd")),
    "noise_mad": events(noise_of("mad")),
    "noise_quantile": events(noise_of("quantile")),
    "noise_diff": events(noise_of("diff")),
    "noise_bins_sd": events(lambda p: noise.binned_noise(p, 4).select("spectrum_id", "b", "mid", rounded("noise"))),
    "noise_bins_overlap": events(lambda p: noise.binned_noise(p, 4, 0.5, "quantile").select("spectrum_id", "b", "mid", rounded("noise"))),
    "noise_curve": events(noise_curve),
    "noise_bins_dynamic": event_arrays(dynamic_bins),
    "snr_spectrum": events(lambda p: noise.snr(p).select("spectrum_id", rounded("signal"), rounded("noise"), rounded("snr", 4))),
    "baseline_locmin": event_arrays(baseline_of(lambda r: ragged.locmin(r, 5))),
    "baseline_locmin_upper": event_arrays(baseline_of(lambda r: ragged.locmin(r, 5, upper=True))),
    "baseline_snip_m5": line_arrays(baseline_of(lambda r: ragged.snip(r, 5))),
    "baseline_corrected": event_arrays(lambda s: array_curve(Pipeline(s).baseline_correction("locmin", width=5, scale=0.9).start())),
    "baseline_spline": event_arrays(baseline_of(lambda r: ragged.spline(r, ragged.locmin(r, 5), 5))),
    "baseline_locmin_points": events(lambda p: curve(baseline.locmin(p, 5), "baseline")),
    "baseline_snip_m5_points": lines(lambda p: curve(baseline.snip(p, 5), "baseline")),
    "baseline_asls": event_arrays(lambda s: array_curve(fused(s, [lambda r: r.with_x(ragged.asls(r, 1e4))]), "value")),
    # halved again and again, values lie on the edge of rounding; shifted a little they don't
    "baseline_snip_auto": event_arrays(lambda s: array_curve(fused(s, [lambda r: r.with_x(ragged.snip(r) + 1e-9)]), "value")),
    "baseline_lowess": event_arrays(lambda s: array_curve(fused(s, [lambda r: r.with_x(ragged.lowess(r, r.x, 0.3, "mz"))]), "value")),
    "baseline_locmin_lowess": lambda spark, d: smoothed_baseline(t.event_points(spark, d)),
    "peaks_sd": event_arrays(picked_by("sd")),
    "peaks_mad": event_arrays(picked_by("mad")),
    "peaks_quantile": event_arrays(picked_by("quantile")),
    "peaks_diff": event_arrays(picked_by("diff")),
    "peaks_relheight": lines(lambda p: peak_list(peaks.pick(p, 3, None, relheight=0.8))),
    "peaks_prominence": events(peaks_prominence),
    "peaks_area": events(peaks_area),
    "peaks_pick_prominence": events(lambda p: peak_list(peaks.pick(p, 5, 2.0, "sd", relheight=0.5, prominence=20.0))),
    "peaks_noise_curve": events(lambda p: peak_list(peaks.pick(p, 5, 2.0, "sd", nbins=4, overlap=0.5))),
    "peaks_origin": event_arrays(peaks_origin),
    "align_resolution": line_arrays(lambda p: align.resolution(p).select("spectrum_id", rounded("resolution", 9), rounded("low"), rounded("high"))),
    "align_domain": stored_lines(align_domain),
    "align_bins": stored_lines(align_bins),
    "align_merge": stored_lines(align_merge),
    "align_down": stored_lines(align_down),
    "align_up": event_arrays(on_axis("up")),
    "align_auto": stored_lines(on_axis("auto")),
    "align_dense": stored_lines(align_dense),
    "align_shared_axis": lambda s, d: align_shared_axis(t.shifted_spectra(s, d)),
    "pipeline_aligned": stored_lines(aligned_pipeline),
    "infer_type": embeddings(lambda p: summary.infer_type(p).select("spectra", rounded("score", 4), "spectrum_type")),
    "type_scores": events(summary.type_scores),
    "mask": lambda s, d: summary.mask(t.embedding_spectra(s, d)),
    "dense_mask": dense,
    "dedup_summary": dedup,
    "ion_image": ion_image,
    "before_after_metrics": events(metrics),
    "plot_frame": events(lambda p: summary.plot_frame(p, 200.0, 400.0).select("spectrum_id", "i", rounded("intensity"), rounded("y_limit"))),
    "pipeline_full": event_arrays(lambda s: array_peaks(full_plan(s))),
    "pipeline_full_points": events(lambda p: peak_list(full_plan(p))),
    "peaks_sd_points": events(peaks_of("sd")),
    "peaks_quantile_points": events(peaks_of("quantile")),
}
