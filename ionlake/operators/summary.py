"""Spectrum types, statistics, masks, duplicates and before/after metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import noise
from .layout import in_order, finite

EPS = 2.220446049250313e-16


def type_scores(points: DataFrame) -> DataFrame:
    """(spectrum_id, score): above 0 speaks for a profile spectrum; spectra that say nothing are left out."""
    p = points.where(finite(F.col("mz")) & finite(F.col("intensity"))).withColumn("a", F.abs("intensity"))
    top = p.groupBy("spectrum_id").agg(F.max("a").alias("top"), F.count(F.lit(1)).alias("m"))
    p = p.join(top, "spectrum_id")
    a, before, after = F.col("a"), F.lag("a").over(in_order()), F.lead("a").over(in_order())
    p = p.withColumn("big", a > F.greatest(F.col("top") * 1e-6, F.lit(EPS)))
    peak = F.col("big") & F.when(before.isNull(), a > after).when(after.isNull(), a > before).otherwise((a >= before) & (a > after))
    step = F.col("mz") - F.lag("mz").over(in_order())
    p = p.withColumn("peak", F.coalesce(peak, F.lit(False))).withColumn("step", F.when(step > 0, step))
    g = p.groupBy("spectrum_id", "m", "top").agg(F.count_if("big").alias("big"), F.count_if("peak").alias("peaks"), (F.stddev_pop("step") / F.avg("step")).alias("cv"))
    each = F.col("big") / F.greatest(F.col("peaks"), F.lit(1))
    share = F.col("big") / F.col("m")
    cv = F.coalesce("cv", F.lit(float("inf")))
    score = F.when(each >= 4, 3).when(each <= 2.5, -3).otherwise(0) + F.when(share >= 0.35, 1).when(share <= 0.10, -1).otherwise(0) + F.when(cv <= 0.25, 1).when(cv >= 0.60, -1).otherwise(0)
    g = g.withColumn("score", F.when(F.col("m") < 8, -2.0).otherwise(score.cast("double")))
    return g.where((F.col("m") < 8) | ((F.col("top") > 0) & (F.col("big") > 0))).select("spectrum_id", "score")


def infer_type(points: DataFrame, sample: list[int] | None = None) -> DataFrame:
    """One row (spectra, score, spectrum_type); ``sample`` restricts it to some spectra, default is all."""
    held = points if sample is None else points.where(F.col("spectrum_id").isin(sample))
    out = type_scores(held).agg(F.count(F.lit(1)).alias("spectra"), F.avg("score").alias("score"))
    return out.withColumn("spectrum_type", F.when(F.col("score") > 0, "profile").when(F.col("score").isNotNull(), "centroid"))


def resolve_type(profile: bool | None, centroid: bool | None) -> str | None:
    """From metadata flags: profile, centroid, or None where they must be inferred."""
    if (profile, centroid) in ((True, None), (None, True)):
        return "profile" if profile else "centroid"
    if (profile, centroid) in ((True, True), (None, None)):
        return None
    raise ValueError("profile and centroid flags are true or unset")


def statistics(points: DataFrame) -> DataFrame:
    """(spectrum_id, n, mz_min, mz_max, base_mz, base_intensity, tic)."""
    return points.groupBy("spectrum_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("mz").alias("mz_min"), F.max("mz").alias("mz_max"),
        F.min_by("mz", F.struct(-F.col("intensity"), "i")).alias("base_mz"), F.max("intensity").alias("base_intensity"), F.sum("intensity").alias("tic"),
    )


def mask(spectra: DataFrame) -> DataFrame:
    """(x, y) of the pixels that hold a spectrum."""
    return spectra.select("x", "y").distinct()


def dense_mask(spectra: DataFrame) -> DataFrame:
    """(x, y, occupied) of all pixels of the image's box, made from its occupied rows and columns' bounds."""
    box = spectra.agg(F.max("x").alias("w"), F.max("y").alias("h"))
    grid = box.select("w", F.explode(F.sequence(F.lit(1), "h")).alias("y")).select("y", F.explode(F.sequence(F.lit(1), "w")).alias("x"))
    return grid.join(mask(spectra).withColumn("occupied", F.lit(1)), ["x", "y"], "left").select("x", "y", F.coalesce("occupied", F.lit(0)).alias("occupied"))


def duplicates(spectra: DataFrame, *content: str) -> DataFrame:
    """One row (total, unique, duplicate): spectra whose content columns are equal count once."""
    keys = spectra.groupBy(*(F.sha2(F.to_json(F.struct(c)), 256).alias(c) for c in content)).agg(F.count(F.lit(1)).alias("n"))
    out = keys.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"))
    return out.select(F.coalesce("total", F.lit(0)).alias("total"), "unique", (F.coalesce("total", F.lit(0)) - F.col("unique")).alias("duplicate"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(spectrum_id, correlation, tic_ratio, snr_before, snr_after, snr_gain): points paired by position; correlation 0 where
    one side is flat."""
    a = before.select("spectrum_id", "i", F.col("intensity").alias("a"))
    b = after.select("spectrum_id", "i", F.col("intensity").alias("b"))
    g = a.join(b, ["spectrum_id", "i"]).groupBy("spectrum_id").agg(F.corr("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    flat = (F.col("sa") <= 1e-12) | (F.col("sb") <= 1e-12)
    g = g.join(noise.snr(before).select("spectrum_id", F.col("snr").alias("snr_before")), "spectrum_id").join(noise.snr(after).select("spectrum_id", F.col("snr").alias("snr_after")), "spectrum_id")
    gain = F.when(F.col("snr_before") <= 0, float("inf")).otherwise(F.col("snr_after") / F.col("snr_before"))
    return g.select("spectrum_id", F.when(flat, 0.0).otherwise(F.col("r")).alias("correlation"), F.when(F.abs("ta") <= 1e-12, 1.0).otherwise(F.col("tb") / F.col("ta")).alias("tic_ratio"), "snr_before", "snr_after", gain.alias("snr_gain"))


def ion_image(points: DataFrame, pixels: DataFrame, mz: float, tolerance: float) -> DataFrame:
    """(x, y, intensity): the summed intensity within tolerance of an m/z at every pixel that has any."""
    near = points.where(F.col("mz").between(mz - tolerance, mz + tolerance)).groupBy("spectrum_id").agg(F.sum("intensity").alias("intensity"))
    return near.join(pixels.select("spectrum_id", "x", "y"), "spectrum_id").groupBy("x", "y").agg(F.sum("intensity").alias("intensity"))


def plot_frame(points: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Points of a plot with the vertical limit of their spectrum: 1.05 times its maximum, at least 1."""
    from .layout import per_spectrum

    shown = points if low is None else points.where(F.col("mz").between(low, high))
    return shown.withColumn("y_limit", F.greatest(F.max("intensity").over(per_spectrum()) * 1.05, F.lit(1.0)))
