"""Spectra that arrive as a stream: row-wise operators on array columns run on it unchanged.

A spectrum is one row, so nothing here keeps state except the running summary by pixel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectrum_udfs

SPECTRA = "spectrum_id bigint, x int, y int, z int, mz array<double>, intensity array<double>"


def read_spectra(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(SPECTRA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tic(intensity: Column, scale: float | None = None) -> Column:
    """TIC normalization of an array, without a shuffle; all zeros where the sum is not positive."""
    total = F.aggregate(intensity, F.lit(0.0), lambda s, x: s + x)
    factor = F.size(intensity).cast("double") if scale is None else F.lit(float(scale))
    return F.transform(intensity, lambda x: F.when(total > 0, x * factor / total).otherwise(F.lit(0.0)))


def preprocess(spectra: DataFrame, m: int = 5) -> DataFrame:
    """Baseline removal and normalization of each arriving spectrum."""
    flat = F.zip_with("intensity", spectrum_udfs.snip(F.col("intensity"), m), lambda x, b: F.greatest(x - b, F.lit(0.0)))
    return spectra.withColumn("intensity", flat).withColumn("intensity", tic(F.col("intensity")))


def running_summary(spectra: DataFrame) -> DataFrame:
    """Spectra, points and ion current so far by image row; state is one record for each row of the image."""
    return spectra.groupBy("y").agg(F.count(F.lit(1)).alias("spectra"), F.sum(F.size("intensity")).alias("points"), F.sum(F.aggregate("intensity", F.lit(0.0), lambda s, x: s + x)).alias("current"))
