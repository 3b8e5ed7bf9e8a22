"""Tables read as spectra: one row a point (spectrum_id, i, n, mz, intensity), points in ascending m/z.

``events``: a user's values over time; ``embeddings``: a vector's magnitudes on one shared axis;
``lineitem``: a part's quantities over price.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import imzml

EVENT_ORDER, LINE_ORDER = ["ts", "event_id"], ["l_extendedprice", "l_orderkey", "l_linenumber"]
EVENT_MICROS = "unix_micros(cast(ts as timestamp)) - unix_micros(cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp))"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def number_points(rows: DataFrame, spectrum_id: Column, order: list[str], mz: Column, intensity: Column) -> DataFrame:
    """Points from one row each; the window's shuffle by spectrum serves all later per-spectrum windows."""
    keyed = rows.select(spectrum_id.alias("spectrum_id"), *order, mz.alias("mz"), intensity.cast("double").alias("intensity"))
    one = Window.partitionBy("spectrum_id")
    return keyed.select("spectrum_id", (F.row_number().over(one.orderBy(*order)) - 1).alias("i"), F.count(F.lit(1)).over(one).cast("int").alias("n"), "mz", "intensity")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_points(read(spark, sf_dir, "events"), F.col("user_id"), EVENT_ORDER, 100 + F.expr(EVENT_MICROS) / F.lit(1e9), F.col("value"))


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_points(read(spark, sf_dir, "lineitem"), F.col("l_partkey"), LINE_ORDER, 100 + F.col("l_extendedprice").cast("double") / 100, F.col("l_quantity"))


def _nested(rows: DataFrame, spectrum_id: Column, order: list[str], mz: Column, intensity: Column) -> DataFrame:
    """Spectra with arrays from one row a point: one shuffle, no window."""
    p = F.struct(*order, mz.alias("mz"), intensity.cast("double").alias("intensity"))
    held = rows.groupBy(spectrum_id.alias("spectrum_id")).agg(F.sort_array(F.collect_list(p)).alias("p"))
    return held.select("spectrum_id", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def event_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(read(spark, sf_dir, "events"), F.col("user_id"), EVENT_ORDER, 100 + F.expr(EVENT_MICROS) / F.lit(1e9), F.col("value"))


def lineitem_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(read(spark, sf_dir, "lineitem"), F.col("l_partkey"), LINE_ORDER, 100 + F.col("l_extendedprice").cast("double") / 100, F.col("l_quantity"))


def shifted_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra with arrays on three axes that lie 0.01 apart."""
    held = embedding_spectra(spark, sf_dir)
    shift = F.pmod("spectrum_id", F.lit(3)) * F.lit(0.01)
    return held.withColumn("mz", F.transform("intensity", lambda _, i: F.lit(100.0) + F.lit(0.5) * i + shift))


def embedding_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spectrum_id, x, y, z, intensity array): the axis is shared, see ``embedding_axis``."""
    vid = F.col("vec_id")
    magnitudes = F.transform(F.col("embedding"), lambda e: F.abs(e.cast("double")))
    return read(spark, sf_dir, "embeddings").select(vid.alias("spectrum_id"), (vid % 25 + 1).cast("int").alias("x"), (F.floor(vid / 25) + 1).cast("int").alias("y"), F.lit(1).alias("z"), magnitudes.alias("intensity"), F.col("label").alias("region"))


def embedding_axis() -> list[float]:
    return [100.0 + 0.5 * i for i in range(64)]


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = embedding_spectra(spark, sf_dir)
    return spectra.select("spectrum_id", F.size("intensity").alias("n"), F.posexplode("intensity").alias("i", "intensity")).select("spectrum_id", "i", "n", (F.lit(100.0) + F.lit(0.5) * F.col("i")).alias("mz"), "intensity")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or, where that is unset on a single machine, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/spectra-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table of its own: for what is read several times and costs a shuffle each time."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def as_imzml(spark: SparkSession, spectra: DataFrame, **options: str) -> str:
    """The folder that spectra (x, y, z, mz, intensity) have been written to as imzML."""
    imzml.register(spark)
    folder = scratch(spark)
    spectra.write.format("imzml").mode("append").options(**options).save(folder)
    return folder
