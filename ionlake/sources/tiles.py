"""Spectra of an image stored by tiles, so that a pixel or a window of pixels reads few files.

A tile is a square of pixels and a folder (columns tile_x, tile_y); within it spectra follow the Z-order curve, so that row groups
hold compact pieces of the tile. Windows are turned into ranges of tiles, which prune folders, and into filters
on x and y, which skip row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 64


def curve(x: Column, y: Column, bits: int = 31) -> Column:
    """The place on the Z-order curve: the bits of x and y in turn. Coordinates are not negative and below 2 ** bits."""
    # halves of halves: each step spreads the bits once more
    steps = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]

    def spread(v: Column) -> Column:
        v = v.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
        for k, mask in steps:
            v = v.bitwiseOR(F.shiftleft(v, k)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def _tile(c: str, tile: int) -> Column:
    return F.floor((F.col(c) - 1) / tile).cast("int")


def write_tiles(spectra: DataFrame, path: str, tile: int = TILE, mode: str = "errorifexists") -> None:
    """Write spectra (x and y from 1) by tiles. Tiles are dealt by ranges of the curve: a task writes neighbouring tiles, and a tile that
    holds very many rows (repeated pixels) is split among tasks."""
    if tile < 1:
        raise ValueError("tiles: a tile has one pixel at least")
    held = spectra.withColumn("tile_x", _tile("x", tile)).withColumn("tile_y", _tile("y", tile)).withColumn("_z", curve(F.col("x"), F.col("y")))
    ordered = held.repartitionByRange(curve(F.col("tile_x"), F.col("tile_y")), "_z").sortWithinPartitions("tile_x", "tile_y", "_z")
    ordered.drop("_z").write.mode(mode).partitionBy("tile_x", "tile_y").parquet(path)


def read_tiles(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, tile: int = TILE) -> DataFrame:
    """Spectra of a window (x1, y1, x2, y2, ends included), or all, from tiles of the given size."""
    held = spark.read.parquet(path)
    if window is not None:
        x1, y1, x2, y2 = window
        if x1 > x2 or y1 > y2:
            raise ValueError("tiles: corners must ascend")
        for c, a, b in (("x", x1, x2), ("y", y1, y2)):
            held = held.where(F.col(f"tile_{c}").between((a - 1) // tile, (b - 1) // tile) & F.col(c).between(a, b))
    return held.drop("tile_x", "tile_y")


def read_pixel(spark: SparkSession, path: str, x: int, y: int, tile: int = TILE) -> DataFrame:
    return read_tiles(spark, path, (x, y, x, y), tile)
