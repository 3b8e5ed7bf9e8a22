import os
import random

import pytest
from pyspark.sql import functions as F

from ionlake.sources import tiles


@pytest.fixture(scope="module")
def image(spark, tmp_path_factory):
    """100 by 60 pixels, some missing, some repeated."""
    rng = random.Random(2)
    rows = [(x, y, 1, [float(x), float(y)]) for x in range(1, 101) for y in range(1, 61) if rng.random() < 0.95]
    rows += [rows[5]] * 3
    path = str(tmp_path_factory.mktemp("tiles") / "image")
    tiles.write_tiles(spark.createDataFrame(rows, "x int, y int, z int, intensity array<double>"), path, 16)
    return path, rows


def files(df):
    """Files that the scan reads, after pruning."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    return int(plan.toString().count("Scan parquet")), {f for f in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}


def test_windows_read_few_files_and_all_their_pixels(spark, image):
    path, rows = image
    everything = tiles.read_tiles(spark, path)
    assert everything.count() == len(rows) and everything.columns == ["x", "y", "z", "intensity"]
    folders = [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(folders) >= 28
    for window in ((1, 1, 16, 16), (30, 20, 41, 33), (100, 60, 100, 60), (90, 1, 300, 8)):
        df = tiles.read_tiles(spark, path, window, 16)
        x1, y1, x2, y2 = window
        want = sorted((x, y) for x, y, *_ in rows if x1 <= x <= x2 and y1 <= y <= y2)
        assert sorted((r["x"], r["y"]) for r in df.collect()) == want
        _, read = files(df)
        met = {((x - 1) // 16, (y - 1) // 16) for x, y in want}
        assert {f.split("/tile_x=")[1].rpartition("/")[0] for f in read} == {f"{a}/tile_y={b}" for a, b in met}
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(tile_x" in plan and "PushedFilters: [IsNotNull(x)" in plan
    assert [r["intensity"] for r in tiles.read_pixel(spark, path, *rows[5][:2], 16).collect()] == [rows[5][3]] * 4
    with pytest.raises(ValueError):
        tiles.read_tiles(spark, path, (5, 1, 4, 1), 16)


def test_the_curve_interleaves_bits(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (5, 9), (2**31 - 1, 2**30 + 3), (77, 2**31 - 1)]
    df = spark.createDataFrame(pairs, "x int, y int").select("x", "y", tiles.curve(F.col("x"), F.col("y")).alias("z"))
    for x, y, z in df.collect():
        assert z == sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(31))
