"""Spectra as arrays: fused plans, alignment in one pass, the scan over the axis, shared axes, dense blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.functions import kernels, ragged
from ionlake.operators import align, baseline, layout, peaks, shared_axis
from ionlake.plans.pipeline import Pipeline, fused

NAN, INF = math.nan, math.inf


def spectra_of(seed=1, odd=True):
    rng = random.Random(seed)
    out = {}
    for s in range(40):
        n = rng.choice([1, 2, 3, 5, 9, 30, 70])
        mz = sorted(rng.uniform(100, 160) for _ in range(n))
        out[s] = (mz, [float(rng.choice([0, 1, 1, 2, 5, rng.uniform(0, 50)])) for _ in range(n)])
    if odd:
        out[100] = ([], [])
        out[101] = ([100.0 + k for k in range(12)], [0.0] * 12)
        out[102] = ([100.0 + k for k in range(12)], [1.0, NAN, 3.0, INF, 2.0, 1.0, 0.0, 4.0, -INF, 2.0, 2.0, 1.0])
        out[103] = ([100.0, 100.0, 101.0, 103.0], [1.0, 2.0, 2.0, 1.0])
    return out


def frames(spark, spectra):
    """The same spectra as arrays (with another column) and as points."""
    rows = [(s, m, x, f"p{s}") for s, (m, x) in spectra.items()]
    arrays = spark.createDataFrame(rows, "spectrum_id long, mz array<double>, intensity array<double>, pixel string").repartition(3)
    return arrays, layout.explode_points(arrays)


def same(arrays, points, digits=9):
    got = {(r["spectrum_id"], k): v for r in arrays.collect() for k, v in enumerate(r["intensity"])}
    want = {(r["spectrum_id"], r["i"]): r["intensity"] for r in points.collect()}
    assert got.keys() == want.keys() and len(got) > 0
    for k, v in got.items():
        assert (v is None or math.isnan(v)) == (want[k] is None or math.isnan(want[k])) and (not math.isfinite(v) or math.isclose(v, want[k], rel_tol=1e-9, abs_tol=10.0**-digits)), k


STEPS = {
    "locmin": lambda p: p.baseline_correction("locmin", width=5, scale=0.8),
    "locmin7": lambda p: p.baseline_correction("locmin", width=7),
    "snip": lambda p: p.baseline_correction("snip", m=3),
    "snip up": lambda p: p.baseline_correction("snip", m=4, decreasing=False),
    "snip auto": lambda p: p.baseline_correction("snip"),
    "asls": lambda p: p.baseline_correction("asls", lam=50.0),
    "lowess": lambda p: p.baseline_correction("locmin", smooth="lowess", span=0.4),
    "lowess mz": lambda p: p.baseline_correction("locmin", smooth="lowess", span=0.4, over="mz"),
    "spline": lambda p: p.baseline_correction("locmin", smooth="spline", knots=4),
    "ma": lambda p: p.noise_reduction("ma", window=4),
    "coef": lambda p: p.noise_reduction("ma", coef=[1.0, 2.0, 4.0]),
    "gaussian": lambda p: p.noise_reduction("gaussian", window=7, sd=1.2),
    "savgol": lambda p: p.noise_reduction("savgol", window=5),
    "savgol slope": lambda p: p.noise_reduction("savgol", window=7, polyorder=2, deriv=1, delta=0.5),
    "wavelet": lambda p: p.noise_reduction("wavelet"),
    "gaussian_ns": lambda p: p.noise_reduction("gaussian_ns", window=5, sd=0.7),
    "bi_ns": lambda p: p.noise_reduction("bi_ns", window=5, sd=0.7),
    "bi_ns tall": lambda p: p.noise_reduction("bi_ns", window=4, sd=0.7, sd_intensity=3.0),
    "tic": lambda p: p.normalization("tic"),
    "rms": lambda p: p.normalization("rms", scale=3.0),
    "median": lambda p: p.normalization("median"),
    "ref": lambda p: p.normalization("ref", ref=120.0, ref_tolerance=5.0),
}


@pytest.mark.parametrize("name", STEPS)
def test_arrays_and_points_agree(spark, name):
    arrays, points = frames(spark, spectra_of(2, odd=name not in ("asls", "wavelet", "gaussian_ns", "bi_ns", "bi_ns tall", "lowess", "lowess mz", "spline", "savgol", "savgol slope")))
    if name in ("ma", "coef", "gaussian", "snip", "snip up", "snip auto"):
        arrays, points = arrays.where("spectrum_id <> 102"), points.where("spectrum_id <> 102")  # windows and numpy sum infinities in other orders
    same(STEPS[name](Pipeline(arrays)).start(), STEPS[name](Pipeline(points)).start())


PICKS = [
    {"snr": None}, {"width": 3, "snr": None, "relheight": 0.4}, {"noise": "sd"}, {"noise": "mad", "snr": 1.0}, {"snr": 1.5}, {"noise": "diff", "snr": 0.5}, {"width": 7, "noise": "sd", "prominence": 2.0},
    {"noise": "sd", "return_type": "area"}, {"noise": "sd", "nbins": 3, "overlap": 0.5}, {"width": 3, "noise": "sd", "snr": 1.0, "prominence": 1.0, "relheight": 0.1, "return_type": "area"},
]


@pytest.mark.parametrize("how", PICKS)
def test_picking_agrees(spark, how):
    arrays, points = frames(spark, spectra_of(3))
    if "prominence" in how or "return_type" in how:  # of samples that are not finite, neither is defined
        arrays, points = arrays.where("spectrum_id <> 102"), points.where("spectrum_id <> 102")
    got = Pipeline(arrays).peak_pick(**how).start()
    assert got.columns == [*arrays.columns, "i"]
    have = sorted((r["spectrum_id"], i, round(m, 9), round(x, 9)) for r in got.collect() for i, m, x in zip(r["i"], r["mz"], r["intensity"], strict=True))
    want = sorted((r["spectrum_id"], r["i"], round(r["mz"], 9), round(r["intensity"], 9)) for r in Pipeline(points).peak_pick(**how).start().collect())
    assert have == want and len(have) > 5


def test_driver_tables_agree_in_both_forms(spark):
    from ionlake.sources import tables as t

    d = "/root/testdata/sf0.001"
    whole = lambda p: p.baseline_correction("locmin", width=5).noise_reduction("savgol", window=7).normalization("rms")
    for arrays, points in ((t.event_spectra, t.event_points), (t.lineitem_spectra, t.lineitem_points), (t.shifted_spectra, t.embedding_points)):
        same(whole(Pipeline(arrays(spark, d).select("spectrum_id", "mz", "intensity"))).start(), whole(Pipeline(points(spark, d))).start())


def test_a_chain_over_arrays_has_no_shuffle_and_one_pass(spark, tmp_path):
    arrays, _ = frames(spark, spectra_of(4))
    arrays.write.parquet(f"{tmp_path}/s")
    df = Pipeline(spark.read.parquet(f"{tmp_path}/s")).baseline_correction("locmin").noise_reduction("gaussian").normalization("tic").peak_pick(noise="sd").start()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1
    assert {r["pixel"] for r in df.select("pixel").collect()} == {f"p{s}" for s in spectra_of(4)}


def test_custom_steps_part_the_fused_ones(spark):
    arrays, _ = frames(spark, spectra_of(5))
    twice = lambda df: df.withColumn("intensity", F.transform("intensity", lambda v: 2 * v))
    df = Pipeline(arrays).normalization("tic", scale=1.0).apply(twice).peak_pick(snr=None).start()
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert Pipeline(arrays, "centroid").normalization("tic").start().columns == arrays.columns


def test_arrays_of_unequal_length_raise_and_null_ones_are_empty(spark):
    bad = spark.createDataFrame([(1, [1.0, 2.0], [1.0])], "spectrum_id long, mz array<double>, intensity array<double>")
    with pytest.raises(Exception, match="differ in length"):
        Pipeline(bad).normalization("tic").start().collect()
    none = spark.createDataFrame([(1, None, None), (2, [1.0, 2.0], [1.0, None])], "spectrum_id long, mz array<double>, intensity array<float>")
    got = {r["spectrum_id"]: r["intensity"] for r in Pipeline(none).normalization("median").start().collect()}
    assert got[1] == [] and len(got[2]) == 2
    assert Pipeline(none.where("false")).baseline_correction().peak_pick().start().count() == 0
    with pytest.raises(ValueError):
        Pipeline(none.drop("mz"))
    with pytest.raises(ValueError):
        Pipeline(none.withColumn("mz", F.lit(1.0)))


def test_what_needs_arrays_says_so(spark):
    arrays, points = frames(spark, spectra_of(6, odd=False))
    for how in ({"method": "shape", "noise": "sd"}, {"bins": "dynamic", "nbins": 4, "snr": 1.0}):
        assert Pipeline(arrays).peak_pick(**how).start().select(F.explode("i")).count() > 0
        with pytest.raises(ValueError, match="arrays"):
            Pipeline(points).peak_pick(**how).start()
    for wrong in ({"method": "max"}, {"bins": "some"}, {"noise": "max"}, {"width": 0}):
        with pytest.raises(ValueError):
            Pipeline(arrays).peak_pick(**wrong)


def test_shape_picking_gives_the_kernels_peaks(spark):
    held = spectra_of(7, odd=False)
    got = {r["spectrum_id"]: list(zip(r["i"], r["intensity"], strict=True)) for r in Pipeline(frames(spark, held)[0]).peak_pick("shape", noise="sd", snr=1.0).start().collect()}
    for s, (mz, x) in held.items():
        m, x = np.array(mz), np.array(x)
        r = ragged.Ragged(m, x, np.array([0, len(x)]))
        at, size = kernels.origin_peaks(m, x, float(ragged.noise(r, "sd")[0]), snr=1.0)
        assert [i for i, _ in got[s]] == at.tolist() and np.allclose([v for _, v in got[s]], size)


def test_slices_of_points_do_not_change_results(spark, monkeypatch):
    held = list(spectra_of(8).values())
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([m for m, _ in held], pa.list_(pa.float64())), pa.array([x for _, x in held], pa.list_(pa.float64()))], ["mz", "intensity"])
    monkeypatch.setattr(ragged, "SLICE_POINTS", 25)
    parts = list(ragged.ragged_slices(batch))
    assert len(parts) > 5 and sum(p.num_rows for p, _ in parts) == len(held)
    assert np.array_equal(np.concatenate([r.x for _, r in parts]), np.concatenate([x for _, x in held]), equal_nan=True)


def test_natural_spline():
    y = np.array([2.0, 4, 6, 8, 10, 12, 14])
    assert np.allclose(kernels.natural_spline(y, 2), y)  # a line stays a line
    wave = np.sin(np.arange(40) / 5)
    smooth = kernels.natural_spline(wave, 4)
    assert np.allclose(smooth[::4], wave[::4]) and np.abs(smooth - wave).max() < 0.02
    bend = np.diff(kernels.natural_spline(np.random.default_rng(1).normal(size=41), 10), 2)
    assert abs(bend[0]) < abs(bend).max() * 0.2  # no curvature at the ends, about
    assert kernels.natural_spline(np.array([3.0]), 2).tolist() == [3.0] and len(kernels.natural_spline(np.zeros(0))) == 0
    with pytest.raises(ValueError):
        kernels.natural_spline(y, 0)


# alignment


def ragged_of(rows):
    return ragged.Ragged(np.concatenate([np.array(m, dtype=float) for m, _ in rows]), np.concatenate([np.array(x, dtype=float) for _, x in rows]), np.r_[0, np.cumsum([len(m) for m, _ in rows])])


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("fill", [False, True])
def test_matches_of_a_batch_are_those_of_each_spectrum(seed, fill):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        n = rng.choice([0, 1, 2, 5, 20, 60])
        mz = sorted(rng.choice([rng.uniform(100, 104), round(rng.uniform(100, 104), 1)]) for _ in range(n))
        rows.append((mz, [rng.random() for _ in range(n)]))
    axis = np.unique([round(rng.uniform(99.5, 104.5), rng.choice([1, 4])) for _ in range(rng.choice([1, 7, 40, 300]))])
    relative, tolerance = rng.choice([(True, 0.001), (True, 0.01), (False, 0.05), (False, 0.4), (True, 0.7)])
    for mode in ("auto", "down", "up"):
        row, peak, point = ragged.matches(ragged_of(rows), axis, tolerance, relative, mode, fill)
        x = ragged_of(rows).x
        for k, (mz, own) in enumerate(rows):
            at, values = kernels.matches(np.array(mz), np.array(own), axis, tolerance, relative, mode, fill)
            assert peak[row == k].tolist() == at.tolist() and x[point[row == k]].tolist() == values.tolist()


def merged_by_hand(rows, tolerance):
    out, last, falling = [], None, False
    for _, mz, count in sorted(rows):
        new = last is None or mz - last[0] > tolerance
        if not new and count > last[1] and falling:
            new = True
        falling = False if new else count < last[1] or (falling and count == last[1])
        if new:
            out.append([0.0, 0])
        out[-1][0] += mz * count
        out[-1][1] += count
        last = mz, count
    return [(k, round(t / n, 9), n) for k, (t, n) in enumerate(out)]


@pytest.mark.parametrize("seed", range(8))
def test_the_scan_over_ranges_is_the_scan_over_all(spark, seed):
    rng = random.Random(seed)
    rows = [(k, 100 + k * 0.1 + rng.choice([0, 0.03]), rng.choice([1, 1, 2, 3, 5])) for k in range(120) if rng.random() < [0.95, 0.6][seed % 2]]
    grid = align.Domain(100.0, 111.9, 0.1, [0.15, 0.25][seed // 4], False)
    binned = spark.createDataFrame(rows, "bin long, mz double, count long").repartition(3)
    want = merged_by_hand(rows, grid.tolerance)
    for parts in (1, 2, 7, 40, 200):
        got = sorted((r["peak"], round(r["mz"], 9), r["count"]) for r in align.merge(binned, grid, parts).collect())
        assert got == want, parts


def test_no_window_of_merge_runs_over_the_whole_axis(spark):
    binned = spark.range(50).select(F.col("id").alias("bin"), (F.col("id") + 100.0).alias("mz"), F.lit(1).cast("long").alias("count"))
    plan = align.merge(binned, align.Domain(100.0, 150.0, 1.0, 0.5, False), 4)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    none = spark.createDataFrame([], "bin long, mz double, count long")
    assert align.merge(none, align.Domain(100.0, 150.0, 1.0, 0.5, False), 4).count() == 0


@pytest.mark.parametrize("block", [None, 1, 7, 4096])
def test_dense_blocks_hold_all_matches(spark, block):
    held = spectra_of(9, odd=False)
    axis = sorted({round(m, 1) for m, _ in held.values() for m in m})
    arrays, _ = frames(spark, held)
    sparse = {(r["spectrum_id"], r["peak"]): r["intensity"] for r in align.on_axis(arrays, axis, 0.0005).collect()}
    rows = align.dense_blocks(arrays, axis, 0.0005, block=block).collect()
    got = {(r["spectrum_id"], r["first"] + k): v for r in rows for k, v in enumerate(r["aligned"])}
    assert len(got) == len(held) * len(axis) and sum(len(r["aligned"]) for r in rows) == len(got)
    assert all(v == sparse.get(k, 0.0) for k, v in got.items()) and any(v for v in got.values())


def test_dense_work_goes_with_the_axis(spark):
    import time

    spectra = spark.createDataFrame([(1, [100 + k * 0.01 for k in range(8000)], [1.0] * 8000)], "spectrum_id long, mz array<double>, intensity array<double>")
    axis = [100 + k * 0.001 for k in range(80_000)]
    began = time.time()
    rows = align.dense_blocks(spectra, axis, 1e-6).collect()
    assert sum(len(r["aligned"]) for r in rows) == 80_000 and time.time() - began < 20


def test_shared_axes_give_what_each_spectrum_gives(spark):
    rng = random.Random(5)
    axes = [[100 + 0.5 * k + s for k in range(40)] for s in (0.0, 0.01, 0.02)] + [[]]
    rows = [(s, axes[a], [rng.random() for _ in axes[a]], f"p{s}") for s in range(60) for a in [rng.choice([0, 0, 0, 1, 2, 3])]] + [(99, None, [], "none")]
    arrays = spark.createDataFrame(rows, "spectrum_id long, mz array<double>, intensity array<double>, pixel string").repartition(4)
    held, ids = shared_axis.dictionary(arrays)
    assert ids.count() == 4 and "mz" not in held.columns
    back = {r["spectrum_id"]: (r["mz"], r["pixel"]) for r in shared_axis.attach(held, ids).collect()}
    assert back == {s: (m or [], p) for s, m, _, p in rows}
    for binfun in ("median", "min", "max", "mean"):
        assert shared_axis.domain(ids, shared_axis.weights(held), "ppm", binfun, 0.6) == pytest.approx(align.domain(arrays, "ppm", binfun, 0.6))
    axis, grid = shared_axis.reference(held, ids, binratio=0.6)
    plain, _ = align.reference(arrays, binratio=0.6)
    assert [(r["peak"], round(r["mz"], 9), r["count"]) for r in axis.orderBy("peak").collect()] == [(r["peak"], round(r["mz"], 9), r["count"]) for r in plain.orderBy("peak").collect()]
    got = {(r["spectrum_id"], p): v for r in shared_axis.on_axis(held, shared_axis.gather_index(ids, axis, grid.tolerance)).collect() for p, v in zip(r["peaks"], r["intensity"], strict=True)}
    assert got == {(r["spectrum_id"], r["peak"]): r["intensity"] for r in align.on_axis(arrays, plain, grid.tolerance).collect()} and len(got) > 500


def test_aligned_plan_over_arrays_and_points(spark):
    arrays, points = frames(spark, spectra_of(10))
    for how in ({}, {"reference": [110.0, 120.0, 130.5], "tolerance": 3000.0}, {"units": "mz", "reference": [105.0, 150.0], "tolerance": 0.8, "mode": "down"}):
        got = Pipeline(arrays).peak_pick(snr=None).peak_align(**how).start()
        have = sorted((r["spectrum_id"], i, round(m, 9), x) for r in got.collect() for i, m, x in zip(r["i"], r["mz"], r["intensity"], strict=True))
        want = sorted((r["spectrum_id"], r["i"], round(r["mz"], 9), r["intensity"]) for r in Pipeline(points).peak_pick(snr=None).peak_align(**how).start().collect())
        assert have == want and have


def test_default_parameters(spark):
    """Picking by the residual's quantile, smoothing by cubics."""
    _, points = frames(spark, spectra_of(11, odd=False))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(peaks.pick(points)) == rows(peaks.pick(points, 5, 2.0, "quantile"))
    arrays, _ = frames(spark, {1: ([100.0 + k for k in range(15)], [2 - t + 0.5 * t**2 - 0.1 * t**3 for t in range(15)])})
    got = Pipeline(arrays).noise_reduction("savgol", window=7).start().first()["intensity"]
    assert np.allclose(got, arrays.first()["intensity"])
    assert fused(arrays, [lambda r: r.with_x(ragged.locmin(r, 3))]).first()["intensity"] == [r["baseline"] for r in baseline.locmin(layout.explode_points(arrays), 3).orderBy("i").collect()]
