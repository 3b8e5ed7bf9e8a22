import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.functions import kernels, spectrum_udfs
from ionlake.operators import align, baseline, layout, noise, normalize, peaks, select, smooth, summary
from ionlake.plans.pipeline import Pipeline

SPECTRA = {
    1: [0.0, 1, 3, 3, 1, 0, 2, 0],
    2: [5.0] * 12,
    3: [7.0],
    4: [2.0, 1.0],
    5: [0.0] * 9,
    6: [float(v) for v in random.Random(4).choices(range(20), k=40)],
}


def frame(spark, spectra=SPECTRA, parts=3):
    rows = [(s, i, len(x), 100.0 + i * 0.5, float(v)) for s, x in spectra.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "spectrum_id long, i int, n int, mz double, intensity double").repartition(parts)


def back(df, value="intensity"):
    out = {}
    for r in df.orderBy("spectrum_id", "i").collect():
        out.setdefault(r["spectrum_id"], []).append(r[value])
    return out


def test_layout_round_trip(spark):
    points = frame(spark)
    assert back(layout.explode_points(layout.nest_points(points))) == back(points)


def test_moving_average_and_gaussian_keep_constants(spark):
    for got in (smooth.moving_average(frame(spark), 4), smooth.gaussian(frame(spark), 5), smooth.savgol(frame(spark), 5, 2)):
        assert np.allclose(back(got)[2], 5.0)


def test_moving_average_against_padding(spark):
    got = back(smooth.moving_average(frame(spark), 5))
    for s, x in SPECTRA.items():
        assert np.allclose(got[s], np.convolve(np.pad(x, 2, mode="edge"), np.ones(5) / 5, "valid"))


def test_savgol_reproduces_a_cubic(spark):
    x = [2 - t + 0.5 * t**2 - 0.1 * t**3 for t in range(15)]
    assert np.allclose(back(smooth.savgol(frame(spark, {1: x}), 7, 3))[1], x)


def test_normalization_invariants(spark):
    got = back(normalize.normalize(frame(spark), "tic", scale=10.0))
    for s, x in SPECTRA.items():
        assert math.isclose(sum(got[s]), 10.0) if sum(x) > 0 else got[s] == [0.0] * len(x)
    rms = back(normalize.normalize(frame(spark), "rms", scale=3.0))
    assert math.isclose(math.sqrt(sum(v * v for v in rms[6]) / 40), 3.0)
    ref = back(normalize.normalize(frame(spark), "ref", ref=100.25, ref_tolerance=0.3))
    assert ref[2] == [1.0] * 12 and ref[1] == [0.0] * 8  # a tie takes the lower m/z
    with pytest.raises(Exception, match="not positive"):
        normalize.normalize(frame(spark), "tic", strict=True).collect()
    with pytest.raises(ValueError):
        normalize.normalize(frame(spark), "max")


def test_noise_floor_and_methods(spark):
    for m in noise.METHODS:
        got = {r["spectrum_id"]: r["noise"] for r in noise.noise(frame(spark), m).collect()}
        assert got[5] == 0.001 and (m == "diff" or got[3] == 0.001) and got[6] > 0.1
    with pytest.raises(ValueError):
        noise.noise(frame(spark), "max")


def test_snip_windows_agree_with_kernel(spark):
    got = back(baseline.snip(frame(spark), 5), "baseline")
    for s, x in SPECTRA.items():
        assert np.allclose(got[s], kernels.snip(np.array(x), 5))


def test_snip_udf_agrees_with_windows(spark):
    held = layout.nest_points(frame(spark)).withColumn("b", spectrum_udfs.snip(F.col("intensity"), 5))
    got = {r["spectrum_id"]: r["b"] for r in held.collect()}
    want = back(baseline.snip(frame(spark), 5), "baseline")
    assert all(np.allclose(got[s], want[s]) for s in SPECTRA)


def test_locmin_touches_its_anchors(spark):
    got = back(baseline.locmin(frame(spark), 3), "baseline")
    assert got[1][0] == 0 and got[1][5] == 0 and got[1][7] == 0
    assert got[4] == [1.0, 1.0] and got[3] == [7.0]


def test_plateau_peak_keeps_its_first_sample_and_right_edges_differ(spark):
    found = [r["i"] for r in peaks.pick(frame(spark), 3, None).where("spectrum_id = 1").orderBy("i").collect()]
    assert found == [2, 6]
    assert peaks.pick(frame(spark), 5, None).where("spectrum_id in (2, 3, 4, 5)").count() == 0


def test_crop_sort_and_slice(spark):
    got = select.crop_mz(frame(spark), 100.5, 101.5)
    assert {(r["spectrum_id"], r["n"]) for r in got.collect()} >= {(1, 3), (4, 1)}
    mixed = frame(spark, {1: [1.0, 2, 3]}).withColumn("mz", -F.col("mz"))
    assert not select.is_sorted(mixed).first()["is_sorted"]
    assert select.is_sorted(select.sort_by_mz(mixed)).first()["is_sorted"]
    with pytest.raises(ValueError):
        select.crop_mz(mixed, 2, 1)


def test_upsert_keeps_place_and_takes_last(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1, "a"), (1, 2, 1, 1, "b"), (2, 1, 1, 1, "c")], "spectrum_id long, x int, y int, z int, payload string")
    assert sorted((r["spectrum_id"], r["payload"]) for r in select.upsert(rows).collect()) == [(0, "c"), (1, "b")]


def test_merge_splits_at_valleys_and_gaps(spark):
    rows = [(i, m, c) for i, (m, c) in enumerate(zip([100.0, 100.1, 100.2, 100.3, 100.4, 105.0], [1, 3, 2, 4, 1, 2], strict=True))]
    grid = align.Domain(100.0, 110.0, 0.1, 0.2, False)
    got = align.merge(spark.createDataFrame(rows, "bin long, mz double, count long"), grid).orderBy("peak").collect()
    assert [r["count"] for r in got] == [6, 5, 2]


def test_reference_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    spectra = {s: [rng.random() for _ in range(20)] for s in range(12)}
    one, many = (align.reference(frame(spark, spectra, p))[0].orderBy("peak").collect() for p in (1, 7))
    assert [(a["peak"], round(a["mz"], 9), a["count"]) for a in one] == [(b["peak"], round(b["mz"], 9), b["count"]) for b in many]


def test_alignment_by_join_agrees_with_kernel(spark):
    rng = random.Random(7)
    spectra = {s: [rng.random() + 0.1 for _ in range(30)] for s in range(5)}
    points = frame(spark, spectra).withColumn("mz", F.col("mz") + F.col("spectrum_id") * 1e-4)
    axis, grid = align.reference(points)
    refs = [r["mz"] for r in axis.orderBy("peak").collect()]
    joined = {(r["spectrum_id"], r["peak"]): r["intensity"] for r in align.align_down(points, axis, grid).collect()}
    for r in align.align(points, refs, grid.tolerance).collect():
        for k, v in enumerate(r["aligned"]):
            assert v == joined.get((r["spectrum_id"], k), 0.0)


def test_types(spark):
    smooth_curve = {1: [100 * math.exp(-(((t - 50) / 20) ** 2)) + 1 for t in range(100)]}
    assert summary.infer_type(frame(spark, smooth_curve)).first()["spectrum_type"] == "profile"
    assert summary.resolve_type(True, None) == "profile" and summary.resolve_type(None, None) is None
    with pytest.raises(ValueError):
        summary.resolve_type(False, True)


def test_padded_matrix(spark):
    rows = {r["spectrum_id"]: r for r in layout.padded(frame(spark)).collect()}
    assert {k: r["n"] for k, r in rows.items()} == {k: len(x) for k, x in SPECTRA.items()}
    assert all(r["intensity"] == [*SPECTRA[k], *[0.0] * (40 - len(SPECTRA[k]))] and len(r["mz"]) == 40 for k, r in rows.items())
    assert layout.padded(frame(spark).where("false")).collect() == []
    with pytest.raises(Exception, match="longer than the width"):
        layout.padded(frame(spark), 12).collect()


def test_plan_order_pruning_and_shuffles(spark):
    p = Pipeline(frame(spark)).peak_pick().normalization("tic").baseline_correction("snip", m=3).noise_reduction("gaussian")
    assert [s.kind for s in p.plan()] == ["baseline", "noise", "normalization", "picking"] and p.output_type() == "centroid"
    assert p.start()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    with pytest.warns(UserWarning):
        assert [s.kind for s in Pipeline(frame(spark), "centroid").peak_pick().normalization().plan()] == ["normalization"]
    with pytest.raises(ValueError):
        Pipeline(frame(spark)).noise_reduction("magic")


def test_binned_noise_covers_the_spectrum(spark):
    got = noise.binned_noise(frame(spark), 4).where("spectrum_id = 6").orderBy("b").collect()
    assert [r["mid"] for r in got] == [4.5, 14.5, 24.5, 34.5]


def _points(spark, spectra):
    """Points of {id: [(mz, intensity), ...]}."""
    rows = [(k, i, len(v), float(m), float(x)) for k, v in spectra.items() for i, (m, x) in enumerate(v)]
    return spark.createDataFrame(rows, "spectrum_id long, i int, n int, mz double, intensity double")


def test_alignment_mode_is_chosen_for_each_spectrum(spark):
    axis = [100.0 + k for k in range(10)]
    few = [(103.2, 5.0)]  # up: spreads over the references within the tolerance
    many = [(100.0 + k, 1.0 + k) for k in range(6)]  # down
    got = align.on_axis(_points(spark, {1: few, 2: many}), axis, 0.02).collect()
    by = {k: {r["peak"]: r["intensity"] for r in got if r["spectrum_id"] == k} for k in (1, 2)}
    assert by[1] == {2: 5.0, 3: 5.0, 4: 5.0, 5: 5.0}
    assert by[2] == {k: 1.0 + min(k, 5) for k in range(6 + 2)}
    down = align.on_axis(_points(spark, {1: few}), axis, 0.02, mode="down").collect()
    assert {r["peak"] for r in down} == {2, 3, 4, 5}
    with pytest.raises(ValueError):
        align.on_axis(_points(spark, {1: few}), axis, 0.02, mode="sideways")
    dense = {r["spectrum_id"]: r["aligned"] for r in align.dense(align.on_axis(_points(spark, {1: few}), axis, 0.005), 10).collect()}
    assert dense == {1: [0.0, 0.0, 0.0, 5.0, *[0.0] * 6]}


def test_arrays_align_as_points_do_without_a_shuffle(spark):
    points = _points(spark, {k: [(100 + 7.1 * j + 0.001 * k, j + k) for j in range(20)] for k in range(9)})
    axis, grid = align.reference(points)
    flat = align.on_axis(points, axis, grid.tolerance)
    spectra = spark.createDataFrame(layout.nest_points(points).toArrow())
    nested = align.on_axis(spectra, axis, grid.tolerance)
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, nested.collect())) and flat.count()
    assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()


def test_the_median_of_resolutions_is_exact(spark):
    for values in ([3.0, 1.0, 2.0], [4.0, 1.0, 2.0, 2.0], [5.0] * 7, [1.0]):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        assert align._median(frame) == sorted(values)[(len(values) - 1) // 2] / 2 + sorted(values)[len(values) // 2] / 2
    assert align._median(spark.createDataFrame([], "v double")) is None


def test_noise_leaves_out_samples_that_are_not_finite(spark):
    import random

    rng = random.Random(3)
    clean = [(float(k), rng.random() * 10) for k in range(60)]
    broken = [*clean[:30], (30.0, float("nan")), *[(m + 1, x) for m, x in clean[30:]]]
    for method in noise.METHODS:
        got = {r["spectrum_id"]: r["noise"] for r in noise.noise(_points(spark, {1: clean, 2: broken}), method).collect()}
        assert got[1] > 0.1 and abs(got[1] - got[2]) < 0.35 * got[1], method


def test_picking_by_prominence_area_and_noise_curve(spark):
    x = [0, 1, 5, 1, 4.5, 1, 0, 9, 0, 0, 2, 0, 0]
    points = _points(spark, {1: [(10.0 + k, v) for k, v in enumerate(x)]})
    pick = lambda **how: {r["i"]: r["intensity"] for r in peaks.pick(points, 3, None, **how).collect()}
    assert pick() == {2: 5.0, 4: 4.5, 7: 9.0, 10: 2.0}
    assert set(pick(prominence=4.0)) == {2, 7} and set(pick(prominence=4.0, relheight=0.6)) == {7}
    assert pick(return_type="area")[7] == 9.0
    with pytest.raises(ValueError):
        pick(return_type="width")
    curve = {r["i"]: r["noise"] for r in noise.with_noise_curve(points, "sd", 4, 0.5).collect()}
    assert len(curve) == len(x) and min(curve.values()) >= noise.FLOOR
    assert set(peaks.pick(points, 3, 1.0, nbins=3).columns) == {"spectrum_id", "i", "mz", "intensity"}


@pytest.mark.parametrize("method", ["ma", "gaussian", "savgol", "wavelet", "gaussian_ns", "bi_ns"])
def test_the_plan_reaches_every_smoother(spark, method):
    points = _points(spark, {k: [(100.0 + j, (j * 7 + k) % 11) for j in range(30)] for k in range(3)})
    out = Pipeline(points).noise_reduction(method).start()
    assert out.count() == 90 and out.columns == ["spectrum_id", "i", "n", "mz", "intensity"]


@pytest.mark.parametrize("how", [{"method": "locmin"}, {"method": "locmin", "smooth": "lowess", "span": 0.3}, {"method": "snip"}, {"method": "snip", "m": 4}, {"method": "asls", "lam": 1e3}])
def test_the_plan_reaches_every_baseline(spark, how):
    points = _points(spark, {k: [(100.0 + j, 5 + (j * 7 + k) % 11) for j in range(30)] for k in range(3)})
    out = Pipeline(points).baseline_correction(**how).start()
    assert out.count() == 90 and out.where("intensity < 0").count() == 0 and out.columns == ["spectrum_id", "i", "n", "mz", "intensity"]


def test_the_plan_aligns_to_a_given_axis(spark):
    points = _points(spark, {1: [(100.0, 1.0), (200.0, 2.0)], 2: [(100.01, 3.0)]})
    out = Pipeline(points, "centroid").peak_align(reference=[200.0, 100.0], tolerance=200.0).start().collect()
    assert sorted(map(tuple, out)) == [(1, 0, 100.0, 1.0), (1, 1, 200.0, 2.0), (2, 0, 100.0, 3.0)]
    with pytest.raises(ValueError):
        Pipeline(points).peak_align(reference=[1.0])
