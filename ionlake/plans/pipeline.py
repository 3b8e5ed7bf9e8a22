"""A fluent plan of processing steps over spectra.

Steps are put in canonical order (baseline, noise, normalization, picking, alignment) whatever the order of
calls; centroid data skip what only profiles need. The result is one lazy DataFrame.

Spectra may come as arrays (one row a spectrum, columns mz and intensity, as the sources give them) or as points. Over
arrays, all steps before alignment are fused into one pass of each Arrow batch: no shuffle, nothing exploded, other
columns passed on. Over points, windows over spectra share one shuffle. Only alignment's scalars and axis come
between.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import ragged
from ..functions import spectrum_udfs as udfs
from ..operators import align as aligning
from ..operators import baseline, layout, normalize, peaks, smooth

RANKS = {"baseline": 10, "noise": 20, "normalization": 30, "custom": 35, "picking": 40, "alignment": 50}
PROFILE_ONLY = ("baseline", "noise", "picking")


def _snip(points: DataFrame, m: int | None = None, decreasing: bool = True) -> DataFrame:
    """A window a step for few steps, else the array form."""
    if m is not None and m <= 8:
        return baseline.snip(points, m, decreasing)
    return layout.through_arrays(points, lambda _, x: udfs.snip(x, m, decreasing), "baseline")


BASELINES = {
    "locmin": baseline.locmin,
    "snip": _snip,
    "asls": lambda p, **how: layout.through_arrays(p, lambda _, x: udfs.asls(x, **how), "baseline"),
}
SMOOTHERS = {
    "ma": smooth.moving_average,
    "gaussian": smooth.gaussian,
    "savgol": smooth.savgol,
    "wavelet": lambda p, **how: layout.through_arrays(p, lambda _, x: udfs.wavelet(x, **how)),
    "gaussian_ns": lambda p, **how: layout.through_arrays(p, lambda m, x: udfs.neighbour_smooth(m, x, **how)),
    "bi_ns": lambda p, **how: layout.through_arrays(p, lambda m, x: udfs.neighbour_smooth(m, x, bilateral=True, **how)),
}
#: The same over ragged batches.
RAGGED_SMOOTHERS: dict[str, Callable[..., ragged.Ragged]] = {
    "ma": ragged.moving_average,
    "gaussian": ragged.gaussian,
    "savgol": ragged.savgol,
    "wavelet": ragged.wavelet,
    "gaussian_ns": ragged.neighbour_smooth,
    "bi_ns": lambda r, **how: ragged.neighbour_smooth(r, bilateral=True, **how),
}


class Step(NamedTuple):
    kind: str
    points: Callable[[DataFrame], DataFrame] | None  # over points
    arrays: Callable[[ragged.Ragged], ragged.Ragged] | None  # over a ragged batch, spectrum by spectrum
    spectra: Callable[[DataFrame], DataFrame] | None = None  # over a DataFrame of arrays, where batches don't do


def fused(spectra: DataFrame, steps: list[Callable[[ragged.Ragged], ragged.Ragged]], places: bool = False) -> DataFrame:
    """Steps over spectra with arrays in one pass, batch by batch; all other columns stay. ``places`` adds ``i``, where the
    points that are left stood in their spectrum. Null arrays come out empty."""
    held = spectra.select(*(F.col(f"`{c}`").cast("array<double>").alias(c) if c in ("mz", "intensity") else F.col(f"`{c}`") for c in spectra.columns if not (places and c == "i")))
    # metadata of the file that spectra came from travel with them; peaks are no profile any more
    peaks_only = lambda meta: meta | {"imzml": {k: v for k, v in meta["imzml"].items() if k != "profile"} | {"centroid": True}} if places and "imzml" in meta else meta
    own = {f.name: f.metadata for f in spectra.schema}
    fields = [StructField(f.name, ArrayType(DoubleType()) if f.name in ("mz", "intensity") else f.dataType, f.nullable, peaks_only(own[f.name])) for f in held.schema]
    if places:
        fields.append(StructField("i", ArrayType(IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, r in ragged.ragged_slices(batch):
                for step in steps:
                    r = step(r)
                new = {"mz": r.mz, "intensity": r.x}
                columns = [ragged.as_list(new[c], r.bounds) if c in new else part.column(c) for c in part.schema.names]
                if places:
                    columns.append(ragged.as_list((r.i if r.places is None else r.places).astype(np.int32), r.bounds))
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *(["i"] if places else [])])

    return held.mapInArrow(run, StructType(fields))


class Pipeline:
    def __init__(self, spectra: DataFrame, spectrum_type: str = "profile"):
        """spectra: points (spectrum_id, i, n, mz, intensity) or rows with arrays mz and intensity."""
        if spectrum_type not in ("profile", "centroid"):
            raise ValueError("spectrum_type is profile or centroid")
        for c in ("mz", "intensity"):
            if c not in spectra.columns:
                raise ValueError(f"spectra have no column {c}")
        kinds = {c: isinstance(spectra.schema[c].dataType, ArrayType) for c in ("mz", "intensity")}
        if kinds["mz"] != kinds["intensity"]:
            raise ValueError("mz and intensity are both arrays or neither")
        self.spectra, self.nested, self.spectrum_type = spectra, kinds["mz"], spectrum_type
        self.steps: list[Step] = []

    def _add(self, kind: str, points, arrays=None, spectra=None) -> Pipeline:
        self.steps.append(Step(kind, points, arrays, spectra))
        return self

    def baseline_correction(self, method: str = "locmin", scale: float = 1.0, smooth: str = "none", span: float = 0.1, over: str = "index", knots: int = 5, **how) -> Pipeline:
        """locmin, snip (m=None: by the spectrum's length) or asls; its baseline may be smoothed by LOWESS, over the samples'
        numbers or over m/z, or by a natural cubic spline through every ``knots``-th sample of it."""
        if method not in BASELINES:
            raise ValueError(f"baseline_correction: unknown method {method}")
        if smooth not in ("none", "lowess", "spline"):
            raise ValueError(f"baseline_correction: unknown smooth {smooth}")
        if over not in ("index", "mz"):
            raise ValueError(f"baseline_correction: LOWESS over index or mz, not {over}")
        if not 0 < scale <= 1:
            raise ValueError("baseline scale must be in (0, 1]")

        def run(points: DataFrame) -> DataFrame:
            held = BASELINES[method](points, **how)
            if smooth != "none":
                held = layout.smoothed_baseline(held, smooth, span, over, knots)
            return baseline.corrected(held, scale=scale).drop("baseline")

        return self._add("baseline", run, lambda r: ragged.corrected(r, method, scale, smooth, span, over, knots, **how))

    def noise_reduction(self, method: str = "ma", **how) -> Pipeline:
        """ma, gaussian, savgol, wavelet; gaussian_ns and bi_ns over the nearest points by m/z."""
        if method not in SMOOTHERS:
            raise ValueError(f"noise_reduction: unknown method {method}")
        return self._add("noise", lambda p: SMOOTHERS[method](p, **how), lambda r: RAGGED_SMOOTHERS[method](r, **how))

    def normalization(self, method: str = "tic", **how) -> Pipeline:
        if method not in normalize.METHODS:
            raise ValueError(f"normalization: unknown method {method}")
        return self._add("normalization", lambda p: normalize.normalize(p, method, **how), lambda r: ragged.normalized(r, method, **how))

    def peak_pick(self, method: str = "local", noise: str = "quantile", **how) -> Pipeline:
        """local: maxima by prominence, height and noise, with noise bins="fixed" or "dynamic" along the spectrum (nbins). shape:
        plateau maxima by prominence, width and area. Dynamic bins and shape need spectra as arrays."""
        if method not in ("local", "shape"):
            raise ValueError(f"peak_pick: unknown method {method}")
        if method == "shape":
            return self._add("picking", None, lambda r: ragged.picked_by_shape(r, noise, **how))
        if how.get("bins", "fixed") not in ("fixed", "dynamic"):
            raise ValueError(f"peak_pick: unknown bins {how['bins']}")
        points = None if how.get("bins") == "dynamic" else lambda p: peaks.pick(p, noise=noise, **{k: v for k, v in how.items() if k != "bins"})
        peaks.checked(how.get("width", 5), how.get("nbins", 1), how.get("return_type", "height"), noise)
        return self._add("picking", points, lambda r: ragged.picked(r, noise_method=noise, **how))

    def peak_align(self, reference: list[float] | None = None, tolerance: float | None = None, units: str = "ppm", binfun: str = "median", binratio: float = 2.0, mode: str = "auto") -> Pipeline:
        """Spectra on a given reference axis (tolerance in the units then needed), or on the one that all spectra give. Points
        give a row for each reference that a spectrum reaches, arrays give arrays of these (``align.dense`` fills the axis)."""
        if reference is not None and tolerance is None:
            raise ValueError("peak_align: a given axis needs a tolerance")

        def axis_of(spectra: DataFrame) -> tuple[DataFrame, float, bool]:
            if reference is not None:
                axis = spectra.sparkSession.createDataFrame(list(enumerate(sorted(map(float, reference)))), "peak int, mz double")
                return axis, tolerance * 1e-6 if units == "ppm" else tolerance, units in ("ppm", "relative")
            axis, grid = aligning.reference(spectra, units, binfun, binratio, tolerance)
            return axis, grid.tolerance, grid.relative

        def run(points: DataFrame) -> DataFrame:
            axis, near, relative = axis_of(points)
            found = aligning.on_axis(points, axis, near, relative, mode)
            return found.join(axis.select("peak", "mz"), "peak").select("spectrum_id", F.col("peak").alias("i"), "mz", "intensity")

        def run_arrays(spectra: DataFrame) -> DataFrame:
            return aligning.aligned_arrays(spectra, *axis_of(spectra), mode)

        return self._add("alignment", run, None, run_arrays)

    def apply(self, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        """Any function of spectra (in the form that they came in) to spectra, after normalization."""
        return self._add("custom", fn, None, fn)

    def plan(self) -> list[Step]:
        """The steps as they will run."""
        ordered = sorted(self.steps, key=lambda s: RANKS[s.kind])
        if self.spectrum_type == "profile":
            return ordered
        for s in ordered:
            if s.kind in PROFILE_ONLY:
                warnings.warn(f"{s.kind} is left out on centroid spectra", stacklevel=2)
        return [s for s in ordered if s.kind not in PROFILE_ONLY]

    def output_type(self) -> str:
        return "centroid" if self.spectrum_type == "centroid" or any(s.kind == "picking" for s in self.steps) else "profile"

    def start(self) -> DataFrame:
        df = self.spectra
        if not self.nested:
            for step in self.plan():
                if step.points is None:
                    raise ValueError(f"{step.kind}: this method needs spectra as arrays (layout.nest_points)")
                df = df.transform(step.points)
            return df
        held: list[Step] = []

        def flush(df: DataFrame) -> DataFrame:
            out = fused(df, [s.arrays for s in held], places=any(s.kind == "picking" for s in held)) if held else df
            held.clear()
            return out

        for step in self.plan():
            if step.arrays is not None:
                held.append(step)
            else:
                df = flush(df).transform(step.spectra)
        return flush(df)
