"""Peak alignment: a reference m/z axis from all spectra, and spectra on that axis."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import ragged, spectrum_udfs
from .layout import as_arrays, nest_points

EPS = 2.220446049250313e-16
LEAST_RELATIVE, LEAST_ABSOLUTE = 5e-7, 1e-4
#: References that an executor holds at most: 128 MB. A relative axis of the finest grid over m/z 50 to 100,000 has fewer.
MOST_REFERENCES = 16_000_000


class Domain(NamedTuple):
    """A grid of m/z bins, known by its rule and never written out."""

    low: float
    high: float
    step: float
    tolerance: float
    relative: bool

    @property
    def ratio(self) -> float:
        return (1 + self.step / 2) / (1 - self.step / 2)

    @property
    def count(self) -> int:
        if not self.relative:
            return max(0, math.ceil((self.high + self.step - self.low) / self.step))
        if self.low <= 0:
            raise ValueError("a relative grid needs m/z of 1 or more")
        return int(math.floor(1 + (math.log(self.high) - math.log(self.low)) / math.log(self.ratio)))


def _relative(units: str) -> bool:
    return units in ("ppm", "relative")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, m/z, place in its spectrum) of all finite points of a batch whose second column is m/z arrays."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    mz = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(sizes)), sizes)
    i = np.arange(len(mz)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ok = np.isfinite(mz)
    return row[ok], mz[ok], i[ok]


def resolution(points: DataFrame, units: str = "ppm") -> DataFrame:
    """(spectrum_id, resolution, low, high): the smallest gap between neighbours, null where there is none. Takes
    points or spectra with arrays; whole batches of spectra are worked through at once."""
    relative = _relative(units)
    spectra = as_arrays(points, "mz").select("spectrum_id", F.col("mz").cast("array<double>").alias("mz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, mz, _ = _flat(batch)
            order = np.lexsort((mz, row))
            row, mz = row[order], mz[order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            gap = np.full(len(mz), np.inf)
            gap[1:] = mz[1:] - mz[:-1]
            if relative:
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap[1:] = 2 * gap[1:] / (mz[1:] + mz[:-1])
            gap[first] = np.inf
            gap[~(gap > EPS)] = np.inf
            least = np.minimum.reduceat(gap, first) if len(first) else np.zeros(0)
            last = np.r_[first[1:], len(mz)] - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), pa.array(least, mask=~np.isfinite(least)), pa.array(mz[first]), pa.array(mz[last]) if len(first) else pa.array([], pa.float64())], ["spectrum_id", "resolution", "low", "high"])

    kind = spectra.schema["spectrum_id"].dataType.simpleString()
    return spectra.mapInArrow(run, f"spectrum_id {kind}, resolution double, low double, high double")


def _around(c: str) -> tuple[Column, Column]:
    """The number of a column's values, and bounds a few millionths of them around the median."""
    return F.count(c), F.percentile_approx(c, F.array(F.lit(0.5 - 2e-6), F.lit(0.5 + 2e-6)), F.lit(1_000_000))


def _median(values: DataFrame, n: int | None = None, around: list[float] | None = None) -> float | None:
    """The exact median of a column ``v`` in two rounds: approximate bounds around it (unless known), then the distinct
    values between them; no task holds more."""
    values = values.where(F.col("v").isNotNull())
    if n is None:
        n, around = values.agg(*_around("v")).first()
    if not n:
        return None
    low, high = around
    band = values.groupBy(F.when(F.col("v") < low, F.lit(None)).otherwise(F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    found, seen, want = [], 0, [(n - 1) // 2, n // 2]
    for v, c in band.where(F.col("v").isNull() | (F.col("v") <= high)).orderBy(F.asc_nulls_first("v")).collect():
        found += [v for w in want if seen <= w < seen + c]
        seen += c
    return sum(found) / 2


def domain(points: DataFrame, units: str = "ppm", binfun: str = "median", binratio: float = 2.0) -> Domain:
    """The grid of all spectra; scalars come to the driver."""
    spread = resolution(points, units)
    if binfun == "median":
        spread = spread.persist()  # a row a spectrum, read twice
        n, around, low, high = spread.agg(*_around("resolution"), F.min("low"), F.max("high")).first()
        step = _median(spread.select(F.col("resolution").alias("v")), n, around)
        spread.unpersist()
    else:
        step, low, high = spread.agg({"min": F.min, "max": F.max}.get(binfun, F.avg)("resolution"), F.min("low"), F.max("high")).first()
    return grid_of(step, low, high, units, binratio)


def grid_of(step: float | None, low: float, high: float, units: str = "ppm", binratio: float = 2.0) -> Domain:
    """The grid of a resolution between two m/z."""
    if step is None:
        raise ValueError("align: no spectrum has two points")
    low, high = float(math.floor(low)), float(math.ceil(high))
    if _relative(units):
        step = max(LEAST_RELATIVE, round(2.0 * step, 6) * 0.5)
        return Domain(low, high, step, round(2.0 * (step * binratio), 6) * 0.5, True)
    step = max(LEAST_ABSOLUTE, round(step, 4))
    return Domain(low, high, step, round(step * binratio, 4), False)


def _best_bins(batch: pa.RecordBatch, grid: Domain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, m/z) of the peak of a row's m/z array that lies nearest to each bin within the tolerance."""
    row, mz, i = _flat(batch)
    top = grid.count - 1
    values = lambda k: grid.low * grid.ratio**k if grid.relative else grid.low + k * grid.step
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.floor((np.log(mz) - math.log(grid.low)) / math.log(grid.ratio) if grid.relative else (mz - grid.low) / grid.step)
    k = np.clip(np.nan_to_num(k), 0, top)
    up = np.minimum(k + 1, top)
    a, b = np.abs(mz - values(k)), np.abs(mz - values(up))
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.minimum(a, b) / (np.abs(mz) if grid.relative else 1.0)
    near = np.flatnonzero(off <= grid.tolerance)
    place = np.where(b < a, up, k)[near].astype(np.int64)
    row, mz, i, off = row[near], mz[near], i[near], off[near]
    order = np.lexsort((i, off, place, row))
    row, mz, place = row[order], mz[order], place[order]
    best = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
    return row[best], place[best], mz[best]


def bins(points: DataFrame, grid: Domain) -> DataFrame:
    """(bin, mz, count): in each spectrum the peak nearest a bin, then their mean and number over spectra. Spectra are
    worked through batch by batch, and a batch hands on one row a bin."""
    spectra = as_arrays(points, "mz").select("spectrum_id", F.col("mz").cast("array<double>").alias("mz"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, place, mz = _best_bins(batch, grid)
            found, at = np.unique(place, return_inverse=True)
            count = np.bincount(at, minlength=len(found))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, mz, minlength=len(found))), pa.array(count.astype(np.int64))], ["bin", "total", "count"])

    got = spectra.mapInArrow(run, "bin long, total double, count long").groupBy("bin").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    return got.select("bin", (F.col("total") / F.col("count")).alias("mz"), "count")


PIECE = "part int, piece int, total double, count long, first_mz double, first_count long, last_mz double, last_count long, whole boolean, turn int, pieces int, unsettled int"


def _pieces(part: int, mz: np.ndarray, count: np.ndarray, grid: Domain) -> pa.Table:
    """A range of bins (ascending) cut by itself: at gaps, at valleys, and at the two places where the ranges before decide,
    its first bin and its first rise if neither a gap nor a fall comes before it. What the ranges after need to
    know stands in the first piece's row: the ends, whether one run goes through, the last turn of the last run."""
    step = np.diff(mz)
    far = np.r_[False, (step / np.abs(mz[1:]) if grid.relative else step) > grid.tolerance]
    run = np.cumsum(far)
    turn = np.r_[0, np.sign(np.diff(count))] * ~far
    at = np.arange(len(mz))
    last = np.r_[-1, np.maximum.accumulate(np.where(turn != 0, at, -1))[:-1]]  # where the count changed last, before
    known = (last >= 0) & (run[last] == run)
    unsettled = (run == 0) & (turn > 0) & ~known
    cut = (at == 0) | far | ((turn > 0) & known & (turn[last] < 0)) | unsettled
    piece = np.cumsum(cut)
    k = int(piece[-1])
    here = np.flatnonzero(turn != 0)
    ended = int(turn[here[-1]]) if len(here) and run[here[-1]] == run[-1] else 0
    open_ = int(piece[unsettled][0]) if unsettled.any() else None
    first = lambda v: [v, *[None] * (k - 1)]
    columns = [[part] * k, list(range(1, k + 1)), np.bincount(piece - 1, count * mz), np.bincount(piece - 1, count).astype(np.int64)]
    columns += map(first, (float(mz[0]), int(count[0]), float(mz[-1]), int(count[-1]), bool(run[-1] == 0), ended, k, open_))
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in PIECE.split(", ")])


def _settled(rows: list, grid: Domain) -> list[tuple[int, int, bool, bool, int | None]]:
    """(part, number of its first piece, whether that begins a group, whether its unsettled piece does, that piece) from range
    to range."""
    out, offset, before = [], 0, None
    for r in sorted(rows, key=lambda r: r["part"]):
        opens, turn = True, 0  # turn: the last change of counts up to the range's first bin, in the run that reaches it
        if before is not None:
            mz, count, turn = before
            gap = r["first_mz"] - mz
            opens = (gap / abs(r["first_mz"]) if grid.relative else gap) > grid.tolerance
            if opens:
                turn = 0
            elif r["first_count"] != count:
                rises = r["first_count"] > count
                opens, turn = rises and turn < 0, 1 if rises else -1
        falls = r["unsettled"] is not None and turn < 0
        out.append((r["part"], offset, opens, falls, r["unsettled"]))
        offset += r["pieces"] - (not opens) - (r["unsettled"] is not None and not falls)
        before = r["last_mz"], r["last_count"], r["turn"] or (turn if r["whole"] else 0)
    return out


def merge(binned: DataFrame, grid: Domain, parts: int | None = None) -> DataFrame:
    """(peak, mz, count): neighbouring bins joined while gaps stay within the tolerance and counts do not rise
    after a fall.

    A scan over the axis in ranges of 100,000 bins of the grid: each is cut into pieces by itself, of each one summary
    row comes to the driver, which settles the open places from range to range, and pieces that belong together are added
    up. The result is persisted, as small as the axis; the caller may unpersist it.
    """
    parts = parts or max(1, min(4096, -(-grid.count // 100_000)))
    held = binned.select(F.floor(F.col("bin") * parts / F.lit(max(1, grid.count))).cast("int").alias("part"), "bin", F.col("mz").cast("double").alias("mz"), F.col("count").cast("long").alias("count"))

    def scan(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        return _pieces(key[0].as_py(), table.column("mz").to_numpy(), table.column("count").to_numpy(), grid)

    pieces = held.groupBy("part").applyInArrow(scan, PIECE).persist()
    known = binned.sparkSession.createDataFrame(_settled(pieces.where("pieces is not null").collect(), grid), "part int, offset long, opens boolean, falls boolean, at int")
    number = F.col("offset") + F.col("piece") - 1 - F.when(F.col("opens"), 0).otherwise(1) - F.when(~F.col("falls") & (F.col("at") <= F.col("piece")), 1).otherwise(0)
    joined = pieces.join(F.broadcast(known), "part").groupBy(number.cast("int").alias("peak")).agg((F.sum("total") / F.sum("count")).alias("mz"), F.sum("count").alias("count")).persist()
    joined.count()
    pieces.unpersist()
    return joined


def reference(points: DataFrame, units: str = "ppm", binfun: str = "median", binratio: float = 2.0, tolerance: float | None = None) -> tuple[DataFrame, Domain]:
    """The reference peaks and the grid; tolerance in ppm or m/z overrides the estimate."""
    grid = domain(points, units, binfun, binratio)
    if tolerance is not None:
        grid = grid._replace(tolerance=tolerance * 1e-6 if units == "ppm" else tolerance)
    return merge(bins(points, grid), grid), grid


def align_down(points: DataFrame, peaks: DataFrame, grid: Domain) -> DataFrame:
    """(spectrum_id, peak, intensity) of the references that have a peak of the spectrum within the tolerance."""
    return on_axis(points, peaks, grid.tolerance, grid.relative, "down")


def _held(spark, axis: DataFrame | list[float] | np.ndarray) -> np.ndarray:
    """The references' m/z in their order; MOST_REFERENCES at most."""
    if not isinstance(axis, DataFrame):
        return np.array(axis, dtype=float)
    held = axis.select("peak", "mz").limit(MOST_REFERENCES + 1).toArrow()
    if held.num_rows > MOST_REFERENCES:
        raise ValueError(f"align: more than {MOST_REFERENCES} references; take a larger tolerance or binratio")
    return held.sort_by("peak").column("mz").to_numpy().astype(float)


def _matched(spectra: DataFrame, axis, tolerance: float, relative: bool, mode: str, fill_holes: bool, out: Callable, schema) -> DataFrame:
    """One pass over batches of spectra: ``out`` makes a batch of the matches of some spectra."""
    if mode not in ("auto", "down", "up"):
        raise ValueError(f"align: unknown mode {mode}")
    shared = spectra.sparkSession.sparkContext.broadcast(_held(spectra.sparkSession, axis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, r in ragged.ragged_slices(batch):
                r = ragged.in_order(r)
                yield from out(part, r, shared.value, *ragged.matches(r, shared.value, tolerance, relative, mode, fill_holes))

    return spectra.mapInArrow(run, schema)


def on_axis(points: DataFrame, axis: DataFrame | list[float], tolerance: float, relative: bool = True, mode: str = "auto", fill_holes: bool = False) -> DataFrame:
    """(spectrum_id, peak, intensity) of the references that a spectrum reaches, each spectrum by itself; ``auto`` takes
    the downward or the upward way by its number of peaks. No shuffle where spectra come as arrays.

    axis: a list, or the reference peaks (peak, mz), of which there are MOST_REFERENCES at most (8 bytes each); every
    executor holds them once.
    """
    spectra = as_arrays(points).select("spectrum_id", "mz", "intensity")

    def rows(part: pa.RecordBatch, r, reference, row, peak, point) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(peak.astype(np.int32)), pa.array(r.x[point])], ["spectrum_id", "peak", "intensity"])

    kind = spectra.schema["spectrum_id"].dataType.simpleString()
    return _matched(spectra, axis, tolerance, relative, mode, fill_holes, rows, f"spectrum_id {kind}, peak int, intensity double")


def aligned_arrays(spectra: DataFrame, axis: DataFrame | list[float], tolerance: float, relative: bool = True, mode: str = "auto") -> DataFrame:
    """Spectra with arrays mz and intensity of the references that they reach, and ``i``, the numbers of these; other columns
    stay."""
    kept = [c for c in spectra.columns if c != "i"]
    spectra = spectra.select(*(F.col(f"`{c}`") for c in kept))

    def rows(part: pa.RecordBatch, r, reference, row, peak, point) -> Iterator[pa.RecordBatch]:
        bounds = np.r_[0, np.cumsum(np.bincount(row, minlength=r.rows))]
        new = {"mz": ragged.as_list(reference[peak], bounds), "intensity": ragged.as_list(r.x[point], bounds)}
        yield pa.RecordBatch.from_arrays([*(new.get(c, part.column(c)) for c in kept), ragged.as_list(peak.astype(np.int32), bounds)], [*kept, "i"])

    doubles = ArrayType(DoubleType())
    fields = [StructField(f.name, doubles if f.name in ("mz", "intensity") else f.dataType, f.nullable, f.metadata) for f in spectra.schema]
    return _matched(spectra, axis, tolerance, relative, mode, False, rows, StructType([*fields, StructField("i", ArrayType(IntegerType()))]))


#: Bytes of one batch of dense blocks, about.
DENSE_BYTES = 16 << 20


def _blocks(ids: pa.Array, rows: int, row: np.ndarray, peak: np.ndarray, values: np.ndarray, references: int, block: int | None) -> Iterator[pa.RecordBatch]:
    """Matches, ascending by row, scattered into arrays of the axis's blocks, a buffer of DENSE_BYTES at a time."""
    wide = block or max(1, references)
    for number, first in enumerate(range(0, references, wide)):
        size = min(wide, references - first)
        here = np.flatnonzero((peak >= first) & (peak < first + size))
        at_once = max(1, DENSE_BYTES // (8 * size))
        for low in range(0, rows, at_once):
            n = min(at_once, rows - low)
            mine = here[np.searchsorted(row[here], low) : np.searchsorted(row[here], low + n)]
            cells = np.zeros(n * size)
            cells[(row[mine] - low) * size + peak[mine] - first] = values[mine]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.array(cells))
            yield pa.RecordBatch.from_arrays([ids.slice(low, n), pa.array(np.full(n, number, dtype=np.int32)), pa.array(np.full(n, first, dtype=np.int32)), lists], ["spectrum_id", "block", "first", "aligned"])


def dense_blocks(points: DataFrame, axis: DataFrame | list[float], tolerance: float, relative: bool = True, mode: str = "auto", fill_holes: bool = False, block: int | None = 4096) -> DataFrame:
    """(spectrum_id, block, first, aligned): all spectra over the whole axis, 0 where a reference is not reached, in blocks of
    so many references (None: all in one). Work goes with spectra times references, which is what comes out."""
    if block is not None and block < 1:
        raise ValueError("dense: a block has one reference at least")
    spectra = as_arrays(points).select("spectrum_id", "mz", "intensity")

    def rows(part: pa.RecordBatch, r, reference, row, peak, point) -> Iterator[pa.RecordBatch]:
        yield from _blocks(part.column(0), r.rows, row, peak, r.x[point], len(reference), block)

    kind = spectra.schema["spectrum_id"].dataType.simpleString()
    return _matched(spectra, axis, tolerance, relative, mode, fill_holes, rows, f"spectrum_id {kind}, block int, first int, aligned array<double>")


def dense(aligned: DataFrame, references: int) -> DataFrame:
    """(spectrum_id, aligned): sparse matches (spectrum_id, peak, intensity) as arrays over the whole axis, 0 where a
    reference is not reached."""
    held = aligned.groupBy("spectrum_id").agg(F.sort_array(F.collect_list(F.struct("peak", "intensity"))).alias("m")).select("spectrum_id", "m.peak", "m.intensity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not references:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[]] * batch.num_rows, pa.list_(pa.float64()))], ["spectrum_id", "aligned"])
                continue
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            peak, values = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            for out in _blocks(batch.column(0), batch.num_rows, row, peak, values, references, None):
                yield out.select(["spectrum_id", "aligned"])

    kind = held.schema["spectrum_id"].dataType.simpleString()
    return held.mapInArrow(run, f"spectrum_id {kind}, aligned array<double>")


def align(points: DataFrame, axis: list[float], tolerance: float, relative: bool = True, fill_holes: bool = False) -> DataFrame:
    """(spectrum_id, aligned array): all spectra on a given axis, by the kernel that also spreads few peaks over
    many references."""
    held = nest_points(points)
    return held.select("spectrum_id", spectrum_udfs.align(F.col("mz"), F.col("intensity"), axis, tolerance, relative, fill_holes).alias("aligned"))
