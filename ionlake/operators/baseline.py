"""Baseline estimates and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .layout import per_spectrum, in_order, whole, finite


def up_to_here() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def from_here() -> WindowSpec:
    return in_order().rowsBetween(0, Window.unboundedFollowing)


def corrected(points: DataFrame, baseline: str = "baseline", scale: float = 1.0) -> DataFrame:
    """Intensity less the scaled baseline, never below 0."""
    if not 0 < scale <= 1:
        raise ValueError("baseline scale must be in (0, 1]")
    return points.withColumn("intensity", F.greatest(F.col("intensity") - scale * F.col(baseline), F.lit(0.0)))


def local_maxima(x: Column, radius: int, right_edge: int) -> Column:
    """Strictly above the left neighbours within the radius, not below the right ones: a plateau's first sample.
    right_edge: how many samples at the end cannot be maxima."""
    i, n = F.col("i"), F.col("n")
    x = F.when(finite(x), x)  # non-finite neighbours are passed over
    left = F.max(x).over(in_order().rowsBetween(-radius, -1)) if radius else F.lit(None).cast("double")
    right = F.max(x).over(in_order().rowsBetween(1, radius)) if radius else F.lit(None).cast("double")
    fits = (i >= radius) & (i <= n - 1 - right_edge) & (F.coalesce(left, F.lit(float("-inf"))) < x) & (F.coalesce(right, F.lit(float("-inf"))) <= x)
    return fits if radius else F.lit(False)


def locmin(points: DataFrame, width: int = 5, upper: bool = False) -> DataFrame:
    """Baseline by linear interpolation between local minima (maxima if upper); both ends are anchors.
    Non-finite samples count as the median of the finite ones; fewer than 3 points: their minimum (maximum)."""
    if width < 3:
        raise ValueError("locmin: width must be at least 3")
    r = width // 2
    ok = finite(F.col("intensity"))
    held = points.withColumn("s", F.when(ok, F.col("intensity")).otherwise(F.coalesce(F.median(F.when(ok, F.col("intensity"))).over(per_spectrum()), F.lit(0.0))))
    s, i, n = F.col("s"), F.col("i"), F.col("n")
    turned = s if upper else -s
    held = held.withColumn("anchor", local_maxima(turned, r, r) | (i == 0) | (i == n - 1))
    mark = F.when(F.col("anchor"), F.struct("i", "s"))
    held = held.withColumn("p", F.last(mark, ignorenulls=True).over(up_to_here())).withColumn("q", F.first(mark, ignorenulls=True).over(from_here()))
    p, q = F.col("p"), F.col("q")
    line = F.when(p["i"] == q["i"], p["s"]).otherwise(p["s"] + (q["s"] - p["s"]) * (i - p["i"]) / (q["i"] - p["i"]))
    flat = (F.max(s) if upper else F.min(s)).over(per_spectrum())
    return held.withColumn("baseline", F.when(n < 3, flat).otherwise(line)).drop("s", "anchor", "p", "q")


def snip(points: DataFrame, m: int = 5, decreasing: bool = True) -> DataFrame:
    """Clipping by the mean of the samples p to either side, for p from m to 1 (or 1 to m). One window a step:
    for m up to about 8; beyond that ``spectrum_udfs`` has the array form."""
    held = points.withColumn("baseline", F.col("intensity"))
    y = F.col("baseline")
    for p in range(m, 0, -1) if decreasing else range(1, m + 1):
        mean = (F.lag(y, p).over(in_order()) + F.lead(y, p).over(in_order())) / 2
        held = held.withColumn("baseline", F.least(y, F.coalesce(mean, y)))
    return held
