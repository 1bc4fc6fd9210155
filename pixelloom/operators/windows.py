"""Neighbourhood operators on exploded rasters (image_id, y, x, value): separable passes along rows, then columns.

A pass is a window over one line of one image, so a task never needs more than a line's rows in order. Edge rules differ
by operator and are named: shrink (fewer pixels at the border), clamp (the edge pixel repeats), drop (no output there).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions import color as C

#: exp(-k^2 / 2) for k = -3 .. 3, of sum 1.
GAUSS7 = tuple(math.exp(-0.5 * k * k) / sum(math.exp(-0.5 * j * j) for j in range(-3, 4)) for k in range(-3, 4))


def _along(axis: str, by: list[str]) -> W:
    other = "y" if axis == "x" else "x"
    return W.partitionBy(*by, other).orderBy(axis)


def taps(value: str, axis: str, by: list[str], reach: int, edge: str = "clamp") -> dict[int, Column]:
    """The values at offsets -reach .. reach along an axis; beyond the border the edge value, or null (drop)."""
    line = _along(axis, by)
    out: dict[int, Column] = {0: F.col(value)}
    first, last = F.first(value).over(line.rowsBetween(W.unboundedPreceding, 0)), F.last(value).over(line.rowsBetween(0, W.unboundedFollowing))
    for k in range(1, reach + 1):
        before, after = F.lag(value, k).over(line), F.lead(value, k).over(line)
        out[-k] = F.coalesce(before, first) if edge == "clamp" else before
        out[k] = F.coalesce(after, last) if edge == "clamp" else after
    return out


def box_blur(df: DataFrame, by: list[str], value: str, radius: int) -> DataFrame:
    """Mean of a square that shrinks at borders."""
    for axis in "xy":
        df = df.withColumn(value, F.avg(value).over(_along(axis, by).rowsBetween(-radius, radius)))
    return df


def box_blur_clamped(df: DataFrame, by: list[str], value: str, radius: int) -> DataFrame:
    """Mean of a square in which the edge pixel repeats."""
    for axis in "xy":
        t = taps(value, axis, by, radius)
        df = df.withColumn(value, reduce(lambda a, b: a + b, (t[k] for k in sorted(t))) / (2 * radius + 1))
    return df


def gaussian7(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Seven taps of sigma 1, the edge pixel repeats."""
    for axis in "xy":
        t = taps(value, axis, by, 3)
        df = df.withColumn(value, reduce(lambda a, b: a + b, (t[k] * GAUSS7[k + 3] for k in sorted(t))))
    return df


def sobel(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds gx, gy and magnitude; the border is dropped."""
    tx = taps(value, "x", by, 1, "drop")
    df = df.withColumns({"_dx": tx[1] - tx[-1], "_sx": tx[-1] + 2.0 * tx[0] + tx[1]})
    ty, ts = taps("_dx", "y", by, 1, "drop"), taps("_sx", "y", by, 1, "drop")
    df = df.withColumns({"gx": ty[-1] + 2.0 * ty[0] + ty[1], "gy": ts[1] - ts[-1]}).drop("_dx", "_sx").where("gx is not null and gy is not null")
    return df.withColumn("magnitude", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def extremum(df: DataFrame, by: list[str], value: str, radius: int, dilate: bool) -> DataFrame:
    """Greatest (dilate) or least value of a square that shrinks at borders."""
    f = F.max if dilate else F.min
    for axis in "xy":
        df = df.withColumn(value, f(value).over(_along(axis, by).rowsBetween(-radius, radius)))
    return df


def close(df: DataFrame, by: list[str], value: str, radius: int) -> DataFrame:
    return extremum(extremum(df, by, value, radius, True), by, value, radius, False)


def sharpen(df: DataFrame, by: list[str], strength: float = 0.4, radius: int = 2, weights=C.LUMA_709) -> DataFrame:
    """Unsharp mask of the luminance: gated against noise, capped at half the detail, the same shift for r, g and b."""
    df = df.withColumn("_l", C.luma(F.col("r"), F.col("g"), F.col("b"), weights)).withColumn("_b", F.col("_l"))
    df = box_blur_clamped(df, by, "_b", radius)
    detail = F.col("_l") - F.col("_b")
    floor = F.greatest(0.02 * F.abs("_b"), F.lit(1e-3))
    gate = F.when(F.abs(detail) <= floor, 0.0).otherwise(C.smooth01((F.abs(detail) - floor) / (2.0 * floor)))
    shift = C.clampf(strength * gate * detail, -0.5 * F.abs(detail), 0.5 * F.abs(detail))
    return df.withColumn("_s", shift).withColumns({c: F.col(c) + F.col("_s") for c in "rgb"}).drop("_l", "_b", "_s")


def laplacian_energy(df: DataFrame, by: list[str], value: str, axis: str = "x") -> DataFrame:
    """Mean of |2c - l - r| along an axis, over pixels with both neighbours."""
    t = taps(value, axis, by, 1, "drop")
    return df.select(*by, F.abs(2.0 * t[0] - t[-1] - t[1]).alias("_e")).where("_e is not null").groupBy(*by).agg(F.avg("_e").alias("energy"), F.count(F.lit(1)).alias("n"))


def seam_ratio(df: DataFrame, by: list[str], value: str, period: int) -> DataFrame:
    """Energy at multiples of ``period`` (within 2 pixels) over that near them (3 to 6)."""
    t = taps(value, "x", by, 1, "drop")
    off = F.pmod("x", F.lit(period))
    away = F.least(off, period - off)
    seam = df.select(*by, F.abs(2.0 * t[0] - t[-1] - t[1]).alias("_e"), away.alias("_d"), (F.col("x") >= period - 6).alias("_in")).where("_e is not null and _in")
    on, near = F.avg(F.when(F.col("_d") <= 2, F.col("_e"))), F.avg(F.when(F.col("_d").between(3, 6), F.col("_e")))
    return seam.groupBy(*by).agg(on.alias("on_seam"), near.alias("near_seam"))


def runs(df: DataFrame, by: list[str], flag: str, axis: str = "x") -> DataFrame:
    """Maximal runs of true along an axis: (by, line, start, stop)."""
    line = "y" if axis == "x" else "x"
    hit = df.where(F.col(flag)).withColumn("_island", F.col(axis) - F.row_number().over(_along(axis, by)))
    return hit.groupBy(*by, F.col(line).alias("line"), "_island").agg(F.min(axis).alias("start"), F.max(axis).alias("stop")).drop("_island")


def split_lines(df: DataFrame, by: list[str], flag: str, axis: str = "x") -> DataFrame:
    """How many lines have more than one run."""
    per = runs(df, by, flag, axis).groupBy(*by, "line").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(*by).agg(F.count_if(F.col("k") > 1).alias("split"))


def longest_run(df: DataFrame, by: list[str], flag: str, gap: int, axis: str = "x") -> DataFrame:
    """The longest run of each line that bridges gaps of up to ``gap`` pixels: (by, line, span, hits)."""
    line = "y" if axis == "x" else "x"
    order = _along(axis, by)
    hit = df.where(F.col(flag)).withColumn("_new", (F.col(axis) - F.lag(axis).over(order) > gap + 1).cast("int"))
    hit = hit.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(order))
    spans = hit.groupBy(*by, F.col(line).alias("line"), "_run").agg((F.max(axis) - F.min(axis) + 1).alias("span"), F.count(F.lit(1)).alias("hits"))
    return spans.groupBy(*by, "line").agg(F.max(F.struct("span", "hits")).alias("m")).select(*by, "line", "m.span", "m.hits")


def contour(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Mask pixels with one of four neighbours outside the mask or the image."""
    inside = df.withColumn("_f", F.col(flag).cast("int"))
    tx, ty = taps("_f", "x", by, 1, "drop"), taps("_f", "y", by, 1, "drop")
    lone = [F.coalesce(v, F.lit(0)) == 0 for v in (tx[-1], tx[1], ty[-1], ty[1])]
    return inside.withColumn("_edge", lone[0] | lone[1] | lone[2] | lone[3]).where((F.col("_f") == 1) & F.col("_edge")).drop("_f", "_edge")


def speckle_threshold(df: DataFrame, by: list[str], value: str, deviation: str, k: float = 1.2) -> DataFrame:
    """Soft threshold of what a 3 x 3 mean leaves, at ``k`` deviations."""
    df = box_blur(df.withColumn("_low", F.col(value)), by, "_low", 1)
    high = F.col(value) - F.col("_low")
    return df.withColumn(value, F.col("_low") + F.signum(high) * F.greatest(F.abs(high) - k * F.col(deviation), F.lit(0.0))).drop("_low")


def text_blocks(df: DataFrame, by: list[str], gx: str, gy: str, cutoff: float, half: int = 8) -> DataFrame:
    """Marks pixels whose surroundings are busy both ways, as text is."""
    df = df.withColumns({"_ax": F.abs(gx), "_ay": F.abs(gy)})
    for axis in "xy":
        frame = _along(axis, by).rowsBetween(-half, half - 1)
        df = df.withColumns({"_ax": F.avg("_ax").over(frame), "_ay": F.avg("_ay").over(frame)})
    return df.withColumn("text", (F.col("_ax") > cutoff) & (F.col("_ay") > cutoff)).drop("_ax", "_ay")
