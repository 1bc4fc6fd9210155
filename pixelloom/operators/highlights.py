"""Highlight repair by clip bits, and the detail layer, of mosaics developed by a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.operators.windows import box_blur

HUE_PULL, DETAIL_LOW, DETAIL_HIGH = 0.65, 0.25, 4.0


def clipped_nearby(cells: DataFrame, by: list[str], bit: int) -> DataFrame:
    """Share of the 3 x 3 cells about each cell whose clip bit is set; fewer cells at borders. Adds ``near_<bit>``."""
    name = f"near_{bit}"
    flagged = cells.withColumns({name: F.col("clip").bitwiseAND(F.lit(1 << bit).cast("long")).cast("boolean").cast("double")})
    for axis, other in (("cx", "cy"), ("cy", "cx")):
        flagged = flagged.withColumn(name, F.avg(name).over(W.partitionBy(*by, other).orderBy(axis).rowsBetween(-1, 1)))
    return flagged


def repaired_highlights(pixels: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Channels whose mosaic is clipped nearby rise toward the brightest channel, and the hue is pulled toward grey.

    pixels: (by, y, x, r, g, b); cells: (by, cy, cx, clip) with bits for red, two greens, blue."""
    for bit in range(4):
        cells = clipped_nearby(cells, by, bit)
    marks = cells.select(*by, "cy", "cx", *(f"near_{k}" for k in range(4)))
    placed = pixels.withColumns({"cy": F.floor(F.col("y") / 2), "cx": F.floor(F.col("x") / 2)}).join(marks, [*by, "cy", "cx"], "left")
    share = [F.coalesce("near_0", F.lit(0.0)), F.coalesce(F.greatest("near_1", "near_2"), F.lit(0.0)), F.coalesce("near_3", F.lit(0.0))]
    peak = F.greatest("r", "g", "b")
    raised = [F.col(c) + (peak - F.col(c)) * C.smooth01(s) for c, s in zip("rgb", share)]
    placed = placed.withColumns({"_r": raised[0], "_g": raised[1], "_b": raised[2], "_s": HUE_PULL * C.smooth01(F.greatest(*share))})
    level = C.luma(F.col("_r"), F.col("_g"), F.col("_b"))
    return placed.withColumn("_l", level).withColumns({c: F.col(f"_{c}") + (F.col("_l") - F.col(f"_{c}")) * F.col("_s") for c in "rgb"}).select(*pixels.columns)


def detail_layer(pixels: DataFrame, reference: DataFrame, by: list[str], amount: float = 1.0) -> DataFrame:
    """Puts the fine structure of a reference's luminance back: its ratio to its own 3 x 3 mean, within limits."""
    fine = reference.select(*by, "y", "x", C.luma(F.col("r"), F.col("g"), F.col("b")).alias("fine"))
    fine = box_blur(fine.withColumn("smooth", F.col("fine")), by, "smooth", 1)
    ratio = C.clampf(F.col("fine") / F.greatest("smooth", F.lit(1e-6)), DETAIL_LOW, DETAIL_HIGH)
    gain = 1.0 + amount * (ratio - 1.0)
    joined = pixels.join(fine, [*by, "y", "x"])
    return joined.withColumns({c: F.col(c) * gain for c in "rgb"}).select(*pixels.columns)
