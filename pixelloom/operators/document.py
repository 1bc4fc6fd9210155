"""Finishing of scanned pages: paper balance, shadow removal, black and white points, sharpening.

Images are linear r, g, b relations with a header (by, width, height). The light field is a small raster, the long edge
``FIELD`` cells, so blurs over it cost little whatever the image's size; it joins back by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.operators.statistics import order_statistics, paper_balance
from pixelloom.operators.windows import box_blur, sharpen

FIELD, LEAST_SIDE, SHADE_RADIUS, EVEN_RADIUS, TEST_RADIUS, SHADED = 160, 8, 0.04, 0.12, 0.08, 1.55


def _luma() -> Column:
    return C.luma(F.col("r"), F.col("g"), F.col("b"))


def field_size(width: int, height: int) -> tuple[int, int]:
    """(height, width) of the light field."""
    long = max(width, height)
    scale = min(1.0, FIELD / long)
    return max(min(LEAST_SIDE, height), round(height * scale)), max(min(LEAST_SIDE, width), round(width * scale))


def light_field(df: DataFrame, by: list[str], width: int, height: int, share: float, least: int) -> DataFrame:
    """(by, cy, cx, light): mean luminance of each cell, blurred by a square that shrinks at borders."""
    fh, fw = field_size(width, height)
    cell = lambda at, n, m: F.least(F.floor(F.col(at) * m / n), F.lit(m - 1))
    cells = df.groupBy(*by, cell("y", height, fh).alias("y"), cell("x", width, fw).alias("x")).agg(F.avg(_luma()).alias("light"))
    blurred = box_blur(cells, by, "light", max(least, round(share * max(fh, fw))))
    return blurred.select(*by, F.col("y").alias("cy"), F.col("x").alias("cx"), "light")


def _light_at(df: DataFrame, field: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Adds the bilinear light of every pixel: four cells, looked up at once as a list for each pixel's corner cell."""
    fh, fw = field_size(width, height)
    spot = lambda at, n, m: C.clampf((F.col(at) + 0.5) * m / n - 0.5, 0.0, max(0.0, m - 1.01))
    placed = df.withColumns({"_v": spot("y", height, fh), "_u": spot("x", width, fw)}).withColumns({"_cy": F.floor("_v"), "_cx": F.floor("_u")})
    corner = lambda a, b: F.struct((F.col("cy") - a).alias("_cy"), (F.col("cx") - b).alias("_cx"), F.lit(2 * a + b).alias("k"))
    corners = field.withColumn("c", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))))
    pick = lambda k: F.max(F.when(F.col("c.k") == k, F.col("light"))).alias(f"_l{k}")
    four = corners.groupBy(*by, F.col("c._cy").alias("_cy"), F.col("c._cx").alias("_cx")).agg(*map(pick, range(4)))
    joined = placed.join(four, [*by, "_cy", "_cx"])
    l0 = F.col("_l0")
    l1, l2, l3 = (F.coalesce(f"_l{k}", l0) for k in (1, 2, 3))
    fy, fx = F.col("_v") - F.col("_cy"), F.col("_u") - F.col("_cx")
    light = (l0 * (1 - fx) + l1 * fx) * (1 - fy) + (l2 * (1 - fx) + l3 * fx) * fy
    return joined.withColumn("_light", light).drop("_v", "_u", "_cy", "_cx", "_l0", "_l1", "_l2", "_l3")


def shade_divided(df: DataFrame, field: DataFrame, targets: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Brings every pixel's light up to the group's ``target``, at most fourfold."""
    lit = _light_at(df, field, by, width, height).join(targets, by, "left")
    gain = F.least(F.col("target") / F.greatest(F.col("_light"), 0.22 * F.col("target")), F.lit(4.0))
    gain = F.coalesce(gain, F.lit(1.0))
    return lit.withColumns({c: F.col(c) * gain for c in "rgb"}).drop("_light", "target")


def shade_ratio(df: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """p90 / p10 of the page's blurred light."""
    field = light_field(df, by, width, height, TEST_RADIUS, 1)
    marks = order_statistics(field, by, "light", {"p10": 0.1, "p90": 0.9})
    return marks.select(*by, (F.col("p90") / F.greatest("p10", F.lit(1e-4))).alias("ratio"))


def even_shading(df: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Divides shadows out of pages whose light is uneven; others stay."""
    field = light_field(df, by, width, height, EVEN_RADIUS, 2)
    uneven = shade_ratio(df, by, width, height).where(F.col("ratio") >= SHADED).select(*by)
    target = order_statistics(field.where("light > 0.02"), by, "light", {"target": 0.9}).join(uneven, by)
    return shade_divided(df, field, target, by, width, height)


def finish_document(df: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Paper balance, shadow removal, black and white points, sharpening by 0.75."""
    df = df.select(*by, "y", "x", "r", "g", "b")
    gains = paper_balance(df, by).drop("n")
    df = df.join(gains, by, "left")
    df = df.withColumns({c: F.col(c) * F.coalesce(f"gain_{c}", F.lit(1.0)) for c in "rgb"}).drop("gain_r", "gain_g", "gain_b")
    field = light_field(df, by, width, height, SHADE_RADIUS, 1)
    target = order_statistics(field, by, "light", {"target": 0.9}).withColumn("target", F.greatest("target", F.lit(1e-3)))
    df = shade_divided(df, field, target, by, width, height)
    grey = df.withColumn("l", _luma()).withColumn("paper", F.when(C.low_chroma(F.col("r"), F.col("g"), F.col("b"), F.col("l")), F.col("l")))
    white, black = order_statistics(grey, by, "paper", {"white": 0.85}), order_statistics(grey, by, "l", {"black": 0.02})
    df = df.join(white.join(black, by), by, "left")
    usable = F.col("white") > F.col("black") + 0.05
    stretch = lambda c: F.when(usable, (F.col(c) - F.col("black")) * 0.94 / (F.col("white") - F.col("black")) + 0.02).otherwise(F.col(c))
    df = df.withColumns({c: stretch(c) for c in "rgb"}).drop("white", "black")
    return sharpen(df, by, 0.75, max(1, min(3, min(width, height) // 900)))
