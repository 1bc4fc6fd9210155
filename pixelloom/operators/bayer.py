"""Sensor mosaics: packing into planes, demosaicing, development."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions import color as C


def pack_rggb(mosaic: DataFrame, by: list[str], black: float = 64.0, white: float = 1023.0) -> DataFrame:
    """2 x 2 cells as planes r, g1 (red rows), g2 (blue rows), b with one clip bit each, in this order from bit 0."""
    kind = C.cell_colour(F.col("cfa"), F.col("y"), F.col("x"))
    level = C.normalised(F.col("raw"), F.lit(black), white)
    cells = mosaic.select(*by, F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx"), kind.alias("k"), level.alias("v"), (F.col("raw") >= white - 0.5).alias("clipped"))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    planes = [pick(k, "v").alias(n) for k, n in enumerate(("r", "g1", "g2", "b"))]
    bits = sum((pick(k, "clipped").cast("int") * (1 << k) for k in range(4)), F.lit(0))
    return cells.groupBy(*by, "cy", "cx").agg(*planes, bits.cast("long").alias("clip"))


def _stencil(by: list[str], value: str, df: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """The 5 x 5 neighbourhood by two windows: rows first, as arrays of five, then columns. Edges clamp."""
    row, col = W.partitionBy(*by, "y").orderBy("x"), W.partitionBy(*by, "x").orderBy("y")
    full = lambda w: w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lag = lambda c, w, k: F.coalesce((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w), (F.first(c) if k < 0 else F.last(c)).over(full(w))) if k else F.col(c)
    df = df.withColumn("_row", F.array(*(lag(value, row, k) for k in range(-2, 3))))
    df = df.withColumns({f"_r{k + 2}": lag("_row", col, k) for k in range(-2, 3)})
    return df, {(dy, dx): F.col(f"_r{dy + 2}")[dx + 2] for dy in range(-2, 3) for dx in range(-2, 3)}


# The 5 x 5 filters of gradient-corrected linear demosaicing (Malvar, He and Cutler 2004), in eighths.
# The colour missing at a site: green at red and blue; red or blue at green, along its rows; at the opposite colour.
TO_GREEN = [
    [0, 0, -1, 0, 0],
    [0, 0, 2, 0, 0],
    [-1, 2, 4, 2, -1],
    [0, 0, 2, 0, 0],
    [0, 0, -1, 0, 0],
]
ALONG_ROW = [
    [0, 0, 0.5, 0, 0],
    [0, -1, 0, -1, 0],
    [-1, 4, 5, 4, -1],
    [0, -1, 0, -1, 0],
    [0, 0, 0.5, 0, 0],
]
OPPOSITE = [
    [0, 0, -1.5, 0, 0],
    [0, 2, 0, 2, 0],
    [-1.5, 0, 6, 0, -1.5],
    [0, 2, 0, 2, 0],
    [0, 0, -1.5, 0, 0],
]
ALONG_COLUMN = [list(line) for line in zip(*ALONG_ROW)]


def _filtered(at: dict[tuple[int, int], Column], weights: list[list[float]]) -> Column:
    """The weighted sum of a neighbourhood."""
    terms = [at[dy - 2, dx - 2] * float(w) for dy, line in enumerate(weights) for dx, w in enumerate(line) if w]
    return sum(terms[1:], terms[0]) / 8.0


def malvar(mosaic: DataFrame, by: list[str], level: str = "level") -> DataFrame:
    """Linear 5 x 5 demosaic: adds r, g and b at every position. Columns: by, y, x, cfa and the level."""
    df, at = _stencil(by, level, mosaic)
    c = at[0, 0]
    green, across, down, diagonal = (_filtered(at, w) for w in (TO_GREEN, ALONG_ROW, ALONG_COLUMN, OPPOSITE))
    kind = C.cell_colour(F.col("cfa"), F.col("y"), F.col("x"))
    of = lambda values: F.when(kind == 0, values[0]).when(kind == 1, values[1]).when(kind == 2, values[2]).otherwise(values[3])
    rgb = {"r": of([c, across, down, diagonal]), "g": of([green, c, c, green]), "b": of([diagonal, down, across, c])}
    return df.withColumns(rgb).drop("_row", *(f"_r{k}" for k in range(5)))


def develop(mosaic: DataFrame, by: list[str], neutral: tuple[float, float, float], ccm: tuple[float, ...], black: float = 64.0, white: float = 1023.0, exposure: float = 0.0) -> DataFrame:
    """Normalise, demosaic, balance, mend highlights, camera matrix, exposure: linear r, g, b, open at the top."""
    levels = mosaic.withColumn("level", C.normalised(F.col("raw"), F.lit(black), white))
    full = malvar(levels, by).drop("level")
    gains = [1.0 / n if min(neutral) > 1e-6 else 1.0 for n in neutral]
    pre = [F.col(c) for c in "rgb"]
    mended = C.highlight_knee(pre, [v * g for v, g in zip(pre, gains)])
    full = full.withColumns(dict(zip(("_r", "_g", "_b"), mended)))
    out = C.mat3_apply(ccm, F.col("_r"), F.col("_g"), F.col("_b"))
    return full.withColumns({c: F.greatest(v, F.lit(0.0)) * 2.0**exposure for c, v in zip("rgb", out)}).drop("_r", "_g", "_b")


def symmetries(cells: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """The four orientations of packed cells that keep the colour order: identity, transpose, half turn, transposed half turn."""
    turn = lambda c, n: (n - 1 - F.col(c)).alias(c)
    keep = [F.col(c) for c in cells.columns if c not in (*by, "cy", "cx", "r", "g1", "g2", "b")]
    same = cells.select(*by, "cy", "cx", "r", "g1", "g2", "b", *keep, F.lit(0).alias("symmetry"))
    transposed = cells.select(*by, F.col("cx").alias("cy"), F.col("cy").alias("cx"), "r", F.col("g2").alias("g1"), F.col("g1").alias("g2"), "b", *keep, F.lit(1).alias("symmetry"))
    half = cells.select(*by, turn("cy", height), turn("cx", width), F.col("b").alias("r"), F.col("g2").alias("g1"), F.col("g1").alias("g2"), F.col("r").alias("b"), *keep, F.lit(2).alias("symmetry"))
    both = cells.select(*by, (width - 1 - F.col("cx")).alias("cy"), (height - 1 - F.col("cy")).alias("cx"), F.col("b").alias("r"), "g1", "g2", F.col("r").alias("b"), *keep, F.lit(3).alias("symmetry"))
    return same.unionByName(transposed).unionByName(half).unionByName(both)


def symmetries_undone(cells: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Means and variances of each channel over the orientations, at the first one's positions."""
    s = F.col("symmetry")
    cy = F.when(s == 0, F.col("cy")).when(s == 1, F.col("cx")).when(s == 2, height - 1 - F.col("cy")).otherwise(height - 1 - F.col("cx"))
    cx = F.when(s == 0, F.col("cx")).when(s == 1, F.col("cy")).when(s == 2, width - 1 - F.col("cx")).otherwise(width - 1 - F.col("cy"))
    swap = s >= 2
    r, b = F.when(swap, F.col("b")).otherwise(F.col("r")), F.when(swap, F.col("r")).otherwise(F.col("b"))
    g1 = F.when(s.isin(1, 2), F.col("g2")).otherwise(F.col("g1"))
    back = cells.select(*by, cy.alias("cy"), cx.alias("cx"), r.alias("r"), g1.alias("g"), b.alias("b"))
    figures = [f for c in "rgb" for f in (F.avg(c).alias(c), F.greatest(F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c), F.lit(0.0)).alias(f"var_{c}"))]
    return back.groupBy(*by, "cy", "cx").agg(*figures)
