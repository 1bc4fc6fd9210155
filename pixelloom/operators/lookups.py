"""Resampling: pixels looked up by computed coordinates, as equi-joins on (image, y, x) and sums of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import color as C


def block_mean(df: DataFrame, by: list[str], values: list[str], factor: int, width: Column, height: Column) -> DataFrame:
    """Means of factor x factor blocks; what doesn't fill a block at the right and bottom is dropped."""
    inside = df.where((F.col("x") < F.floor(width / factor) * factor) & (F.col("y") < F.floor(height / factor) * factor))
    return inside.groupBy(*by, F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(*(F.avg(v).alias(v) for v in values))


def downsample_factor(width: int, height: int, largest: int) -> int:
    """The least power of two by which whole division brings both sides to at most ``largest``."""
    factor = 1
    while max(width, height) // factor > largest:
        factor *= 2
        if factor > 1024:
            raise ValueError("the image is too large for any factor")
    return factor


def area_resample(df: DataFrame, by: list[str], values: list[str], size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Means of the source pixels of each of ``to`` = (height, width) cells; cell c has pixels floor(c n / m) .. floor((c + 1) n / m) - 1."""
    (h, w), (oh, ow) = size, to
    cell = lambda at, n, m: F.floor(((F.col(at) + 1) * m - 1) / n)
    return df.groupBy(*by, cell("y", h, oh).alias("y"), cell("x", w, ow).alias("x")).agg(*(F.avg(v).alias(v) for v in values))


def _joined(points: DataFrame, df: DataFrame, by: list[str], values: list[str], taps: DataFrame, keys: list[str]) -> DataFrame:
    source = df.select(*by, F.col("y").alias("_ty"), F.col("x").alias("_tx"), *(F.col(v).alias(f"_s_{v}") for v in values))
    return taps.join(source, [*by, "_ty", "_tx"]).groupBy(*by, *keys).agg(*(F.sum(F.col("_w") * F.col(f"_s_{v}")).alias(v) for v in values))


def _taps(points: DataFrame, offsets: list[int], weight, width: Column, height: Column) -> DataFrame:
    """Explodes each point (u, v) into the pixels around it with the products of their weights; coordinates clamp to the edge."""
    spots = points.withColumns({"_bx": F.floor("u"), "_by": F.floor("v")}).withColumns({"_fx": F.col("u") - F.col("_bx"), "_fy": F.col("v") - F.col("_by")})
    tap = lambda dy, dx: F.struct(
        C.clampf(F.col("_by") + dy, F.lit(0), height - 1).cast("long").alias("_ty"),
        C.clampf(F.col("_bx") + dx, F.lit(0), width - 1).cast("long").alias("_tx"),
        (weight(F.col("_fx"), dx) * weight(F.col("_fy"), dy)).alias("_w"),
    )
    exploded = spots.withColumn("_t", F.explode(F.array(*(tap(dy, dx) for dy in offsets for dx in offsets))))
    return exploded.select("*", "_t._ty", "_t._tx", "_t._w").drop("_t", "_bx", "_by", "_fx", "_fy")


def bilinear(df: DataFrame, points: DataFrame, by: list[str], keys: list[str], values: list[str], width: int, height: int) -> DataFrame:
    """Samples at points (by, keys, u, v), which are clamped into the image."""
    inside = points.withColumns({"u": C.clampf(F.col("u"), 0.0, width - 1.01), "v": C.clampf(F.col("v"), 0.0, height - 1.01)})
    weight = lambda f, d: f if d else 1.0 - f
    return _joined(points, df, by, values, _taps(inside, [0, 1], weight, F.lit(width), F.lit(height)), keys)


def bicubic(df: DataFrame, points: DataFrame, by: list[str], keys: list[str], values: list[str], width: int, height: int) -> DataFrame:
    """Samples by 4 x 4 Catmull-Rom weights, the edge pixel repeats."""
    weight = lambda f, d: C.cubic_weight(f - d)
    return _joined(points, df, by, values, _taps(points, [-1, 0, 1, 2], weight, F.lit(width), F.lit(height)), keys)


def nearest(df: DataFrame, points: DataFrame, by: list[str], values: list[str], width: int, height: int) -> DataFrame:
    at = points.withColumns({"_ty": C.clampf(F.floor(F.col("v") + 0.5), 0.0, height - 1.0).cast("long"), "_tx": C.clampf(F.floor(F.col("u") + 0.5), 0.0, width - 1.0).cast("long")})
    source = df.select(*by, F.col("y").alias("_ty"), F.col("x").alias("_tx"), *values)
    return at.join(source, [*by, "_ty", "_tx"]).drop("_ty", "_tx")


def homography(q: list[tuple[Column, Column]]) -> list[Column]:
    """Coefficients a .. h of the map from the unit square's corners (0,0) (1,0) (1,1) (0,1) to a quad, in closed form."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = q
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dx2, dy1, dy2 = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    det = dx1 * dy2 - dx2 * dy1
    det = F.when(F.abs(det) >= 1e-12, det)
    g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
    return [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h]


def warp_grid(headers: DataFrame, by: list[str], quad: list[tuple[Column, Column]], ow: int, oh: int) -> DataFrame:
    """The source points (u, v) of an oh x ow grid whose corners are a quad's: (by, y, x, u, v)."""
    at = headers.select(*by, F.struct(*(c.alias(n) for n, c in zip("abcdefgh", homography(quad)))).alias("m")).where("m.g is not null")
    grid = at.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(oh - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(ow - 1))))
    s, t = F.col("x") / float(max(1, ow - 1)), F.col("y") / float(max(1, oh - 1))
    m = lambda n: F.col(f"m.{n}")
    den = m("g") * s + m("h") * t + 1.0
    den = F.when(F.abs(den) >= 1e-9, den)
    return grid.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), ((m("a") * s + m("b") * t + m("c")) / den).alias("u"), ((m("d") * s + m("e") * t + m("f")) / den).alias("v")).where("u is not null and v is not null")


def reflect(i: Column, n: int) -> Column:
    """An index mirrored at both borders without repeating them."""
    if n == 1:
        return i * 0
    around = F.pmod(i, F.lit(2 * (n - 1)))
    return F.least(around, 2 * (n - 1) - around)


def tiles(df: DataFrame, by: list[str], core: int, halo: int, width: int, height: int) -> DataFrame:
    """Each pixel in all tiles that see it, mirrored at the borders: (.., ty, tx, ly, lx); ly and lx are local, the core begins at ``halo``."""
    span = core + 2 * halo

    def spots(axis: str, n: int) -> Column:
        """(tile, local) of a coordinate: itself and its mirror images, in every tile whose span holds them."""
        at = F.col(axis)
        images = [at, -at, 2 * (n - 1) - at]
        many = -(-n // core)
        hits = [F.struct(F.lit(t).alias("t"), (p - (t * core - halo)).cast("int").alias("l")) for t in range(many) for p in images]
        return F.array_distinct(F.filter(F.array(*hits), lambda s: (s["l"] >= 0) & (s["l"] < span)))

    out = df.withColumn("_sy", F.explode(spots("y", height))).withColumn("_sx", F.explode(spots("x", width)))
    return out.select(*df.columns, F.col("_sy.t").alias("ty"), F.col("_sx.t").alias("tx"), F.col("_sy.l").alias("ly"), F.col("_sx.l").alias("lx"))


def stitch(tiled: DataFrame, by: list[str], core: int, halo: int, width: int, height: int, values: list[str]) -> DataFrame:
    """The cores of tiles, put together again."""
    at = lambda t, local: (F.col(t) * core + F.col(local) - halo).cast("long")
    own = tiled.where(F.col("ly").between(halo, halo + core - 1) & F.col("lx").between(halo, halo + core - 1))
    out = own.select(*by, at("ty", "ly").alias("y"), at("tx", "lx").alias("x"), *values)
    return out.where((F.col("y") < height) & (F.col("x") < width))
