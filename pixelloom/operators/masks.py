"""Masks against lines and quads, profiles, and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions import geometry as G


def boundaries(mask: DataFrame, by: list[str], axis: str = "x") -> DataFrame:
    """First and last mask pixel along an axis, for each line across it."""
    line = "y" if axis == "x" else "x"
    return mask.groupBy(*by, F.col(line).alias("line")).agg(F.min(axis).alias("first"), F.max(axis).alias("last"))


def ink_profile(mask: DataFrame, by: list[str], axis: str = "y", share: float = 0.4) -> DataFrame:
    """(by, first, last, most): the outer lines with at least ``share`` of the fullest line's pixels."""
    counts = mask.groupBy(*by, F.col(axis).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    full = counts.withColumn("most", F.max("n").over(W.partitionBy(*by))).where(F.col("n") >= share * F.col("most"))
    return full.groupBy(*by).agg(F.min("line").alias("first"), F.max("line").alias("last"), F.first("most").alias("most"))


def quad_overlap(pixels: DataFrame, quads: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Share of the mask that lies in a quad, and of the quad that the mask fills. quads: (by, q), one each."""
    inside = G.inside_convex(F.col("x").cast("double"), F.col("y").cast("double"), G.quad_points(F.col("q")))
    both = pixels.join(quads, by).select(*by, F.col(flag).alias("m"), inside.alias("in"))
    hit = F.count_if(F.col("m") & F.col("in")).cast("double")
    return both.groupBy(*by).agg((hit / F.greatest(F.count_if("m"), F.lit(1))).alias("mask_inside"), (hit / F.greatest(F.count_if("in"), F.lit(1))).alias("quad_filled"))


def edge_inliers(contour: DataFrame, quads: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Share of contour points within ``tolerance`` of the nearest side."""
    p = G.quad_points(F.col("q"))
    at = (F.col("x").cast("double"), F.col("y").cast("double"))

    def side(a, b) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((at[0] - a[0]) * dx + (at[1] - a[1]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9))))
        return G.dist(at, (a[0] + t * dx, a[1] + t * dy))

    near = F.least(*(side(p[i], p[(i + 1) % 4]) for i in range(4))) <= tolerance
    return contour.join(quads, by).groupBy(*by).agg(F.avg(near.cast("double")).alias("inliers"), F.count(F.lit(1)).alias("n"))


def fit_lines(points: DataFrame, by: list[str], order: list[str], samples: int = 12, tolerance: float = 2.0) -> DataFrame:
    """The line through the most points of each group: pairs of every n/12-th point are tried, the first of the best is
    refitted to its inliers by principal axes. At most 66 pairs a group meet its points."""
    ranked = points.withColumns({"_i": F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*by))})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / samples))
    few = ranked.where((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < samples))
    # The bounded list of samples is paired within its row.
    listed = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("s"))
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["_i"] > a["_i"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    tried = listed.select(*by, F.posexplode(pair).alias("k", "p"))
    away = G.perp_dist((F.col("x").cast("double"), F.col("y").cast("double")), (F.col("p.a.x"), F.col("p.a.y")), (F.col("p.b.x"), F.col("p.b.y")))
    scored = points.join(tried, by).where(away <= tolerance).groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), *(F.avg(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in ("xx", "xy", "yy"))
    )
    best = scored.groupBy(*by).agg(F.max(F.struct("n", (-F.col("k")).alias("back"), "cx", "cy", "mxx", "mxy", "myy")).alias("m")).select(*by, "m.*")
    sxx, sxy, syy = F.col("mxx") - F.col("cx") * F.col("cx"), F.col("mxy") - F.col("cx") * F.col("cy"), F.col("myy") - F.col("cy") * F.col("cy")
    angle = 0.5 * F.atan2(2.0 * sxy, sxx - syy)
    return best.select(*by, "n", "cx", "cy", F.cos(angle).alias("dx"), F.sin(angle).alias("dy"))


def crease(df: DataFrame, by: list[str], value: str, axis: str = "y") -> DataFrame:
    """The line of the strongest mean gradient across an axis, its strength, the median strength, and the share of pixels that agree in sign."""
    other = "x" if axis == "y" else "y"
    step = F.col(value) - F.lag(value).over(W.partitionBy(*by, other).orderBy(axis))
    g = df.select(*by, F.col(axis).alias("line"), step.alias("g")).where("g is not null")
    lines = g.groupBy(*by, "line").agg(F.avg("g").alias("mean"), F.count_if(F.col("g") > 0).alias("up"), F.count_if(F.col("g") < 0).alias("down"), F.count(F.lit(1)).alias("n"))
    s = F.struct(F.abs("mean").alias("strength"), (-F.col("line")).alias("back"), (F.when(F.col("mean") > 0, F.col("up")).otherwise(F.col("down")) / F.col("n")).alias("agree"))
    ranked = lines.withColumns({"_i": F.row_number().over(W.partitionBy(*by).orderBy(F.abs("mean"))) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*by))})
    out = ranked.groupBy(*by).agg(F.max(s).alias("m"), F.min(F.when(F.col("_i") >= F.floor(0.5 * (F.col("_n") - 1)), F.abs("mean"))).alias("median"))
    return out.select(*by, (-F.col("m.back")).alias("line"), "m.strength", "median", "m.agree")


def heatmap_peak(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The first greatest cell of each heat map, and the softmax centroid of the 3 x 3 cells about it."""
    best = df.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("m")).select(*by, F.col("m.v").alias("peak"), (-F.col("m.ny")).alias("py"), (-F.col("m.nx")).alias("px"))
    near = df.join(best, by).where(F.col("y").between(F.col("py") - 1, F.col("py") + 1) & F.col("x").between(F.col("px") - 1, F.col("px") + 1))
    w = F.exp(F.col(value) - F.col("peak"))
    return near.groupBy(*by, "peak", "py", "px").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"))


def first_vote(df: DataFrame, by: list[str], order: str, flag: str, window: int, inward: float = 0.6, outward: float = 0.4) -> DataFrame:
    """The first position whose next ``window`` flags are mostly set and whose last ones mostly aren't."""
    o = W.partitionBy(*by).orderBy(order)
    hit = F.col(flag).cast("double")
    voted = df.withColumns({"_in": F.avg(hit).over(o.rowsBetween(0, window - 1)), "_out": F.avg(hit).over(o.rowsBetween(-window, -1))})
    return voted.where((F.col("_in") >= inward) & (F.col("_out") <= outward)).groupBy(*by).agg(F.min(order).alias("at"))


def patch_energy(df: DataFrame, by: list[str], value: str, rows: int, columns: int, height: int, width: int) -> DataFrame:
    """Mean |2c - l - r| of each cell of a fixed grid over the image."""
    line = W.partitionBy(*by, "y").orderBy("x")
    e = F.abs(2.0 * F.col(value) - F.lag(value).over(line) - F.lead(value).over(line))
    cell = df.select(*by, F.floor(F.col("y") * rows / height).alias("row"), F.floor(F.col("x") * columns / width).alias("column"), e.alias("e")).where("e is not null")
    return cell.groupBy(*by, "row", "column").agg(F.avg("e").alias("energy"))
