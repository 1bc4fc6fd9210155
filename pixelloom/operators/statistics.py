"""Order statistics, histograms and other aggregates of pixel relations.

Groups are images (or any columns); nothing collects an image into one task unless its docstring says so. Order
statistics take the element at floor(f (n - 1)) of the sorted values, without interpolation. They are found by
counting: values are grouped, counts are summed in order, and the value whose run covers the index is taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions import color as C

BINS, BIN_LOW_EV, BINS_PER_EV = 256, -16.0, 8.0


def order_statistics(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """One row per group with the order statistic at each fraction, for groups whose distinct values fit one task's sort."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(*by).orderBy("_v")
    ranked = counts.withColumns({"_to": F.sum("_n").over(run), "_all": F.sum("_n").over(W.partitionBy(*by))})
    at = lambda f: F.floor(F.lit(f) * (F.col("_all") - 1))
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("_to") > at(f), F.col("_v"))).alias(name) for name, f in fractions.items()))


def luma_histogram(df: DataFrame, by: list[str], level: Column, stride: int = 1) -> DataFrame:
    """Counts of eighths of a stop from -16 EV, over every ``stride``-th pixel each way. Levels of 0 or below don't count."""
    taken = df.where((F.pmod("x", F.lit(stride)) == 0) & (F.pmod("y", F.lit(stride)) == 0)).withColumn("_l", level).where(C.positive(F.col("_l")))
    bin_ = C.clampf(((F.log2("_l") - BIN_LOW_EV) * BINS_PER_EV), 0.0, BINS - 1.0).cast("long")
    return taken.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def auto_exposure(histogram: DataFrame, by: list[str], intensity: float = 1000.0) -> DataFrame:
    """(ev, white) of each group from its luma histogram, for images that exceed the display's range."""
    anchor = max(-4.0, min(4.0, math.log2(intensity / C.DIFFUSE_WHITE_NITS if intensity > 0 else 1.0)))
    summed = histogram.withColumns({"_seen": F.sum("n").over(W.partitionBy(*by).orderBy("bin")), "_all": F.sum("n").over(W.partitionBy(*by))})
    level = lambda f: F.pow(F.lit(2.0), F.min(F.when(F.col("_seen") >= F.floor(F.lit(f) * F.col("_all")), F.col("bin"))) / BINS_PER_EV + BIN_LOW_EV)
    marks = summed.groupBy(*by).agg(level(0.995).alias("p995"), level(0.9999).alias("p9999"))
    pulled = C.clampf(-F.log2(F.greatest("p995", F.lit(1e-4))) - anchor, -2.0, 2.0) * 0.5
    out = marks.withColumn("ev", C.clampf(F.lit(anchor) + pulled, -8.0, 8.0))
    return out.withColumn("white", C.clampf(F.col("p9999") * F.pow(F.lit(2.0), F.col("ev")), 1.0, 16.0))


def otsu(df: DataFrame, by: list[str], byte: str) -> DataFrame:
    """The threshold of a byte column with the greatest between-class variance; the lowest of equals."""
    counts = df.groupBy(*by, F.col(byte).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    upto, all_ = W.partitionBy(*by).orderBy("t"), W.partitionBy(*by)
    sums = counts.withColumns(
        {"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("t")).over(upto), "w": F.sum("n").over(all_), "s": F.sum(F.col("n") * F.col("t")).over(all_)}
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    scored = sums.withColumn("between", F.when(w1 > 0, F.col("w0") * w1 * gap * gap).otherwise(0.0))
    return scored.groupBy(*by).agg(F.max(F.struct("between", (-F.col("t")).alias("back"))).alias("m")).select(*by, (-F.col("m.back")).alias("threshold"), F.col("m.between").alias("between"))


def trimmed_mean(df: DataFrame, by: list[str], value: str, trim: float = 0.05) -> DataFrame:
    """Mean without the share ``trim`` of rows at either end; equal values at a bound are split by count, not by row."""
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counts.withColumns({"_to": F.sum("_n").over(W.partitionBy(*by).orderBy("_v")), "_all": F.sum("_n").over(W.partitionBy(*by))})
    cut = F.floor(F.col("_all") * trim)
    inside = F.greatest(F.least(F.col("_to"), F.col("_all") - cut) - F.greatest(F.col("_to") - F.col("_n"), cut), F.lit(0))
    return ranked.withColumn("_k", inside).groupBy(*by).agg((F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("mean"))


def channel_statistics(df: DataFrame, by: list[str]) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    figures = [f(c).alias(f"{name}_{c}") for c in "rgb" for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return df.groupBy(*by).agg(*figures, F.avg(F.abs(r - b)).alias("red_blue"), F.avg(F.abs(g - (r + b) / 2)).alias("green_magenta"))


def clip_census(mosaic: DataFrame, by: list[str], white: float = 1023.0) -> DataFrame:
    """Clipped and all samples of each mosaic colour."""
    colour = C.cfa_colour(F.col("cfa"), F.col("y"), F.col("x"))
    return mosaic.groupBy(*by, colour.alias("colour")).agg(F.count_if(F.col("raw") >= white - 0.5).alias("clipped"), F.count(F.lit(1)).alias("total"))


def bounding_box(mask: DataFrame, by: list[str]) -> DataFrame:
    return mask.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))


def colour_centroids(df: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Centroids of each colour's bright pixels and their distance from the green one's. df has a column ``colour``."""
    centres = df.where(F.col("level") >= least).groupBy(*by, "colour").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    green = centres.where("colour = 1").select(*by, F.col("cx").alias("gx"), F.col("cy").alias("gy"))
    return centres.join(green, by).select(*by, "colour", "n", (F.col("cx") - F.col("gx")).alias("dx"), (F.col("cy") - F.col("gy")).alias("dy"))


def ring_statistics(df: DataFrame, centres: DataFrame, by: list[str], rings: list[tuple[float, float]]) -> DataFrame:
    """Means of R/G and B/G in rings about a centre (cx, cy) per group, of pixels with G above 0.01."""
    d = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    ring = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(rings))):
        ring = F.when((d >= lo) & (d < hi), i).otherwise(ring)
    placed = df.join(centres, by).where("g > 0.01").withColumn("ring", ring).where("ring is not null")
    return placed.groupBy(*by, "ring").agg(F.avg(F.col("r") / F.col("g")).alias("rg"), F.avg(F.col("b") / F.col("g")).alias("bg"), F.count(F.lit(1)).alias("n"))


def ensemble_moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    mean, square = F.avg(value), F.avg(F.col(value) * F.col(value))
    return df.groupBy(*by).agg(mean.alias("mean"), F.greatest(square - mean * mean, F.lit(0.0)).alias("variance"))


def paper_balance(df: DataFrame, by: list[str], least: int = 16) -> DataFrame:
    """Channel gains that make the brighter 40 % of near-grey pixels neutral: clamp(mean / channel, 0.5, 2)."""
    level = C.luma(F.col("r"), F.col("g"), F.col("b"))
    grey = df.withColumn("_l", level).where((F.col("_l") > 0.05) & C.low_chroma(F.col("r"), F.col("g"), F.col("b"), F.col("_l")))
    cuts = order_statistics(grey, by, "_l", {"_cut": 0.6})
    means = grey.join(cuts, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.when(F.col("_l") >= F.col("_cut"), F.col(c))).alias(f"m{c}") for c in "rgb")).where(F.col("n") >= least)
    mean = (F.col("mr") + F.col("mg") + F.col("mb")) / 3.0
    return means.select(*by, "n", *(C.clampf(mean / F.greatest(F.col(f"m{c}"), F.lit(1e-4)), 0.5, 2.0).alias(f"gain_{c}") for c in "rgb"))
