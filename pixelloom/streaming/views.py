"""View state and gestures over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.functions.color import clampf
from pixelloom.functions.geometry import fit_scale

MOST_ZOOM, DOUBLE_TAP_S = 32.0, 0.35


def _clamped(scale: Column, ox: Column, oy: Column, w: Column, h: Column, vw: Column, vh: Column) -> Column:
    """Scale within fit .. 32 x fit; an image smaller than the view is centred, a larger one covers it."""
    fit = fit_scale(w, h, vw, vh)
    s = clampf(scale, fit, fit * MOST_ZOOM)

    def place(o: Column, n: Column, v: Column) -> Column:
        size = n * s
        return F.when(size <= v, (v - size) / 2.0).otherwise(clampf(o, v - size, 0.0))

    return F.struct(s.alias("scale"), place(ox, w, vw).alias("ox"), place(oy, h, vh).alias("oy"))


def view_states(events: DataFrame, by: list[str], order: list[str], image: tuple[float, float], view: tuple[float, float]) -> DataFrame:
    """Folds (op, a, b, c) events per group: pan (a, b), zoom by c about (a, b), toggle between fit and 1:1 about (a, b).

    (by, n, scale, ox, oy) after all events. A group's events are one array, so it is for bounded sessions."""
    w, h, vw, vh = (F.lit(float(v)) for v in (*image, *view))
    item = F.struct(*order, "op", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), F.col("c").cast("double").alias("c"))
    held = events.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    fit = fit_scale(w, h, vw, vh)
    start = _clamped(fit, F.lit(0.0), F.lit(0.0), w, h, vw, vh)

    def zoom(s: Column, cx: Column, cy: Column, to: Column) -> Column:
        target = clampf(to, fit, fit * MOST_ZOOM)
        ratio = target / s["scale"]
        return _clamped(target, cx - (cx - s["ox"]) * ratio, cy - (cy - s["oy"]) * ratio, w, h, vw, vh)

    def step(s: Column, e: Column) -> Column:
        panned = _clamped(s["scale"], s["ox"] + e["a"], s["oy"] + e["b"], w, h, vw, vh)
        zoomed = zoom(s, e["a"], e["b"], s["scale"] * e["c"])
        fitted = F.abs(s["scale"] - fit) <= 1e-4 * fit
        toggled = F.when(fitted, zoom(s, e["a"], e["b"], F.lit(1.0))).otherwise(start)
        return F.when(e["op"] == "pan", panned).when((e["op"] == "zoom") & (e["c"] > 0), zoomed).when(e["op"] == "toggle", toggled).otherwise(s)

    return held.select(*by, F.size("items").cast("long").alias("n"), F.aggregate("items", start, step).alias("s")).select(*by, "n", "s.scale", "s.ox", "s.oy")


def double_taps(taps: DataFrame, by: list[str], ts: str, gap: float = DOUBLE_TAP_S) -> DataFrame:
    """Taps that follow the one before within ``gap`` seconds."""
    order = W.partitionBy(*by).orderBy(ts)
    since = (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(order))) / 1e6
    return taps.withColumn("since", since).where(F.col("since") <= gap)
