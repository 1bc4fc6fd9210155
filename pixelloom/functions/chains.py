"""Chains of points as arrays of structs (x, y): lengths, points by arc length, and surfaces between four sides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def segment_lengths(chain: Column) -> Column:
    n = F.size(chain)

    def length(i: Column) -> Column:
        a, b = F.get(chain, i), F.get(chain, i + 1)
        return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))

    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), length)).otherwise(F.array().cast("array<double>"))


def chain_length(chain: Column) -> Column:
    return F.aggregate(segment_lengths(chain), F.lit(0.0), lambda a, x: a + x)


def chain_sagitta(chain: Column) -> Column:
    """The greatest distance of a point from the chord."""

    def of(ends: Column) -> Column:
        a, b = ends["a"], ends["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = F.sqrt(dx * dx + dy * dy)
        off = lambda p: F.when(length < 1e-6, F.sqrt((p["x"] - a["x"]) * (p["x"] - a["x"]) + (p["y"] - a["y"]) * (p["y"] - a["y"]))).otherwise(F.abs((p["x"] - a["x"]) * dy - (p["y"] - a["y"]) * dx) / length)
        return F.array_max(F.transform(chain, off))

    return _bind(F.struct(F.get(chain, F.lit(0)).alias("a"), F.element_at(chain, -1).alias("b")), of)


def arc_at(chain: Column, t: Column) -> Column:
    """The point at a fraction of the arc length: a lower bound on the running lengths, then a step into the segment."""

    def found(lengths: Column) -> Column:
        total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
        goal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * total
        start = F.struct(F.lit(0).alias("i"), goal.alias("rest"), F.lit(False).alias("done"))

        def walk(s: Column, length: Column) -> Column:
            stop = s["done"] | (s["rest"] <= length)
            return F.struct(F.when(stop, s["i"]).otherwise(s["i"] + 1).alias("i"), F.when(stop, s["rest"]).otherwise(s["rest"] - length).alias("rest"), stop.alias("done"))

        def point(s: Column) -> Column:
            i = F.least(s["i"], F.size(lengths) - 1)
            a, b, length = F.get(chain, i), F.get(chain, i + 1), F.get(lengths, i)
            f = F.when(length > 1e-9, F.least(F.lit(1.0), s["rest"] / length)).otherwise(0.0)
            return F.struct((a["x"] + f * (b["x"] - a["x"])).alias("x"), (a["y"] + f * (b["y"] - a["y"])).alias("y"))

        return F.when(F.size(lengths) > 0, _bind(F.aggregate(lengths, start, walk), point)).otherwise(F.get(chain, F.lit(0)))

    return _bind(segment_lengths(chain), found)


def coons_point(top: Column, right: Column, bottom: Column, left: Column, s: Column, t: Column) -> Column:
    """The surface between four sides at (s, t): both ruled surfaces less the bilinear one. top and bottom run left to
    right, left and right top to bottom; the sides meet in the corners."""
    c, d, a, b = arc_at(top, s), arc_at(bottom, s), arc_at(left, t), arc_at(right, t)
    tl, tr, bl, br = F.get(top, F.lit(0)), F.element_at(top, -1), F.get(bottom, F.lit(0)), F.element_at(bottom, -1)
    corner = lambda k: (1 - s) * (1 - t) * tl[k] + s * (1 - t) * tr[k] + (1 - s) * t * bl[k] + s * t * br[k]
    along = lambda k: (1 - t) * c[k] + t * d[k] + (1 - s) * a[k] + s * b[k] - corner(k)
    return F.struct(along("x").alias("x"), along("y").alias("y"))


def rotated_to(chain: Column, at: Column) -> Column:
    """A closed chain that begins at index ``at``."""
    return F.concat(F.slice(chain, at + 1, F.size(chain) - at), F.slice(chain, F.lit(1), at))


def oriented(chain: Column, x: Column, y: Column) -> Column:
    """The chain, reversed if its end is nearer to (x, y) than its start."""
    d = lambda p: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)
    return F.when(d(F.element_at(chain, -1)) < d(F.get(chain, F.lit(0))), F.reverse(chain)).otherwise(chain)


def thinned(chain: Column, most: int = 180) -> Column:
    """At most about ``most`` points, evenly by index, the last one kept."""
    step = F.greatest(F.lit(1), F.ceil(F.size(chain) / most).cast("int"))
    return F.filter(chain, lambda p, i: (i % step == 0) | (i == F.size(chain) - 1))
