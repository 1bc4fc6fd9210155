"""Line voting and quads of lines on edge pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.operators import finder
from pixelloom.session import ship

#: Families of angles in degrees of the normal: horizontal lines, and vertical ones from either side of 0.
HORIZONTAL, VERTICAL = range(45, 136), [*range(0, 45), *range(136, 180)]


def _trig(theta: Column) -> tuple[Column, Column]:
    radians = theta.cast("double") * (math.pi / 180.0)
    return F.cos(radians), F.sin(radians)


def hough_votes(edges: DataFrame, by: list[str], thetas) -> DataFrame:
    """Votes of edge pixels (by, y, x) for (theta, rho): one row per angle and pixel before the partial count, never more."""
    angle = F.explode(F.array(*map(F.lit, thetas)))
    spread = edges.select(*by, "y", "x", angle.alias("theta"))
    c, s = _trig(F.col("theta"))
    rho = F.floor(F.round(F.col("x") * c + F.col("y") * s, 6) + 0.5)
    return spread.groupBy(*by, "theta", rho.alias("rho")).agg(F.count(F.lit(1)).alias("votes"))


def peaks(votes: DataFrame, by: list[str], least: int) -> DataFrame:
    """Cells that no other exceeds within one degree and two pixels: each cell offers its votes to its 15 neighbours.

    Cells of fewer than ``least`` votes neither are peaks nor exceed one, so they offer nothing."""
    votes = votes.where(F.col("votes") >= least)
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-2, -1, 0, 1, 2)))
    offered = votes.select(*by, F.explode(around).alias("o"), "theta", "rho", "votes").select(*by, (F.col("theta") + F.col("o.a")).alias("theta"), (F.col("rho") + F.col("o.b")).alias("rho"), "votes", ((F.col("o.a") == 0) & (F.col("o.b") == 0)).alias("own"))
    best = offered.groupBy(*by, "theta", "rho").agg(F.max("votes").alias("most"), F.max(F.when(F.col("own"), F.col("votes"))).alias("votes"))
    return best.where((F.col("votes") == F.col("most")) & (F.col("votes") >= least)).select(*by, "theta", "rho", "votes")


def strongest(lines: DataFrame, by: list[str], count: int = 12) -> DataFrame:
    """The first lines of each group by votes, then angle, then distance, numbered from 1."""
    order = W.partitionBy(*by).orderBy(F.desc("votes"), "theta", "rho")
    return lines.withColumn("id", F.row_number().over(order)).where(F.col("id") <= count)


#: Quads that a task hands over at once.
_QUADS = 50_000


def line_quads(horizontal: DataFrame, vertical: DataFrame, by: list[str], width: float, height: float) -> DataFrame:
    """Quads of two horizontal and two vertical lines of a group that pass the geometry test: at most 66 x 66 a group, all
    at once in NumPy."""

    def listed(lines: DataFrame, n: str) -> DataFrame:
        c, s = _trig(F.col("theta"))
        each = F.struct("id", c.alias("c"), s.alias("s"), F.col("rho").cast("double").alias("rho"))
        return lines.groupBy(*by).agg(F.array_sort(F.collect_list(each)).alias(n))  # at most 12 each

    both = listed(horizontal, "h").join(listed(vertical, "v"), by)
    ship(both.sparkSession)

    def parts(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
        ids, c, s, rho = (column.values.field(n).to_numpy() for n in ("id", "c", "s", "rho"))
        lines = np.stack([c, s, rho], axis=1)
        return [(ids[a:b], lines[a:b]) for a, b in zip(column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:])]

    def handed(keys: pa.RecordBatch, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        rows, ids, quads = (np.concatenate(x) for x in zip(*found))
        points = pa.StructArray.from_arrays([pa.array(quads[:, :, k].ravel()) for k in (0, 1)], ["x", "y"])
        q = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(rows) + 1, 4, dtype=np.int32)), points)
        return pa.RecordBatch.from_arrays([*keys.take(pa.array(rows)).columns, *(pa.array(ids[:, k]) for k in range(4)), q], names=[*by, "h1", "h2", "v1", "v2", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, n = batch.select(by), [], 0
            for row, ((h_ids, h), (v_ids, v)) in enumerate(zip(parts(batch.column("h")), parts(batch.column("v")))):
                quads, which = finder.quads_of(h, v, width, height)
                if not len(quads):
                    continue
                good = finder.geometry(quads, width, height)[0]
                ids = np.column_stack([h_ids[which[good, :2]], v_ids[which[good, 2:]]])
                found.append((np.full(len(ids), row), ids, quads[good]))
                n += len(ids)
                if n >= _QUADS:
                    yield handed(keys, found)
                    found, n = [], 0
            if found:
                yield handed(keys, found)

    kinds = [f"`{c}` {both.schema[c].dataType.simpleString()}" for c in by]
    return both.mapInArrow(run, ", ".join([*kinds, "h1 int, h2 int, v1 int, v2 int, q array<struct<x: double, y: double>>"]))


def merged(lines: DataFrame, by: list[str], most: int = 200, degrees: int = 5, apart: float = 6.0) -> DataFrame:
    """Lines in order of votes without those near one already accepted: a fold over the first ``most`` of each group.

    (theta, rho) and (theta + 180, -rho) are the same line."""
    first = strongest(lines, by, most)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", "theta", "rho", "votes"))).alias("l"))
    near = lambda a, b: F.when(F.abs(a["theta"] - b["theta"]) <= degrees, F.abs(a["rho"] - b["rho"]) <= apart).when(F.abs(a["theta"] - b["theta"]) >= 180 - degrees, F.abs(a["rho"] + b["rho"]) <= apart).otherwise(False)
    fold = F.aggregate("l", F.slice("l", F.lit(1), F.lit(1)), lambda acc, x: F.when(F.exists(acc, lambda y: near(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select(*by, F.explode(fold).alias("x")).select(*by, "x.theta", "x.rho", "x.votes")


def refined(lines: DataFrame, edges: DataFrame, by: list[str], reach: float = 1.5, least: int = 12) -> DataFrame:
    """Adds the mean distance of each line's inliers as ``rho_fit``; the line's own where they are few."""
    c, s = _trig(F.col("theta"))
    away = F.col("x") * c + F.col("y") * s
    met = lines.join(edges.select(*by, "y", "x"), by).where(F.abs(away - F.col("rho")) <= reach)
    means = met.groupBy(*by, "theta", "rho").agg(F.avg(away).alias("m"), F.count(F.lit(1)).alias("n"))
    return lines.join(means, [*by, "theta", "rho"], "left").withColumn("rho_fit", F.when(F.col("n") >= least, F.col("m")).otherwise(F.col("rho").cast("double"))).drop("m", "n")


def spaced(chain: Column, least: float) -> Column:
    """A chain of points without those nearer than ``least`` to the last one kept: a fold in order."""

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        far = (p["x"] - last["x"]) * (p["x"] - last["x"]) + (p["y"] - last["y"]) * (p["y"] - last["y"]) >= least * least
        return F.when((F.size(acc) == 0) | far, F.concat(acc, F.array(p))).otherwise(acc)

    return F.aggregate(chain, F.slice(chain, F.lit(1), F.lit(1)), step)
