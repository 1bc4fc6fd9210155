"""Tracking of page corners: a constant-velocity Kalman filter per corner, in batch and as a stream.

x and y of a corner have the same noise and start, so one 2 x 2 covariance serves both. State of a track: the four
corners' positions and velocities, one covariance (all corners are updated together), and lock, misses and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelloom.session import ship

PROCESS, START_POSITION, START_VELOCITY = 25.0, 25.0, 100.0
MEASUREMENT, LEAST_SCORE, GATE, MOST_MISSES = 36.0, 0.25, 0.04, 8
OUTPUT = "track_id string, frame long, locked boolean, missed int, x array<double>, y array<double>"
STATE = "px array<double>, py array<double>, vx array<double>, vy array<double>, cov array<double>, locked boolean, missed int"


@dataclass
class CornerTrack:
    """One track. Measurements are (4, 2) arrays."""

    long_edge: float = 1000.0
    p: np.ndarray = field(default_factory=lambda: np.zeros((4, 2)))
    v: np.ndarray = field(default_factory=lambda: np.zeros((4, 2)))
    cov: np.ndarray = field(default_factory=lambda: np.zeros(3))
    locked: bool = False
    frozen: bool = False
    missed: int = 0

    def predict(self, dt: float) -> np.ndarray:
        """Positions after ``dt``, without changing the state."""
        return self.p.copy() if self.frozen or dt <= 0 else self.p + self.v * dt

    def _advance(self, dt: float) -> None:
        a, b, c = self.cov
        q = PROCESS
        self.p = self.p + self.v * dt
        self.cov = np.array([a + 2 * dt * b + dt * dt * c + q * dt**4 / 4, b + dt * c + q * dt**3 / 2, c + q * dt * dt])

    def update(self, measured: np.ndarray | None, dt: float, score: float = 1.0) -> bool:
        """Takes a frame's measurement, or None; whether the track is locked afterwards."""
        if self.frozen:
            return True
        if not self.locked:
            if measured is None:
                return False
            self.p, self.v = np.array(measured, dtype=float), np.zeros((4, 2))
            self.cov, self.locked, self.missed = np.array([START_POSITION, 0.0, START_VELOCITY]), True, 0
            return True
        self._advance(max(dt, 0.0))
        if measured is None or np.hypot(*(np.asarray(measured) - self.p).T).max() > GATE * self.long_edge:
            self.missed += 1
            if self.missed >= MOST_MISSES:
                self.locked = False
            return self.locked
        a, b, c = self.cov
        r = MEASUREMENT / max(score, LEAST_SCORE)
        k0, k1 = a / (a + r), b / (a + r)
        off = np.asarray(measured, dtype=float) - self.p
        self.p, self.v = self.p + k0 * off, self.v + k1 * off
        self.cov, self.missed = np.array([(1 - k0) * a, (1 - k0) * b, c - k1 * b]), 0
        return True


def _frames(track: CornerTrack, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values("frame").itertuples():
        measured = np.stack([np.asarray(r.x, float), np.asarray(r.y, float)], axis=1) if r.ok else None
        track.update(measured, float(r.dt), float(r.score or 0.0))
        out.append((r.track_id, r.frame, track.locked, track.missed, track.p[:, 0].tolist(), track.p[:, 1].tolist()))
    return pd.DataFrame(out, columns=["track_id", "frame", "locked", "missed", "x", "y"])


def track_corners(measurements: DataFrame, long_edge: float = 1000.0) -> DataFrame:
    """Tracks of (track_id, frame, dt, ok, score, x, y) in batch. A track's frames are one task's work, in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _frames(CornerTrack(long_edge), rows)

    ship(measurements.sparkSession)
    return measurements.groupBy("track_id").applyInPandas(run, OUTPUT)


def track_corners_stream(measurements: DataFrame, long_edge: float = 1000.0) -> DataFrame:
    """The same for a stream; the state of each track is kept between batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track = CornerTrack(long_edge)
        if state.exists:
            px, py, vx, vy, cov, locked, missed = state.get
            track.p, track.v, track.cov = np.stack([px, py], 1), np.stack([vx, vy], 1), np.array(cov)
            track.locked, track.missed = locked, missed
        rows = pd.concat(list(batches))
        out = _frames(track, rows)
        state.update((track.p[:, 0].tolist(), track.p[:, 1].tolist(), track.v[:, 0].tolist(), track.v[:, 1].tolist(), track.cov.tolist(), track.locked, track.missed))
        yield out

    ship(measurements.sparkSession)
    return measurements.groupBy("track_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def smoothed_points(df: DataFrame, by: list[str], order: list[str], dt: Column, value: str, measurement: float = MEASUREMENT) -> DataFrame:
    """The filter for single values in JVM expressions: one fold over a group's ordered values.

    (by, i, position, velocity). A group is held as one array, so it is for bounded tracks."""
    item = F.struct(*order, F.col(value).cast("double").alias("z"), dt.cast("double").alias("dt"))
    held = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    state = lambda p, v, a, b, c: F.struct(p.alias("p"), v.alias("v"), a.alias("a"), b.alias("b"), c.alias("c"))
    first = F.col("items")[0]
    start = F.array(state(first["z"], F.lit(0.0), F.lit(START_POSITION), F.lit(0.0), F.lit(START_VELOCITY)))

    def step(acc: Column, m: Column) -> Column:
        def corrected(s: Column) -> Column:
            d = m["dt"]
            a = s["a"] + 2.0 * d * s["b"] + d * d * s["c"] + PROCESS * d * d * d * d / 4.0
            b, c = s["b"] + d * s["c"] + PROCESS * d * d * d / 2.0, s["c"] + PROCESS * d * d
            moved = F.struct((s["p"] + s["v"] * d).alias("p"), s["v"].alias("v"), a.alias("a"), b.alias("b"), c.alias("c"))

            def gained(t: Column) -> Column:
                k0, k1, off = t["a"] / (t["a"] + measurement), t["b"] / (t["a"] + measurement), m["z"] - t["p"]
                return state(t["p"] + k0 * off, t["v"] + k1 * off, (1.0 - k0) * t["a"], (1.0 - k0) * t["b"], t["c"] - k1 * t["b"])

            return F.transform(F.array(moved), gained)[0]

        return F.concat(acc, F.transform(F.slice(acc, -1, 1), corrected))

    folded = held.withColumn("s", F.aggregate(F.slice("items", 2, F.size("items")), start, step))
    return folded.select(*by, F.posexplode("s").alias("i", "s")).select(*by, "i", F.col("s.p").alias("position"), F.col("s.v").alias("velocity"))
