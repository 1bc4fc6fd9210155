"""Queries of trackers, view state and gestures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.plans.base import query, r6, s6
from pixelloom.session import table
from pixelloom.streaming import tracker as T
from pixelloom.streaming import views as V

_TRACK = "WITH RECURSIVE t AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, least(3.0, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 3600000000.0, 0.0)) AS dt FROM events)"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    before = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("dt", F.least(F.lit(3.0), F.coalesce((F.unix_micros("ts") - F.unix_micros(before)) / 3600000000.0, F.lit(0.0))))


@query("q_corner_track", f"""{_TRACK}, k AS (
SELECT user_id, i, CAST(value AS DOUBLE) AS p, CAST(0.0 AS DOUBLE) AS v, CAST(25.0 AS DOUBLE) AS a, CAST(0.0 AS DOUBLE) AS b, CAST(100.0 AS DOUBLE) AS c FROM t WHERE i = 1
UNION ALL
SELECT user_id, i, mp + ma / (ma + 36.0) * (z - mp), mv + mb / (ma + 36.0) * (z - mp), (1.0 - ma / (ma + 36.0)) * ma, (1.0 - ma / (ma + 36.0)) * mb, mc - mb / (ma + 36.0) * mb
FROM (SELECT t.user_id, t.i, t.value AS z, k.p + k.v * t.dt AS mp, k.v AS mv, k.a + 2.0 * t.dt * k.b + t.dt * t.dt * k.c + 25.0 * t.dt * t.dt * t.dt * t.dt / 4.0 AS ma, k.b + t.dt * k.c + 25.0 * t.dt * t.dt * t.dt / 2.0 AS mb, k.c + 25.0 * t.dt * t.dt AS mc FROM k JOIN t ON t.user_id = k.user_id AND t.i = k.i + 1) AS m)
SELECT user_id, CAST(i - 1 AS INTEGER) AS i, round(p, 4) + 0.0 AS position, round(v, 4) + 0.0 AS velocity FROM k""")
def q_corner_track(spark, sf_dir):
    out = T.smoothed_points(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("dt"), "value")
    return out.select("user_id", "i", (F.round("position", 4) + 0.0).alias("position"), (F.round("velocity", 4) + 0.0).alias("velocity"))


@query("q_double_taps", "WITH g AS (SELECT user_id, event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1000000.0 AS since FROM events) SELECT user_id, count(*) AS n FROM g WHERE since <= 86400.0 GROUP BY user_id")
def q_double_taps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return V.double_taps(e, ["user_id"], "ts", 86400.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("q_view_state")
def q_view_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("op", F.element_at(F.array(F.lit("pan"), F.lit("zoom"), F.lit("toggle")), (F.col("event_id") % 3 + 1).cast("int")))
    e = e.select("user_id", "event_id", "op", (F.col("value") % 200).alias("a"), (F.col("value") % 130).alias("b"), (0.5 + F.col("value") % 2).alias("c"))
    out = V.view_states(e, ["user_id"], ["event_id"], (1200.0, 900.0), (640.0, 480.0))
    return out.select("user_id", "n", r6(F.col("scale")).alias("scale"), r6(F.col("ox")).alias("ox"), r6(F.col("oy")).alias("oy"))


@query("q_page_tracks")
def q_page_tracks(spark, sf_dir):
    """Four corners about each user's events, as measurements of a page."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    z = F.col("value") % 20
    shift = lambda *base: F.array(*(z + float(b) for b in base))
    m = _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("track_id"), F.row_number().over(order).cast("long").alias("frame"), F.lit(1 / 30).alias("dt"),
        (F.col("event_id") % 7 != 0).alias("ok"), F.lit(1.0).alias("score"), shift(100, 400, 420, 80).alias("x"), shift(80, 90, 500, 480).alias("y"),
    )
    return T.track_corners(m)
