"""Queries of what a viewer does with a decoded image: size, exposure, tone, notes, placement, handles."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.functions import decoded as D
from pixelloom.functions import geometry as G
from pixelloom.plans.base import ORACLES, mosaic8, quads, query, r6, s6, with_sql
from pixelloom.plans.geometry import P, _dist
from pixelloom.plans.statistics import _COLOUR, q_auto_exposure
from pixelloom.session import table

_Q = with_sql("quads")
_LARGEST = 1024
_IMAGES = "i AS (SELECT vec_id AS image_id, 500 + vec_id * 37 % 9000 AS w, 400 + vec_id * 53 % 7000 AS h, vec_id % 11 = 0 AS hdr, vec_id % 7 = 0 AS wide, CASE WHEN vec_id % 3 = 0 THEN 16 ELSE 8 END AS bits, CASE WHEN vec_id % 13 = 0 THEN 5 ELSE 0 END AS exponent FROM embeddings)"


def _images(spark, sf_dir):
    v = F.col("vec_id").cast("long")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("image_id"), (500 + v * 37 % 9000).alias("w"), (400 + v * 53 % 7000).alias("h"), (v % 11 == 0).alias("hdr"), (v % 7 == 0).alias("wide"),
        F.when(v % 3 == 0, 16).otherwise(8).alias("bits"), F.when(v % 13 == 0, 5).otherwise(0).alias("exponent"),
    )


_FACTOR = "CASE " + " ".join(f"WHEN w // {1 << k} <= {_LARGEST} AND h // {1 << k} <= {_LARGEST} THEN {1 << k}" for k in range(11)) + " END"


@query("q_finalize", f"""WITH {_IMAGES}, e AS ({ORACLES['q_auto_exposure']}), f AS (SELECT i.*, CAST({_FACTOR} AS INTEGER) AS factor, CASE WHEN hdr OR wide OR vec_id % 2 = 0 THEN e.ev ELSE 0.0 END AS ev, CASE WHEN hdr OR wide OR vec_id % 2 = 0 THEN e.white ELSE 1.0 END AS white FROM (SELECT *, image_id AS vec_id FROM i) AS i JOIN e ON e.image_id = i.image_id)
SELECT image_id, factor, ev, white, CASE WHEN hdr OR wide OR bits > 8 OR exponent > 0 OR white > 1.0 OR abs(ev) > 0.01 THEN 'rolloff' ELSE 'clip' END AS tone,
concat_ws(',', CASE WHEN hdr THEN 'hdr_transfer' END, CASE WHEN wide THEN 'wide_primaries' END, CASE WHEN bits > 8 OR exponent > 0 THEN 'high_bit_depth' END, CASE WHEN factor > 1 THEN 'downsampled' END) AS notes FROM f""")
def q_finalize(spark, sf_dir):
    """Odd images that aren't HDR declare the 255 nits of an ordinary display."""
    exposed = _images(spark, sf_dir).join(q_auto_exposure(spark, sf_dir), "image_id")
    intensity = F.when(F.col("image_id") % 2 == 0, 1000.0).otherwise(255.0)
    ev, white = D.shown_exposure(F.col("hdr") | F.col("wide"), intensity, F.col("ev"), F.col("white"))
    out = exposed.withColumns({"ev": ev, "white": white, "factor": D.downsample_factor(F.col("w"), F.col("h"), _LARGEST)})
    flags = [F.col(c) for c in ("hdr", "wide", "bits", "exponent")]
    return out.select("image_id", "factor", "ev", "white", D.tone_mode(*flags, F.col("white"), F.col("ev")).alias("tone"), F.array_join(D.notes(*flags, F.col("factor")), ",").alias("notes"))


@query("q_channel_means", f"{with_sql('mosaic8')} SELECT image_id, {_COLOUR} AS colour, {s6('avg(raw)')} AS mean FROM mosaic8 GROUP BY 1, 2")
def q_channel_means(spark, sf_dir):
    colour = C.cfa_colour(F.col("cfa"), F.col("y"), F.col("x"))
    return mosaic8(spark, sf_dir).groupBy("image_id", colour.alias("colour")).agg(r6(F.avg("raw")).alias("mean"))


@query("q_view_rect", f"WITH {_IMAGES}, s AS (SELECT *, least(1200.0 / w, 900.0 / h) AS s FROM i) SELECT image_id, {s6('(1200.0 - w * s) / 2.0')} AS x, {s6('(900.0 - h * s) / 2.0')} AS y, {s6('w * s')} AS width, {s6('h * s')} AS height FROM s")
def q_view_rect(spark, sf_dir):
    rect = G.view_rect(F.col("w"), F.col("h"), F.lit(1200.0), F.lit(900.0))
    return _images(spark, sf_dir).select("image_id", *(r6(c).alias(n) for c, n in zip(rect, ("x", "y", "width", "height"))))


_AIM = f"""{_Q}, d AS (SELECT image_id, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, {_dist(P[0], P[1])} AS n, x2 - x0 AS fx, y2 - y0 AS fy FROM quads),
m AS (SELECT *, least(0.45 * n, 12.0) AS m, (fx * dx + fy * dy) / n AS s, (fy * dx - fx * dy) / n AS perp FROM d WHERE n >= 1.0),
a AS (SELECT *, greatest(m, least(n - m, s)) AS a FROM m),
g AS (SELECT *, CASE WHEN n - m - a >= a - m THEN a + least(64.0, n - m - a) ELSE a - least(64.0, a - m) END AS g FROM a)"""


@query("q_aim_segment", f"{_AIM} SELECT image_id, {s6('x0 + dx / n * g')} AS ghost_x, {s6('y0 + dy / n * g')} AS ghost_y, {s6('g / n')} AS t, {s6('perp')} AS perp, {s6('-dy / n * perp')} AS pull_x, {s6('dx / n * perp')} AS pull_y, abs(perp) >= 32.0 AS curve, {s6('sqrt((fx - dx / n * a) * (fx - dx / n * a) + (fy - dy / n * a) * (fy - dy / n * a))')} AS finger FROM g")
def q_aim_segment(spark, sf_dir):
    p = G.quad_points(F.col("q"))
    out = quads(spark, sf_dir).withColumn("a", G.aim_on_segment(p[2], p[0], p[1])).where("a is not null")
    return out.select("image_id", *(F.col("a.curve") if n == "curve" else r6(F.col(f"a.{n}")).alias(n) for n in ("ghost_x", "ghost_y", "t", "perp", "pull_x", "pull_y", "curve", "finger")))


@query("q_corner_shift", f"{_Q} SELECT image_id, {s6('greatest(' + ', '.join(f'sqrt(pow({x} - {x} * 0.9 - 2.0, 2) + pow({y} - {y} * 1.1 + 1.0, 2))' for x, y in P) + ')')} AS shift FROM quads")
def q_corner_shift(spark, sf_dir):
    p = G.quad_points(F.col("q"))
    return quads(spark, sf_dir).select("image_id", r6(G.corner_shift(p, [(x * 0.9 + 2.0, y * 1.1 - 1.0) for x, y in p])).alias("shift"))


@query("q_nearer_handle", f"{_Q} SELECT image_id, {_dist(P[2], ('(2.0 * x0 - x1)', '(2.0 * y0 - y1)'))} < {_dist(P[2], P[1])} AS mirrored FROM quads")
def q_nearer_handle(spark, sf_dir):
    p = G.quad_points(F.col("q"))
    return quads(spark, sf_dir).select("image_id", G.nearer_handle(p[2], p[0], p[1]).alias("mirrored"))


@query("q_intersect_lines", f"""{_Q}, k AS (SELECT *, (x2 - x0) * (y3 - y1) - (y2 - y0) * (x3 - x1) AS det FROM quads), t AS (SELECT *, ((x1 - x0) * (y3 - y1) - (y1 - y0) * (x3 - x1)) / det AS t FROM k WHERE abs(det) >= 0.00000001)
SELECT image_id, {s6('x0 + t * (x2 - x0)')} AS x, {s6('y0 + t * (y2 - y0)')} AS y FROM t""")
def q_intersect_lines(spark, sf_dir):
    p = G.quad_points(F.col("q"))
    along = lambda i, j: (p[i], (p[j][0] - p[i][0], p[j][1] - p[i][1]))
    out = quads(spark, sf_dir).withColumn("m", G.intersect_lines(along(0, 2), along(1, 3))).where("m is not null")
    return out.select("image_id", r6(F.col("m.x")).alias("x"), r6(F.col("m.y")).alias("y"))
