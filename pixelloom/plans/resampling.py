"""Queries of the lookup operators and of sensor mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions.geometry import quad_points
from pixelloom.operators import bayer as B
from pixelloom.operators import lookups as K
from pixelloom.plans.base import mosaic8, pa4, px4, px8, quads, query, r6, s6, with_sql
from pixelloom.session import table

ID = ["image_id"]


@query("q_block_mean", f"{with_sql('px8')} SELECT image_id, y // 3 AS y, x // 3 AS x, {s6('avg(v)')} AS v FROM px8 WHERE x < 6 AND y < 6 GROUP BY image_id, y // 3, x // 3")
def q_block_mean(spark, sf_dir):
    out = K.block_mean(px8(spark, sf_dir), ID, ["v"], 3, F.lit(8), F.lit(8))
    return out.select("image_id", "y", "x", r6(F.col("v")).alias("v"))


@query("q_area_resample", f"{with_sql('px8')} SELECT image_id, ((y + 1) * 3 - 1) // 8 AS y, ((x + 1) * 5 - 1) // 8 AS x, {s6('avg(v)')} AS v FROM px8 GROUP BY 1, 2, 3")
def q_area_resample(spark, sf_dir):
    out = K.area_resample(px8(spark, sf_dir), ID, ["v"], (8, 8), (3, 5))
    return out.select("image_id", "y", "x", r6(F.col("v")).alias("v"))


def _points(spark, sf_dir):
    """Four sampling points for each image, some outside."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), *(F.struct((3.5 + 9.0 * at(2 * k)).alias("u"), (3.5 + 9.0 * at(2 * k + 1)).alias("v")).alias(f"p{k}") for k in range(4)))
    return e.select("image_id", F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("k", "p")).select("image_id", F.col("k").cast("long").alias("k"), "p.u", "p.v")


_POINTS = "pts AS (SELECT vec_id AS image_id, k, 3.5 + 9.0 * CAST(embedding[2*k+1] AS DOUBLE) AS u, 3.5 + 9.0 * CAST(embedding[2*k+2] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 4)) AS k FROM embeddings))"
_CLAMPED = f"{_POINTS}, c AS (SELECT image_id, k, greatest(0.0, least(6.99, u)) AS u, greatest(0.0, least(6.99, v)) AS v FROM pts)"


@query("q_bilinear", f"""{with_sql('px8')}, {_CLAMPED}, t AS (SELECT image_id, k, CAST(floor(u) AS BIGINT) + dx AS tx, CAST(floor(v) AS BIGINT) + dy AS ty, (CASE WHEN dx = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN dy = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM (SELECT *, unnest([0, 1]) AS dx FROM (SELECT *, unnest([0, 1]) AS dy FROM c)))
SELECT t.image_id, t.k, {s6('sum(t.w * p.v)')} AS v FROM t JOIN px8 AS p ON p.image_id = t.image_id AND p.x = t.tx AND p.y = t.ty GROUP BY t.image_id, t.k""")
def q_bilinear(spark, sf_dir):
    out = K.bilinear(px8(spark, sf_dir).withColumnRenamed("v", "value"), _points(spark, sf_dir), ID, ["k"], ["value"], 8, 8)
    return out.select("image_id", "k", r6(F.col("value")).alias("v"))


def _cubic(t: str) -> str:
    return f"(CASE WHEN abs({t}) < 1 THEN (1.5 * abs({t}) - 2.5) * abs({t}) * abs({t}) + 1.0 WHEN abs({t}) < 2 THEN ((-0.5 * abs({t}) + 2.5) * abs({t}) - 4.0) * abs({t}) + 2.0 ELSE 0.0 END)"


_TAPS = f"""t AS (SELECT *, greatest(0, least(7, CAST(floor(u) AS BIGINT) + dx)) AS tx, greatest(0, least(7, CAST(floor(v) AS BIGINT) + dy)) AS ty, {_cubic('(u - floor(u) - dx)')} * {_cubic('(v - floor(v) - dy)')} AS w FROM (SELECT *, unnest([-1, 0, 1, 2]) AS dx FROM (SELECT *, unnest([-1, 0, 1, 2]) AS dy FROM pts)))"""


@query("q_bicubic", f"{with_sql('px8')}, {_POINTS}, {_TAPS} SELECT t.image_id, t.k, {s6('sum(t.w * p.v)')} AS v FROM t JOIN px8 AS p ON p.image_id = t.image_id AND p.x = t.tx AND p.y = t.ty GROUP BY t.image_id, t.k")
def q_bicubic(spark, sf_dir):
    out = K.bicubic(px8(spark, sf_dir).withColumnRenamed("v", "value"), _points(spark, sf_dir), ID, ["k"], ["value"], 8, 8)
    return out.select("image_id", "k", r6(F.col("value")).alias("v"))


@query("q_nearest", f"{with_sql('px8')}, {_POINTS} SELECT t.image_id, t.k, {s6('p.v')} AS v FROM pts AS t JOIN px8 AS p ON p.image_id = t.image_id AND p.x = greatest(0, least(7, CAST(floor(t.u + 0.5) AS BIGINT))) AND p.y = greatest(0, least(7, CAST(floor(t.v + 0.5) AS BIGINT)))")
def q_nearest(spark, sf_dir):
    out = K.nearest(px8(spark, sf_dir).withColumnRenamed("v", "value"), _points(spark, sf_dir), ID, ["value"], 8, 8)
    return out.select("image_id", "k", r6(F.col("value")).alias("v"))


_H = """m AS (SELECT *, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy, x1 - x2 AS dx1, x3 - x2 AS dx2, y1 - y2 AS dy1, y3 - y2 AS dy2 FROM quads),
n AS (SELECT *, (sx * dy2 - dx2 * sy) / (dx1 * dy2 - dx2 * dy1) AS g, (dx1 * sy - sx * dy1) / (dx1 * dy2 - dx2 * dy1) AS h FROM m WHERE abs(dx1 * dy2 - dx2 * dy1) >= 0.000000000001),
c AS (SELECT image_id, x1 - x0 + g * x1 AS a, x3 - x0 + h * x3 AS b, x0 AS c, y1 - y0 + g * y1 AS d, y3 - y0 + h * y3 AS e, y0 AS f, g, h FROM n),
w AS (SELECT *, i // 5 AS y, i % 5 AS x, (i % 5) / 4.0 AS s, (i // 5) / 3.0 AS t FROM (SELECT *, unnest(range(0, 20)) AS i FROM c)),
grid AS (SELECT image_id, y, x, (a * s + b * t + c) / (g * s + h * t + 1.0) AS u, (d * s + e * t + f) / (g * s + h * t + 1.0) AS v FROM w WHERE abs(g * s + h * t + 1.0) >= 0.000000001)"""


@query("q_homography_grid", f"{with_sql('quads')}, {_H} SELECT image_id, y, x, {s6('u')} AS u, {s6('v')} AS v FROM grid")
def q_homography_grid(spark, sf_dir):
    out = K.warp_grid(quads(spark, sf_dir), ID, quad_points(F.col("q")), 5, 4)
    return out.select("image_id", "y", "x", r6(F.col("u")).alias("u"), r6(F.col("v")).alias("v"))


@query("q_homography_warp", f"""{with_sql('quads', 'px8')}, {_H}, pts AS (SELECT image_id, y AS oy, x AS ox, u * 0.07 AS u, v * 0.07 AS v FROM grid), {_TAPS}
SELECT t.image_id, t.oy AS y, t.ox AS x, {s6('sum(t.w * p.v)')} AS v FROM t JOIN px8 AS p ON p.image_id = t.image_id AND p.x = t.tx AND p.y = t.ty GROUP BY t.image_id, t.oy, t.ox""")
def q_homography_warp(spark, sf_dir):
    grid = K.warp_grid(quads(spark, sf_dir), ID, quad_points(F.col("q")), 5, 4).select("image_id", F.col("y").alias("oy"), F.col("x").alias("ox"), (F.col("u") * 0.07).alias("u"), (F.col("v") * 0.07).alias("v"))
    out = K.bicubic(px8(spark, sf_dir).withColumnRenamed("v", "value"), grid, ID, ["oy", "ox"], ["value"], 8, 8)
    return out.select("image_id", F.col("oy").alias("y"), F.col("ox").alias("x"), r6(F.col("value")).alias("v"))


_REFLECT = "least((i % 14 + 14) % 14, 14 - (i % 14 + 14) % 14)"


@query("q_tile_gather", f"""{with_sql('px8')}, a AS (SELECT ty, tx, ly, lx, (ty * 4 - 2 + ly) AS sy, (tx * 4 - 2 + lx) AS sx FROM (SELECT unnest(range(0, 2)) AS ty), (SELECT unnest(range(0, 2)) AS tx), (SELECT unnest(range(0, 8)) AS ly), (SELECT unnest(range(0, 8)) AS lx)),
s AS (SELECT ty, tx, ly, lx, {_REFLECT.replace('i', 'sy')} AS sy, {_REFLECT.replace('i', 'sx')} AS sx FROM a)
SELECT p.image_id, s.ty, s.tx, s.ly, s.lx, {s6('p.v')} AS v FROM s JOIN px8 AS p ON p.y = s.sy AND p.x = s.sx""".replace("unnest(range", "unnest(range"))
def q_tile_gather(spark, sf_dir):
    out = K.tiles(px8(spark, sf_dir), ID, 4, 2, 8, 8)
    return out.select("image_id", *(F.col(c).cast("long").alias(c) for c in ("ty", "tx", "ly", "lx")), r6(F.col("v")).alias("v"))


@query("q_tile_stitch", f"{with_sql('px8')} SELECT image_id, y, x, {s6('v')} AS v FROM px8")
def q_tile_stitch(spark, sf_dir):
    out = K.stitch(K.tiles(px8(spark, sf_dir), ID, 4, 2, 8, 8), ID, 4, 2, 8, 8, ["v"])
    return out.select("image_id", "y", "x", r6(F.col("v")).alias("v"))


_PLANE = "((y % 2) * 2 + x % 2)"
_CELL = f"(CASE WHEN {_PLANE} = cfa THEN 0 WHEN {_PLANE} = 3 - cfa THEN 3 WHEN y % 2 = cfa // 2 THEN 1 ELSE 2 END)"
_PACK = f"""{with_sql('mosaic8')}, k AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx, {_CELL} AS k, greatest(0.0, least(1.0, (raw - 64.0) / 559.0)) AS v, raw >= 622.5 AS clipped FROM mosaic8)
SELECT image_id, cy, cx, """


@query("q_pack_bayer", _PACK + ", ".join(f"{s6(f'max(CASE WHEN k = {i} THEN v END)')} AS {n}" for i, n in enumerate(("r", "g1", "g2", "b"))) + " FROM k GROUP BY image_id, cy, cx")
def q_pack_bayer(spark, sf_dir):
    out = B.pack_rggb(mosaic8(spark, sf_dir), ID, white=623.0)
    return out.select("image_id", "cy", "cx", *(r6(F.col(c)).alias(c) for c in ("r", "g1", "g2", "b")))


@query("q_clip_bits", _PACK + "CAST(sum(CASE WHEN clipped THEN 1 << k ELSE 0 END) AS BIGINT) AS clip FROM k GROUP BY image_id, cy, cx")
def q_clip_bits(spark, sf_dir):
    return B.pack_rggb(mosaic8(spark, sf_dir), ID, white=623.0).select("image_id", "cy", "cx", "clip")


def _malvar_sql() -> str:
    """The stencil by thirteen lookups on a clamped grid, in a list for each image."""
    offsets = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-2, 0), (2, 0), (0, -2), (0, 2), (-1, -1), (-1, 1), (1, -1), (1, 1)]
    names = ["c", "n1", "s1", "w1", "e1", "n2", "s2", "w2", "e2", "nw", "ne", "sw", "se"]
    v = {n: f"a[greatest(0, least(7, p.y + {dy})) * 8 + greatest(0, least(7, p.x + {dx})) + 1]" for n, (dy, dx) in zip(names, offsets)}
    corners = f"({v['nw']} + {v['ne']} + {v['sw']} + {v['se']})"
    c, n1, s1, w1, e1, n2, s2, w2, e2 = (v[n] for n in names[:9])
    green = f"(4.0 * {c} + 2.0 * ({n1} + {s1} + {w1} + {e1}) - ({n2} + {s2} + {w2} + {e2})) / 8.0"
    across = f"(5.0 * {c} + 4.0 * ({w1} + {e1}) - {corners} - ({w2} + {e2}) + 0.5 * ({n2} + {s2})) / 8.0"
    down = f"(5.0 * {c} + 4.0 * ({n1} + {s1}) - {corners} - ({n2} + {s2}) + 0.5 * ({w2} + {e2})) / 8.0"
    diagonal = f"(6.0 * {c} + 2.0 * {corners} - 1.5 * ({n2} + {s2} + {w2} + {e2})) / 8.0"
    of = lambda a: f"CASE p.k WHEN 0 THEN {a[0]} WHEN 1 THEN {a[1]} WHEN 2 THEN {a[2]} ELSE {a[3]} END"
    return f"""{with_sql('mosaic8')}, lv AS (SELECT image_id, y, x, {_CELL} AS k, greatest(0.0, least(1.0, (raw - 64.0) / 959.0)) AS v FROM mosaic8),
d AS (SELECT p.image_id, p.y, p.x, {of([c, across, down, diagonal])} AS r, {of([green, c, c, green])} AS g, {of([diagonal, down, across, c])} AS b FROM lv AS p JOIN (SELECT image_id, list(v ORDER BY y, x) AS a FROM lv GROUP BY image_id) AS n ON n.image_id = p.image_id)"""


_RGB = ", ".join(f"{s6(c)} AS {c}" for c in "rgb")


@query("q_malvar", f"{_malvar_sql()} SELECT image_id, y, x, {_RGB} FROM d")
def q_malvar(spark, sf_dir):
    levels = mosaic8(spark, sf_dir).withColumn("level", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("raw") - 64.0) / 959.0)))
    return B.malvar(levels, ID).select("image_id", "y", "x", *(r6(F.col(c)).alias(c) for c in "rgb"))


_CCM = (1.8, -0.6, -0.2, -0.3, 1.5, -0.2, 0.1, -0.5, 1.4)
_GAINS = (1.0 / 0.5, 1.0 / 1.0, 1.0 / 0.6)
_RAMP = lambda c: f"greatest(0.0, least(1.0, ({c} - 1.0 * 0.95) * (1.0 / greatest(1.0 - 1.0 * 0.95, 0.000001))))"
_MENDED = ", ".join(f"{c} * {g!r} + (greatest(r * {_GAINS[0]!r}, g * {_GAINS[1]!r}, b * {_GAINS[2]!r}) - {c} * {g!r}) * ({_RAMP(c)} * {_RAMP(c)} * (3.0 - 2.0 * {_RAMP(c)})) AS m{c}" for c, g in zip("rgb", _GAINS))


@query("q_develop", f"{_malvar_sql()}, m AS (SELECT image_id, y, x, {_MENDED} FROM d) SELECT image_id, y, x, " + ", ".join(f"{s6(f'greatest({_CCM[3 * k]} * mr + {_CCM[3 * k + 1]} * mg + {_CCM[3 * k + 2]} * mb, 0.0) * {2.0 ** 0.5!r}')} AS {c}" for k, c in enumerate("rgb")) + " FROM m")
def q_develop(spark, sf_dir):
    out = B.develop(mosaic8(spark, sf_dir), ID, (0.5, 1.0, 0.6), _CCM, exposure=0.5)
    return out.select("image_id", "y", "x", *(r6(F.col(c)).alias(c) for c in "rgb"))


@query("q_symmetries", f"{with_sql('px4')} SELECT image_id, y AS cy, x AS cx, {s6('r')} AS r, {s6('g')} AS g, {s6('a')} AS b, 0.0 AS var_r FROM px4".replace("0.0 AS var_r", "CAST(0.0 AS DOUBLE) AS var_r"))
def q_symmetries(spark, sf_dir):
    cells = px4(spark, sf_dir).select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), "r", F.col("g").alias("g1"), F.col("b").alias("g2"), F.col("a").alias("b"))
    out = B.symmetries_undone(B.symmetries(cells, ID, 4, 4), ID, 4, 4)
    return out.select("image_id", "cy", "cx", r6(F.col("r")).alias("r"), r6(F.col("g")).alias("g"), r6(F.col("b")).alias("b"), r6(F.col("var_r")).alias("var_r"))
