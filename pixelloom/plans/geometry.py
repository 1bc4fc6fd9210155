"""Queries of plane geometry and view state."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import geometry as G
from pixelloom.plans.base import quads, query, r6, s6, with_sql
from pixelloom.session import table

P = [("x0", "y0"), ("x1", "y1"), ("x2", "y2"), ("x3", "y3")]


def _pts():
    return G.quad_points(F.col("q"))


def _dist(a, b) -> str:
    return f"sqrt(({a[0]} - {b[0]}) * ({a[0]} - {b[0]}) + ({a[1]} - {b[1]}) * ({a[1]} - {b[1]}))"


def _cross(o, a, b) -> str:
    return f"(({a[0]} - {o[0]}) * ({b[1]} - {o[1]}) - ({a[1]} - {o[1]}) * ({b[0]} - {o[0]}))"


def _angle(u, v) -> str:
    n = f"(sqrt({u[0]} * {u[0]} + {u[1]} * {u[1]}) * sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]}))"
    return f"(CASE WHEN {n} < 0.000000001 THEN 0.0 ELSE degrees(acos(greatest(-1.0, least(1.0, ({u[0]} * {v[0]} + {u[1]} * {v[1]}) / {n})))) END)"


def _interior(i: int) -> str:
    b, c, a = P[(i + 3) % 4], P[i], P[(i + 1) % 4]
    return _angle((f"({b[0]} - {c[0]})", f"({b[1]} - {c[1]})"), (f"({a[0]} - {c[0]})", f"({a[1]} - {c[1]})"))


_AREA = "abs(" + " + ".join(f"({P[i][0]} * {P[(i + 1) % 4][1]} - {P[(i + 1) % 4][0]} * {P[i][1]})" for i in range(4)) + ") / 2.0"
_TURNS = ", ".join(_cross(P[i], P[(i + 1) % 4], P[(i + 2) % 4]) for i in range(4))
_CONVEX = f"(least({_TURNS}) >= 1.0 OR greatest({_TURNS}) <= -1.0)"
_APART = "least(" + ", ".join(_dist(P[i], P[j]) for i in range(4) for j in range(i)) + ") >= 4.0"
_ANGLES = ", ".join(_interior(i) for i in range(4))
_WITHIN = " AND ".join(f"{c} BETWEEN -10.0 AND 110.0" for p in P for c in p)
_Q = with_sql("quads")


@query("q_quad_measures", f"{_Q} SELECT image_id, {s6(_AREA)} AS area, {_CONVEX} AS convex, {_APART} AS apart, ({_CONVEX} AND {_AREA} >= 800 AND least({_ANGLES}) >= 60.0 AND greatest({_ANGLES}) <= 120.0 AND {_WITHIN}) AS good, {s6(_interior(0))} AS angle0, {s6(_interior(2))} AS angle2 FROM quads")
def q_quad_measures(spark, sf_dir):
    p = _pts()
    hundred = F.lit(100.0)
    return quads(spark, sf_dir).select("image_id", r6(G.quad_area(p)).alias("area"), G.convex_quad(p).alias("convex"), G.distinct_corners(p).alias("apart"), G.geometry_ok(p, hundred, hundred).alias("good"), r6(G.interior_deg(p[3], p[0], p[1])).alias("angle0"), r6(G.interior_deg(p[1], p[2], p[3])).alias("angle2"))


_U = ("(x1 - x0)", "(y1 - y0)"), ("(x2 - x1)", "(y2 - y1)")


@query("q_line_measures", f"{_Q} SELECT image_id, {s6(f'abs({_cross(P[0], P[2], P[1])}) / {_dist(P[0], P[2])}')} AS from_chord, {s6(_angle(*_U))} AS turn, {s6(_dist(P[0], P[2]))} AS diagonal, {s6('(x0 + 0.5) * 2.5 - 0.5')} AS source_x, {s6('(y0 + 0.5) * 1.5 - 0.5')} AS source_y FROM quads")
def q_line_measures(spark, sf_dir):
    p = _pts()
    sx, sy = G.to_source(p[0], F.lit(2.5), F.lit(1.5))
    return quads(spark, sf_dir).select("image_id", r6(G.perp_dist(p[1], p[0], p[2])).alias("from_chord"), r6(G.turn_from_straight(p[0], p[1], p[2])).alias("turn"), r6(G.dist(p[0], p[2])).alias("diagonal"), r6(sx).alias("source_x"), r6(sy).alias("source_y"))


@query("q_point_line_dist", f"{_Q} SELECT image_id, {s6(f'abs((x1 - x0) * ((y2 - y0) / {_dist(P[0], P[2])}) - (y1 - y0) * ((x2 - x0) / {_dist(P[0], P[2])}))')} AS d FROM quads")
def q_point_line_dist(spark, sf_dir):
    p = _pts()
    return quads(spark, sf_dir).select("image_id", r6(G.point_line_dist(p[1], G.line_through(p[0], p[2]))).alias("d"))


_SHUFFLED = f"""{_Q}, s AS (SELECT image_id, [{{'i': 0, 'x': x2, 'y': y2}}, {{'i': 1, 'x': x0, 'y': y0}}, {{'i': 2, 'x': x3, 'y': y3}}, {{'i': 3, 'x': x1, 'y': y1}}] AS a FROM quads),
u AS (SELECT image_id, unnest(a) AS p FROM s), v AS (SELECT image_id, p.i AS i, p.x AS x, p.y AS y FROM u)"""


@query("q_order_corners", f"""{_SHUFFLED}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x + y, i) AS tl, row_number() OVER (PARTITION BY image_id ORDER BY y - x, i) AS tr, row_number() OVER (PARTITION BY image_id ORDER BY -(x + y), i) AS br, row_number() OVER (PARTITION BY image_id ORDER BY x - y, i) AS bl FROM v)
SELECT image_id, """ + ", ".join(f"{s6(f'max(CASE WHEN {n} = 1 THEN {c} END)')} AS {n}_{c}" for n in ("tl", "tr", "br", "bl") for c in "xy") + " FROM r GROUP BY image_id")
def q_order_corners(spark, sf_dir):
    mixed = F.array(*(F.col("q")[i] for i in (2, 0, 3, 1)))
    out = quads(spark, sf_dir).select("image_id", mixed.alias("q")).select("image_id", G.order_corners(F.col("q")).alias("o"))
    return out.select("image_id", *(r6(F.col("o")[i][c]).alias(f"{n}_{c}") for i, n in enumerate(("tl", "tr", "br", "bl")) for c in "xy"))


_POLAR = "p AS (SELECT vec_id AS image_id, 3.0 * CAST(embedding[1] AS DOUBLE) AS t1, 1.6 + 3.0 * CAST(embedding[2] AS DOUBLE) AS t2, 50.0 * CAST(embedding[3] AS DOUBLE) AS r1, 50.0 * CAST(embedding[4] AS DOUBLE) AS r2 FROM embeddings)"


@query("q_intersect_polar", f"WITH {_POLAR}, d AS (SELECT *, cos(t1) * sin(t2) - sin(t1) * cos(t2) AS det FROM p) SELECT image_id, {s6('(r1 * sin(t2) - r2 * sin(t1)) / det')} AS x, {s6('(cos(t1) * r2 - cos(t2) * r1) / det')} AS y FROM d WHERE abs(det) >= 0.34")
def q_intersect_polar(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), (3.0 * at(0)).alias("t1"), (1.6 + 3.0 * at(1)).alias("t2"), (50.0 * at(2)).alias("r1"), (50.0 * at(3)).alias("r2"))
    hit = G.intersect_polar(F.cos("t1"), F.sin("t1"), F.col("r1"), F.cos("t2"), F.sin("t2"), F.col("r2"))
    return p.select("image_id", hit.alias("p")).where("p is not null").select("image_id", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


_DET = "((x2 - x0) * (y3 - y1) - (y2 - y0) * (x3 - x1))"
_T1, _T2 = f"((x1 - x0) * (y3 - y1) - (y1 - y0) * (x3 - x1)) / {_DET}", f"((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / {_DET}"


@query("q_seg_cross", f"{_Q}, t AS (SELECT *, {_T1} AS t, {_T2} AS u FROM quads WHERE abs({_DET}) >= 0.000001) SELECT image_id, {s6('x0 + t * (x2 - x0)')} AS x, {s6('y0 + t * (y2 - y0)')} AS y FROM t WHERE t BETWEEN 0.08 AND 0.92 AND u BETWEEN 0.08 AND 0.92")
def q_seg_cross(spark, sf_dir):
    p = _pts()
    hit = quads(spark, sf_dir).select("image_id", G.seg_cross(p[0], p[2], p[1], p[3]).alias("h")).where("h is not null")
    return hit.select("image_id", r6(F.col("h.x")).alias("x"), r6(F.col("h.y")).alias("y"))


_PROBES = "t AS (SELECT *, unnest(range(0, 25)) AS k FROM quads), g AS (SELECT *, (k % 5) * 25.0 + 0.3 AS px, (k // 5) * 25.0 + 0.7 AS py FROM t)"


def _crossings() -> str:
    out = []
    for i in range(4):
        a, b = P[i], P[(i + 3) % 4]
        out.append(f"(CASE WHEN ({a[1]} > py) != ({b[1]} > py) THEN CAST(px < ({b[0]} - {a[0]}) * (py - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} AS INTEGER) ELSE 0 END)")
    return " + ".join(out)


@query("q_point_in_poly", f"{_Q}, {_PROBES} SELECT image_id, k, ({_crossings()}) % 2 = 1 AS inside FROM g")
def q_point_in_poly(spark, sf_dir):
    return _probes(spark, sf_dir).select("image_id", "k", G.point_in_poly(F.col("px"), F.col("py"), F.col("q")).alias("inside"))


def _probes(spark, sf_dir):
    k = F.col("k")
    grid = quads(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("k", k.cast("long"))
    return grid.withColumns({"px": (k % 5) * 25.0 + 0.3, "py": F.floor(k / 5) * 25.0 + 0.7})


_SIDES = ", ".join(f"{_cross(P[i], P[(i + 1) % 4], ('px', 'py'))} / greatest({_dist(P[i], P[(i + 1) % 4])}, 0.000001)" for i in range(4))


@query("q_inside_convex", f"{_Q}, {_PROBES} SELECT image_id, k, (least({_SIDES}) >= -0.5 OR greatest({_SIDES}) <= 0.5) AS inside FROM g")
def q_inside_convex(spark, sf_dir):
    return _probes(spark, sf_dir).select("image_id", "k", G.inside_convex(F.col("px"), F.col("py"), _pts()).alias("inside"))


def _bezier(c: str) -> str:
    i = 0 if c == "x" else 1
    return f"(1.0 - t) * (1.0 - t) * (1.0 - t) * {P[0][i]} + 3.0 * (1.0 - t) * (1.0 - t) * t * {P[1][i]} + 3.0 * (1.0 - t) * t * t * {P[2][i]} + t * t * t * {P[3][i]}"


@query("q_bezier", f"{_Q}, t AS (SELECT *, k / 8.0 AS t FROM (SELECT *, unnest(range(0, 9)) AS k FROM quads)) SELECT image_id, k, {s6(_bezier('x'))} AS x, {s6(_bezier('y'))} AS y FROM t")
def q_bezier(spark, sf_dir):
    grid = quads(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    x, y = G.bezier_at(_pts(), F.col("k") / 8.0)
    return grid.select("image_id", F.col("k").cast("long").alias("k"), r6(x).alias("x"), r6(y).alias("y"))


_OW = f"floor(greatest({_dist(P[0], P[1])}, {_dist(P[3], P[2])}) + 0.5)"
_OH = f"floor(greatest({_dist(P[0], P[3])}, {_dist(P[1], P[2])}) + 0.5)"


@query("q_output_size", f"""{_Q}, s AS (SELECT image_id, greatest(16.0, least(160.0, {_OW})) AS w, greatest(16.0, least(120.0, {_OH})) AS h, {_OW} AS ow, {_OH} AS oh FROM quads),
k AS (SELECT *, sqrt(least(1.0, 1.25 * 80 * 60 / (w * h))) AS k FROM s)
SELECT image_id, CAST(ow AS BIGINT) AS ow, CAST(oh AS BIGINT) AS oh, CAST(greatest(16.0, floor(w * k)) AS BIGINT) AS cw, CAST(greatest(16.0, floor(h * k)) AS BIGINT) AS ch FROM k""")
def q_output_size(spark, sf_dir):
    ow, oh = G.corner_pixels(_pts())
    cw, ch = G.clamp_out(ow, oh, F.lit(80.0), F.lit(60.0))
    return quads(spark, sf_dir).select("image_id", *(c.cast("long").alias(n) for n, c in (("ow", ow), ("oh", oh), ("cw", cw), ("ch", ch))))


_WRAP = lambda v: f"({v} - 6.283185307179586 * floor(({v}) / 6.283185307179586))"


@query("q_in_sweep", f"WITH p AS (SELECT vec_id AS image_id, 8.0 * CAST(embedding[1] AS DOUBLE) AS a, 8.0 * CAST(embedding[2] AS DOUBLE) AS s, 8.0 * CAST(embedding[3] AS DOUBLE) AS e FROM embeddings) SELECT image_id, ({_WRAP('(e - s)')} <= 3.6 AND {_WRAP('(a - s + 0.12)')} <= {_WRAP('(e - s)')} + 0.24) AS inside FROM p")
def q_in_sweep(spark, sf_dir):
    at = lambda i: 8.0 * F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), G.in_sweep(at(0), at(1), at(2)).alias("inside"))


@query("q_fit_scale", f"WITH v AS (SELECT vec_id AS image_id, 100 + vec_id % 37 AS iw, 80 + vec_id % 23 AS ih FROM embeddings) SELECT image_id, {s6('least(640.0 / iw, 480.0 / ih)')} AS scale, {s6('7.0 + 12.0 * least(640.0 / iw, 480.0 / ih)')} AS sx FROM v")
def q_fit_scale(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), (100 + F.col("vec_id") % 37).alias("iw"), (80 + F.col("vec_id") % 23).alias("ih"))
    scale = G.fit_scale(F.col("iw"), F.col("ih"), F.lit(640.0), F.lit(480.0))
    x, _ = G.image_to_screen(F.lit(12.0), F.lit(0.0), scale, F.lit(7.0), F.lit(0.0))
    return e.select("image_id", r6(scale).alias("scale"), r6(x).alias("sx"))
