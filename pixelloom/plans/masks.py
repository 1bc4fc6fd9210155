"""Queries of masks, profiles and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import chains as H
from pixelloom.operators import masks as M
from pixelloom.plans.base import px8, quads, query, r6, s6, with_sql
from pixelloom.session import table

ID = ["image_id"]
P8 = with_sql("px8")


def _mask(spark, sf_dir):
    return px8(spark, sf_dir).where("v > 0.08")


@query("q_mask_boundaries", f'{P8} SELECT image_id, y AS line, min(x) AS "first", max(x) AS "last" FROM px8 WHERE v > 0.08 GROUP BY image_id, y')
def q_mask_boundaries(spark, sf_dir):
    return M.boundaries(_mask(spark, sf_dir), ID)


@query("q_ink_profile", f'{P8}, c AS (SELECT image_id, y, count(*) AS n FROM px8 WHERE v > 0.08 GROUP BY image_id, y), m AS (SELECT *, max(n) OVER (PARTITION BY image_id) AS most FROM c) SELECT image_id, min(y) AS "first", max(y) AS "last", max(most) AS most FROM m WHERE n >= 0.4 * most GROUP BY image_id')
def q_ink_profile(spark, sf_dir):
    return M.ink_profile(_mask(spark, sf_dir), ID)


def _small_quads(spark, sf_dir):
    scaled = F.transform("q", lambda p: F.struct((p["x"] * 0.08).alias("x"), (p["y"] * 0.08).alias("y")))
    return quads(spark, sf_dir).select("image_id", scaled.alias("q"))


_SMALL = f"{with_sql('quads', 'px8')}, k AS (SELECT image_id, " + ", ".join(f"{c}{i} * 0.08 AS {c}{i}" for i in range(4) for c in "xy") + " FROM quads)"


def _side(i: int) -> str:
    j = (i + 1) % 4
    return f"((x{j} - x{i}) * (y - y{i}) - (y{j} - y{i}) * (x - x{i})) / greatest(sqrt((x{i} - x{j}) * (x{i} - x{j}) + (y{i} - y{j}) * (y{i} - y{j})), 0.000001)"


_IN = f"(least({', '.join(map(_side, range(4)))}) >= -0.5 OR greatest({', '.join(map(_side, range(4)))}) <= 0.5)"


@query("q_mask_quad_overlap", f"{_SMALL}, b AS (SELECT image_id, v > 0.08 AS m, {_IN} AS i FROM px8 JOIN k USING (image_id)) SELECT image_id, {s6('count(*) FILTER (WHERE m AND i) / greatest(count(*) FILTER (WHERE m), 1)')} AS mask_inside, {s6('count(*) FILTER (WHERE m AND i) / greatest(count(*) FILTER (WHERE i), 1)')} AS quad_filled FROM b GROUP BY image_id")
def q_mask_quad_overlap(spark, sf_dir):
    out = M.quad_overlap(px8(spark, sf_dir).withColumn("hit", F.col("v") > 0.08), _small_quads(spark, sf_dir), ID, "hit")
    return out.select("image_id", r6(F.col("mask_inside")).alias("mask_inside"), r6(F.col("quad_filled")).alias("quad_filled"))


def _near(i: int) -> str:
    j = (i + 1) % 4
    t = f"greatest(0.0, least(1.0, ((x - x{i}) * (x{j} - x{i}) + (y - y{i}) * (y{j} - y{i})) / greatest((x{j} - x{i}) * (x{j} - x{i}) + (y{j} - y{i}) * (y{j} - y{i}), 0.000000001)))"
    return f"sqrt((x - (x{i} + {t} * (x{j} - x{i}))) * (x - (x{i} + {t} * (x{j} - x{i}))) + (y - (y{i} + {t} * (y{j} - y{i}))) * (y - (y{i} + {t} * (y{j} - y{i}))))"


@query("q_edge_inliers", f"{_SMALL} SELECT image_id, {s6('avg(CASE WHEN least(' + ', '.join(map(_near, range(4))) + ') <= 1.0 THEN 1.0 ELSE 0.0 END)')} AS inliers, count(*) AS n FROM px8 JOIN k USING (image_id) WHERE v > 0.08 GROUP BY image_id")
def q_edge_inliers(spark, sf_dir):
    out = M.edge_inliers(_mask(spark, sf_dir), _small_quads(spark, sf_dir), ID, 1.0)
    return out.select("image_id", r6(F.col("inliers")).alias("inliers"), "n")


@query("q_fit_line", f"""{P8}, r AS (SELECT image_id, y, x, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM px8 WHERE v > 0.08),
s AS (SELECT * FROM r WHERE i % greatest(1, n // 12) = 0 AND i // greatest(1, n // 12) < 12),
p AS (SELECT a.image_id, row_number() OVER (PARTITION BY a.image_id ORDER BY a.i, b.i) - 1 AS k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bya FROM s AS a JOIN s AS b ON a.image_id = b.image_id AND b.i > a.i),
h AS (SELECT p.image_id, p.k, r.x, r.y FROM p JOIN r ON r.image_id = p.image_id WHERE abs((bx - ax) * (r.y - ay) - (bya - ay) * (r.x - ax)) / sqrt((bx - ax) * (bx - ax) + (bya - ay) * (bya - ay)) <= 0.8),
c AS (SELECT image_id, k, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM h GROUP BY image_id, k),
b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, k) AS o FROM c)
SELECT image_id, n, {s6('cx')} AS cx, {s6('cy')} AS cy FROM b WHERE o = 1""")
def q_fit_line(spark, sf_dir):
    out = M.fit_lines(_mask(spark, sf_dir), ID, ["y", "x"], tolerance=0.8)
    return out.select("image_id", "n", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


@query("q_crease", f"""{P8}, g AS (SELECT image_id, y AS line, v - lag(v) OVER (PARTITION BY image_id, x ORDER BY y) AS g FROM px8),
l AS (SELECT image_id, line, avg(g) AS m, count(*) FILTER (WHERE g > 0) AS up, count(*) FILTER (WHERE g < 0) AS down, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY image_id, line),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY abs(m) DESC, line) AS o, row_number() OVER (PARTITION BY image_id ORDER BY abs(m)) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS k FROM l)
SELECT image_id, max(CASE WHEN o = 1 THEN line END) AS line, {s6('max(abs(m))')} AS strength, {s6('min(CASE WHEN i >= floor(0.5 * (k - 1)) THEN abs(m) END)')} AS median, {s6('max(CASE WHEN o = 1 THEN (CASE WHEN m > 0 THEN up ELSE down END) / n END)')} AS agree FROM r GROUP BY image_id""")
def q_crease(spark, sf_dir):
    out = M.crease(px8(spark, sf_dir), ID, "v")
    return out.select("image_id", "line", *(r6(F.col(c)).alias(c) for c in ("strength", "median", "agree")))


@query("q_heatmap_peak", f"""{P8}, b AS (SELECT image_id, y AS py, x AS px, v AS peak, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS o FROM px8)
SELECT image_id, py, px, {s6('sum(exp(v - peak) * x) / sum(exp(v - peak))')} AS cx, {s6('sum(exp(v - peak) * y) / sum(exp(v - peak))')} AS cy FROM b JOIN px8 USING (image_id) WHERE o = 1 AND y BETWEEN py - 1 AND py + 1 AND x BETWEEN px - 1 AND px + 1 GROUP BY image_id, py, px""")
def q_heatmap_peak(spark, sf_dir):
    out = M.heatmap_peak(px8(spark, sf_dir), ID, "v")
    return out.select("image_id", "py", "px", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


_O = "PARTITION BY image_id, y ORDER BY x"


@query("q_sliding_vote", f"""{P8}, f AS (SELECT image_id, y, x, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS h FROM px8),
w AS (SELECT image_id, y, x, avg(h) OVER ({_O} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS i, avg(h) OVER ({_O} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS o FROM f)
SELECT image_id, y, min(x) AS "at" FROM w WHERE i >= 0.6 AND o <= 0.4 GROUP BY image_id, y""")
def q_sliding_vote(spark, sf_dir):
    return M.first_vote(px8(spark, sf_dir).withColumn("hit", F.col("v") > 0), ["image_id", "y"], "x", "hit", 3)


@query("q_patch_grid", f"""{P8}, e AS (SELECT image_id, y * 2 // 8 AS "row", x * 4 // 8 AS "column", abs(2 * v - lag(v) OVER ({_O}) - lead(v) OVER ({_O})) AS e FROM px8) SELECT image_id, "row", "column", {s6('avg(e)')} AS energy FROM e WHERE e IS NOT NULL GROUP BY image_id, "row", "column" """)
def q_patch_grid(spark, sf_dir):
    out = M.patch_energy(px8(spark, sf_dir), ID, "v", 2, 4, 8, 8)
    return out.select("image_id", "row", "column", r6(F.col("energy")).alias("energy"))


def _chains(spark, sf_dir):
    """A chain of eight points a vector: x along the index, y from the vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform(F.slice("embedding", 1, 8), lambda v, i: F.struct((i * 10.0).alias("x"), (v.cast("double") * 30.0).alias("y"))).alias("chain"))
    return e


_CHAIN = "c AS (SELECT vec_id AS image_id, i, i * 10.0 AS x, CAST(embedding[i + 1] AS DOUBLE) * 30.0 AS y FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS i FROM embeddings)), s AS (SELECT image_id, i, x, y, lead(x) OVER (PARTITION BY image_id ORDER BY i) AS nx, lead(y) OVER (PARTITION BY image_id ORDER BY i) AS ny FROM c), g AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len FROM s WHERE nx IS NOT NULL)"


@query("q_chain_measures", f"""WITH {_CHAIN}, e AS (SELECT image_id, max(CASE WHEN i = 0 THEN y END) AS ay, max(CASE WHEN i = 7 THEN y END) AS ty FROM c GROUP BY image_id)
SELECT c.image_id, (SELECT {s6('sum(len)')} FROM g WHERE g.image_id = c.image_id) AS length, {s6('max(abs((x - 0.0) * (ty - ay) - (y - ay) * 70.0) / sqrt(70.0 * 70.0 + (ty - ay) * (ty - ay)))')} AS sagitta FROM c JOIN e ON e.image_id = c.image_id GROUP BY c.image_id""")
def q_chain_measures(spark, sf_dir):
    return _chains(spark, sf_dir).select("image_id", r6(H.chain_length(F.col("chain"))).alias("length"), r6(H.chain_sagitta(F.col("chain"))).alias("sagitta"))


@query("q_arc_at", f"""WITH {_CHAIN}, a AS (SELECT *, sum(len) OVER (PARTITION BY image_id ORDER BY i) - len AS before, sum(len) OVER (PARTITION BY image_id) AS total FROM g),
t AS (SELECT *, 0.37 * total AS goal FROM a), f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY i) AS o FROM t WHERE goal <= before + len)
SELECT image_id, {s6('x + (goal - before) / len * (nx - x)')} AS x, {s6('y + (goal - before) / len * (ny - y)')} AS y FROM f WHERE o = 1""")
def q_arc_at(spark, sf_dir):
    at = _chains(spark, sf_dir).select("image_id", H.arc_at(F.col("chain"), F.lit(0.37)).alias("p"))
    return at.select("image_id", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@query("q_ruled_grid")
def q_ruled_grid(spark, sf_dir):
    """The source points of a 4 x 6 output of a page whose upper side is a chain."""
    top = F.col("chain")
    first, last = F.get(top, F.lit(0)), F.element_at(top, -1)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    below = F.lit(60.0)
    bl, br = point(first["x"], below), point(last["x"], below)
    grid = _chains(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(5))))
    p = H.coons_point(top, F.array(last, br), F.array(bl, br), F.array(first, bl), F.col("x") / 5.0, F.col("y") / 3.0)
    return grid.select("image_id", "y", "x", p.alias("p")).select("image_id", "y", "x", r6(F.col("p.x")).alias("u"), r6(F.col("p.y")).alias("v"))
