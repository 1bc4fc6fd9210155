"""Queries of line voting and connected components."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import components as K
from pixelloom.operators import lines as L
from pixelloom.plans.base import px8, query, r6, s6, with_sql

ID = ["image_id"]
_VOTES = f"""{with_sql('px8')}, t AS (SELECT image_id, y, x, unnest([0, 30, 45, 60, 61, 62, 90, 91, 92, 120]) AS theta FROM px8 WHERE v > 0.12),
h AS (SELECT image_id, theta, CAST(floor(round(x * cos(theta * (pi() / 180.0)) + y * sin(theta * (pi() / 180.0)), 6) + 0.5) AS BIGINT) AS rho, count(*) AS votes FROM t GROUP BY 1, 2, 3)"""
_THETAS = [0, 30, 45, 60, 61, 62, 90, 91, 92, 120]


def _votes(spark, sf_dir):
    return L.hough_votes(px8(spark, sf_dir).where("v > 0.12"), ID, _THETAS)


@query("q_hough_votes", f"{_VOTES} SELECT image_id, theta, rho, votes FROM h")
def q_hough_votes(spark, sf_dir):
    return _votes(spark, sf_dir)


@query("q_hough_nms", f"{_VOTES} SELECT image_id, theta, rho, votes FROM h AS p WHERE votes >= 2 AND NOT EXISTS (SELECT 1 FROM h AS q WHERE q.image_id = p.image_id AND q.theta BETWEEN p.theta - 1 AND p.theta + 1 AND q.rho BETWEEN p.rho - 2 AND p.rho + 2 AND q.votes > p.votes)")
def q_hough_nms(spark, sf_dir):
    return L.peaks(_votes(spark, sf_dir), ID, 2)


@query("q_hough_top", f"{_VOTES}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, theta, rho) AS id FROM h) SELECT image_id, theta, rho, votes, CAST(id AS INTEGER) AS id FROM k WHERE id <= 3")
def q_hough_top(spark, sf_dir):
    return L.strongest(_votes(spark, sf_dir), ID, 3)


@query("q_line_quads")
def q_line_quads(spark, sf_dir):
    edges = px8(spark, sf_dir).where("v > 0.12").withColumns({"x": F.col("x") * 12, "y": F.col("y") * 12})
    family = lambda thetas: L.strongest(L.peaks(L.hough_votes(edges, ID, thetas), ID, 2), ID)
    return L.line_quads(family(range(80, 101)), family([*range(0, 11), *range(170, 180)]), ID, 96.0, 96.0)


_REACH = f"""{with_sql('px8').replace('WITH ', 'WITH RECURSIVE ', 1)}, m AS (SELECT image_id, y, x, y * 4294967296 + x AS node FROM px8 WHERE v > 0.03),
e AS (SELECT a.image_id, a.node AS u, b.node AS v FROM m AS a JOIN m AS b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT image_id, node AS u, node AS v FROM m UNION SELECT r.image_id, r.u, e.v FROM reach AS r JOIN e ON e.image_id = r.image_id AND e.u = r.v),
c AS (SELECT image_id, u, min(v) AS label FROM reach GROUP BY image_id, u)"""


def _components(spark, sf_dir):
    return K.components(px8(spark, sf_dir).withColumn("hit", F.col("v") > 0.03), ID, "hit")


@query("q_components", f"{_REACH} SELECT c.image_id, c.label, count(*) AS n, {s6('avg(x)')} AS cx, {s6('avg(y)')} AS cy FROM c JOIN m ON m.image_id = c.image_id AND m.node = c.u GROUP BY c.image_id, c.label")
def q_components(spark, sf_dir):
    out = K.component_sizes(_components(spark, sf_dir), ID)
    return out.select("image_id", "label", "n", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


@query("q_largest_component", f"{_REACH}, s AS (SELECT image_id, label, count(*) AS n FROM c GROUP BY image_id, label), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS k FROM s) SELECT image_id, label, n FROM k WHERE k = 1")
def q_largest_component(spark, sf_dir):
    return K.largest(_components(spark, sf_dir), ID).select("image_id", "label", "n")


@query("q_line_merge")
def q_line_merge(spark, sf_dir):
    return L.merged(_votes(spark, sf_dir), ID, apart=2.0)


@query("q_line_refine", f"""{_VOTES}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, theta, rho) AS id FROM h), t3 AS (SELECT * FROM k WHERE id <= 3),
d AS (SELECT t3.image_id, t3.theta, t3.rho, avg(p.x * cos(theta * (pi() / 180.0)) + p.y * sin(theta * (pi() / 180.0))) AS m, count(*) AS n FROM t3 JOIN px8 AS p ON p.image_id = t3.image_id AND p.v > 0.12 AND abs(p.x * cos(theta * (pi() / 180.0)) + p.y * sin(theta * (pi() / 180.0)) - rho) <= 1.5 GROUP BY 1, 2, 3)
SELECT t3.image_id, t3.theta, t3.rho, {s6('CASE WHEN n >= 3 THEN m ELSE t3.rho END')} AS rho_fit FROM t3 LEFT JOIN d USING (image_id, theta, rho)""")
def q_line_refine(spark, sf_dir):
    top = L.strongest(_votes(spark, sf_dir), ID, 3).select("image_id", "theta", "rho")
    out = L.refined(top, px8(spark, sf_dir).where("v > 0.12"), ID, 1.5, 3)
    return out.select("image_id", "theta", "rho", r6(F.col("rho_fit")).alias("rho_fit"))


@query("q_space_outline")
def q_space_outline(spark, sf_dir):
    from pixelloom.session import table

    chain = F.transform("embedding", lambda v, i: F.struct((i * 3.0).alias("x"), (v.cast("double") * 40.0).alias("y")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.size(L.spaced(chain, 12.0)).alias("kept"))
