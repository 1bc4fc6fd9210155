"""Queries of highlight repair, detail and set-like operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import highlights as H
from pixelloom.operators.bayer import pack_rggb
from pixelloom.plans.base import mosaic8, pa4, px4, query, r6, s6, with_sql

ID = ["image_id"]
_PLANE = "((y % 2) * 2 + x % 2)"
_CELL = f"(CASE WHEN {_PLANE} = cfa THEN 0 WHEN {_PLANE} = 3 - cfa THEN 3 WHEN y % 2 = cfa // 2 THEN 1 ELSE 2 END)"
_F = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
_H = ", ".join(f"avg(b{k}) OVER (PARTITION BY image_id, cy ORDER BY cx {_F}) AS b{k}" for k in range(4))
_V = ", ".join(f"avg(b{k}) OVER (PARTITION BY image_id, cx ORDER BY cy {_F}) AS b{k}" for k in range(4))
_S = lambda x: f"(greatest(0.0, least(1.0, {x})) * greatest(0.0, least(1.0, {x})) * (3.0 - 2.0 * greatest(0.0, least(1.0, {x}))))"


@query("q_highlight_repair", f"""{with_sql('mosaic8', 'pa4')}, c AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx, """ + ", ".join(f"max(CASE WHEN {_CELL} = {k} AND raw >= 522.5 THEN 1.0 ELSE 0.0 END) AS b{k}" for k in range(4)) + f""" FROM mosaic8 GROUP BY image_id, y // 2, x // 2),
h AS (SELECT image_id, cy, cx, {_H} FROM c), n AS (SELECT image_id, cy, cx, {_V} FROM h),
j AS (SELECT p.image_id, p.y, p.x, p.r, p.g, p.b, n.b0 AS sr, greatest(n.b1, n.b2) AS sg, n.b3 AS sb, greatest(p.r, p.g, p.b) AS peak FROM pa4 AS p JOIN n ON n.image_id = p.image_id AND n.cy = p.y // 2 AND n.cx = p.x // 2),
u AS (SELECT image_id, y, x, r + (peak - r) * {_S('sr')} AS r, g + (peak - g) * {_S('sg')} AS g, b + (peak - b) * {_S('sb')} AS b, 0.65 * {_S('greatest(sr, sg, sb)')} AS s FROM j),
l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l FROM u)
SELECT image_id, y, x, {s6('r + (l - r) * s')} AS r, {s6('g + (l - g) * s')} AS g, {s6('b + (l - b) * s')} AS b FROM l""")
def q_highlight_repair(spark, sf_dir):
    out = H.repaired_highlights(pa4(spark, sf_dir), pack_rggb(mosaic8(spark, sf_dir), ID, white=523.0), ID)
    return out.select("image_id", "y", "x", *(r6(F.col(c)).alias(c) for c in "rgb"))


_W = lambda o: f"avg(s) OVER (PARTITION BY image_id, {'y' if o == 'x' else 'x'} ORDER BY {o} {_F})"


@query("q_detail_layer", f"""{with_sql('pa4')}, l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS f, 0.2126 * r + 0.7152 * g + 0.0722 * b AS s FROM pa4),
h AS (SELECT image_id, y, x, r, g, b, f, {_W('x')} AS s FROM l), v AS (SELECT image_id, y, x, r, g, b, f, {_W('y')} AS s FROM h),
k AS (SELECT *, 1.0 + 0.55 * (greatest(0.25, least(4.0, f / greatest(s, 0.000001))) - 1.0) AS k FROM v)
SELECT image_id, y, x, {s6('r * k')} AS r, {s6('g * k')} AS g, {s6('b * k')} AS b FROM k""")
def q_detail_layer(spark, sf_dir):
    out = H.detail_layer(pa4(spark, sf_dir), pa4(spark, sf_dir), ID, 0.55)
    return out.select("image_id", "y", "x", *(r6(F.col(c)).alias(c) for c in "rgb"))


@query("q_point_dedupe", f"{with_sql('px4')} SELECT DISTINCT image_id, CAST(floor(r * 10) AS BIGINT) AS px, CAST(floor(g * 10) AS BIGINT) AS py FROM px4")
def q_point_dedupe(spark, sf_dir):
    return px4(spark, sf_dir).select("image_id", F.floor(F.col("r") * 10).alias("px"), F.floor(F.col("g") * 10).alias("py")).dropDuplicates()


@query("q_mask_difference", f"{with_sql('px4')} SELECT image_id, y, x FROM px4 WHERE (r > 0 OR g > 0.1) AND NOT b > 0")
def q_mask_difference(spark, sf_dir):
    """Pixels of either of two masks, without those of a third."""
    p = px4(spark, sf_dir)
    at = ["image_id", "y", "x"]
    return p.where("r > 0").select(*at).unionByName(p.where("g > 0.1").select(*at)).dropDuplicates().join(p.where("b > 0").select(*at), at, "left_anti")
