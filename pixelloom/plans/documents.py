"""Queries of page finishing and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import document as P
from pixelloom.operators import outlines as O
from pixelloom.operators.lookups import warp_grid
from pixelloom.plans.base import pa4, px8, quads, query, r6, s6, with_sql

ID = ["image_id"]


def _page(spark, sf_dir):
    """8 x 8 grey pages with a shadow toward the right."""
    shade = 1.0 - 0.09 * F.col("x")
    level = (0.8 + 0.2 * F.col("v")) * shade
    return px8(spark, sf_dir).select("image_id", "y", "x", *(level.alias(c) for c in "rgb"))


_PAGE = f"{with_sql('px8')}, pg AS (SELECT image_id, y, x, (0.8 + 0.2 * v) * (1.0 - 0.09 * x) AS l FROM px8)"
_LUM = "(0.2126 * l + 0.7152 * l + 0.0722 * l)"
_ROW, _COL = "PARTITION BY image_id, y ORDER BY x", "PARTITION BY image_id, x ORDER BY y"


def _field(radius: int) -> str:
    f = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"fh AS (SELECT image_id, y, x, avg({_LUM}) OVER ({_ROW} {f}) AS v FROM pg), fl AS (SELECT image_id, y, x, avg(v) OVER ({_COL} {f}) AS v FROM fh)"


@query("q_page_shade_ratio", f"""{_PAGE}, {_field(1)}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM fl)
SELECT image_id, {s6('min(CASE WHEN i >= floor(0.9 * (n - 1)) THEN v END) / greatest(min(CASE WHEN i >= floor(0.1 * (n - 1)) THEN v END), 0.0001)')} AS ratio FROM o GROUP BY image_id""")
def q_page_shade_ratio(spark, sf_dir):
    return P.shade_ratio(_page(spark, sf_dir), ID, 8, 8).select("image_id", r6(F.col("ratio")).alias("ratio"))


_TEST = _field(1).replace("fh AS", "th AS").replace("fl AS", "tl AS").replace("FROM fh", "FROM th")


@query("q_even_shading", f"""{_PAGE}, {_TEST}, {_field(2)}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM tl),
u AS (SELECT image_id FROM o GROUP BY image_id HAVING min(CASE WHEN i >= floor(0.9 * (n - 1)) THEN v END) / greatest(min(CASE WHEN i >= floor(0.1 * (n - 1)) THEN v END), 0.0001) >= 1.55),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM fl WHERE v > 0.02),
t AS (SELECT image_id, min(CASE WHEN i >= floor(0.9 * (n - 1)) THEN v END) AS target FROM k WHERE image_id IN (SELECT image_id FROM u) GROUP BY image_id),
s AS (SELECT image_id, y, x, least(greatest((y + 0.5) * 8 / 8 - 0.5, 0.0), 6.99) AS fv, least(greatest((x + 0.5) * 8 / 8 - 0.5, 0.0), 6.99) AS fu, l FROM pg),
b AS (SELECT s.*, (a.v * (1 - (fu - floor(fu))) + b.v * (fu - floor(fu))) * (1 - (fv - floor(fv))) + (c.v * (1 - (fu - floor(fu))) + d.v * (fu - floor(fu))) * (fv - floor(fv)) AS light FROM s
 JOIN fl AS a ON a.image_id = s.image_id AND a.y = floor(fv) AND a.x = floor(fu) JOIN fl AS b ON b.image_id = s.image_id AND b.y = floor(fv) AND b.x = floor(fu) + 1
 JOIN fl AS c ON c.image_id = s.image_id AND c.y = floor(fv) + 1 AND c.x = floor(fu) JOIN fl AS d ON d.image_id = s.image_id AND d.y = floor(fv) + 1 AND d.x = floor(fu) + 1)
SELECT b.image_id, b.y, b.x, {s6('l * coalesce(least(target / greatest(light, 0.22 * target), 4.0), 1.0)')} AS v FROM b LEFT JOIN t ON t.image_id = b.image_id""")
def q_even_shading(spark, sf_dir):
    out = P.even_shading(_page(spark, sf_dir), ID, 8, 8)
    return out.select("image_id", "y", "x", r6(F.col("g")).alias("v"))


@query("q_document_finish")
def q_document_finish(spark, sf_dir):
    out = P.finish_document(_page(spark, sf_dir), ID, 8, 8)
    return out.select("image_id", "y", "x", *(r6(F.col(c)).alias(c) for c in "rgb"))


@query("q_enhance_image")
def q_enhance_image(spark, sf_dir):
    """Vibrance, then sharpening."""
    from pixelloom.functions.color import vibrance
    from pixelloom.operators.windows import sharpen

    vivid = pa4(spark, sf_dir).withColumns(dict(zip("rgb", vibrance(*map(F.col, "rgb")))))
    return sharpen(vivid, ID).select("image_id", "y", "x", *(r6(F.col(c)).alias(c) for c in "rgb"))


def _scene(spark, sf_dir):
    """One 60 x 48 scene for each image: a bright page, the quad about the frame's middle, on a dark table."""
    from pixelloom.functions.geometry import inside_convex, quad_points

    grid = quads(spark, sf_dir).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(59))))
    return grid.select("image_id", "y", "x", F.when(inside_convex(F.col("x") * 100.0 / 60, F.col("y") * 100.0 / 48, quad_points(F.col("q"))), 0.9).otherwise(0.1).alias("v"))


@query("q_page_detect")
def q_page_detect(spark, sf_dir):
    return O.page_outlines(_scene(spark, sf_dir), "image_id", "v")


@query("q_hull")
def q_hull(spark, sf_dir):
    return O.hulls(px8(spark, sf_dir).where("v > 0.1"), "image_id")


@query("q_simplify")
def q_simplify(spark, sf_dir):
    return O.simplified(O.hulls(px8(spark, sf_dir).where("v > 0"), "image_id"), "image_id", 0.8)


@query("q_output_grid", f"{with_sql('quads')} SELECT image_id, {s6('x0')} AS u0, {s6('y0')} AS v0, {s6('x2')} AS u2, {s6('y2')} AS v2 FROM quads")
def q_output_grid(spark, sf_dir):
    """The warp takes the grid's corners to the quad's."""
    from pixelloom.functions.geometry import quad_points

    grid = warp_grid(quads(spark, sf_dir), ID, quad_points(F.col("q")), 7, 5)
    at = lambda y, x, c: F.max(F.when((F.col("y") == y) & (F.col("x") == x), F.col(c)))
    out = grid.groupBy("image_id").agg(at(0, 0, "u").alias("u0"), at(0, 0, "v").alias("v0"), at(4, 6, "u").alias("u2"), at(4, 6, "v").alias("v2"))
    return out.select("image_id", *(r6(F.col(c)).alias(c) for c in ("u0", "v0", "u2", "v2")))
