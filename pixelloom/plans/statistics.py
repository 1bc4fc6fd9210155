"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.operators import statistics as S
from pixelloom.plans.base import mosaic8, pa4, px4, px8, query, r6, s6, with_sql
from pixelloom.session import table

ID = ["image_id"]
LUMA = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
_HIST = f"""{with_sql('pa4')}, l AS (SELECT image_id, {LUMA} AS l FROM pa4),
h AS (SELECT image_id, CAST(floor(greatest(0.0, least(255.0, (log2(l) + 16.0) * 8.0))) AS BIGINT) AS bin, count(*) AS n FROM l WHERE l > 0 GROUP BY 1, 2)"""


def _luma():
    return C.luma(F.col("r"), F.col("g"), F.col("b"))


@query("q_luma_hist", f"{_HIST} SELECT image_id, bin, n FROM h")
def q_luma_hist(spark, sf_dir):
    return S.luma_histogram(pa4(spark, sf_dir), ID, _luma())


@query("q_auto_exposure", f"""{_HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY image_id) AS total FROM h),
p AS (SELECT image_id, pow(2.0, min(CASE WHEN seen >= floor(0.995 * total) THEN bin END) / 8.0 - 16.0) AS p995, pow(2.0, min(CASE WHEN seen >= floor(0.9999 * total) THEN bin END) / 8.0 - 16.0) AS p9999 FROM c GROUP BY image_id),
e AS (SELECT *, greatest(-8.0, least(8.0, log2(1000.0 / 203.0) + 0.5 * greatest(-2.0, least(2.0, -log2(greatest(p995, 0.0001)) - log2(1000.0 / 203.0))))) AS ev FROM p)
SELECT image_id, {s6('p995')} AS p995, {s6('ev')} AS ev, {s6('greatest(1.0, least(16.0, p9999 * pow(2.0, ev)))')} AS white FROM e""")
def q_auto_exposure(spark, sf_dir):
    out = S.auto_exposure(S.luma_histogram(pa4(spark, sf_dir), ID, _luma()), ID)
    return out.select("image_id", r6(F.col("p995")).alias("p995"), r6(F.col("ev")).alias("ev"), r6(F.col("white")).alias("white"))


@query("q_order_stat", """WITH o AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem)
SELECT flag, status, min(CASE WHEN i >= floor(0.02 * (n - 1)) THEN v END) AS p02, min(CASE WHEN i >= floor(0.5 * (n - 1)) THEN v END) AS p50, min(CASE WHEN i >= floor(0.98 * (n - 1)) THEN v END) AS p98 FROM o GROUP BY flag, status""")
def q_order_stat(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_extendedprice")
    return S.order_statistics(rows, ["flag", "status"], "l_extendedprice", {"p02": 0.02, "p50": 0.5, "p98": 0.98})


_BYTE = "CAST(floor(least(255.0, abs(v) * 700)) AS BIGINT)"


@query("q_otsu", f"""{with_sql('px8')}, c AS (SELECT image_id, {_BYTE} AS t, CAST(count(*) AS DOUBLE) AS n FROM px8 GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY t) AS w0, sum(n * t) OVER (PARTITION BY image_id ORDER BY t) AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * t) OVER (PARTITION BY image_id) AS s FROM c),
b AS (SELECT image_id, t, CASE WHEN w - w0 > 0 THEN w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) ELSE 0.0 END AS b FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY b DESC, t) AS k FROM b)
SELECT image_id, t AS threshold, {s6('b')} AS between FROM r WHERE k = 1""".replace(" AS between", ' AS "between"'))
def q_otsu(spark, sf_dir):
    byte = F.floor(F.least(F.lit(255.0), F.abs("v") * 700))
    return S.otsu(px8(spark, sf_dir).withColumn("byte", byte), ID, "byte").select("image_id", "threshold", r6(F.col("between")).alias("between"))


@query("q_trimmed_mean", f"""WITH o AS (SELECT l_returnflag AS flag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT flag, {s6('avg(v)')} AS mean FROM o WHERE i >= floor(n * 0.05) AND i < n - floor(n * 0.05) GROUP BY flag""")
def q_trimmed_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return S.trimmed_mean(rows, ["flag"], "l_quantity").select("flag", r6(F.col("mean")).alias("mean"))


@query("q_channel_stats", f"{with_sql('px4')} SELECT image_id, " + ", ".join(f"{s6(f'{f}({c})')} AS {n}_{c}" for c in "rgb" for n, f in (("min", "min"), ("mean", "avg"), ("max", "max"))) + f", {s6('avg(abs(r - b))')} AS red_blue, {s6('avg(abs(g - (r + b) / 2))')} AS green_magenta FROM px4 GROUP BY image_id")
def q_channel_stats(spark, sf_dir):
    out = S.channel_statistics(px4(spark, sf_dir), ID)
    return out.select("image_id", *(r6(F.col(c)).alias(c) for c in out.columns[1:]))


_PLANE = "((y % 2) * 2 + x % 2)"
_COLOUR = f"(CASE WHEN {_PLANE} = cfa THEN 0 WHEN {_PLANE} = 3 - cfa THEN 2 ELSE 1 END)"


@query("q_clip_census", f"{with_sql('mosaic8')} SELECT image_id, {_COLOUR} AS colour, count(*) FILTER (WHERE raw >= 400 - 0.5) AS clipped, count(*) AS total FROM mosaic8 GROUP BY 1, 2")
def q_clip_census(spark, sf_dir):
    return S.clip_census(mosaic8(spark, sf_dir), ID, white=400.0)


@query("q_bbox", f"{with_sql('px8')} SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM px8 WHERE v > 0.1 GROUP BY image_id")
def q_bbox(spark, sf_dir):
    return S.bounding_box(px8(spark, sf_dir).where("v > 0.1"), ID)


@query("q_ca_centroid", f"""{with_sql('mosaic8')}, c AS (SELECT image_id, {_COLOUR} AS colour, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM mosaic8 WHERE (raw - 64.0) / 959.0 >= 0.2 GROUP BY 1, 2)
SELECT c.image_id, c.colour, c.n, {s6('c.cx - g.cx')} AS dx, {s6('c.cy - g.cy')} AS dy FROM c JOIN c AS g ON g.image_id = c.image_id AND g.colour = 1""")
def q_ca_centroid(spark, sf_dir):
    m = mosaic8(spark, sf_dir)
    levels = m.select("image_id", "y", "x", C.cfa_colour(F.col("cfa"), F.col("y"), F.col("x")).alias("colour"), ((F.col("raw") - 64.0) / 959.0).alias("level"))
    out = S.colour_centroids(levels, ID, least=0.2)
    return out.select("image_id", "colour", "n", r6(F.col("dx")).alias("dx"), r6(F.col("dy")).alias("dy"))


@query("q_ring_stats", f"""{with_sql('pa4')}, d AS (SELECT *, sqrt((x - 1.5) * (x - 1.5) + (y - 1.5) * (y - 1.5)) AS d FROM pa4 WHERE g > 0.01),
k AS (SELECT *, CASE WHEN d < 1.0 THEN 0 WHEN d < 2.0 THEN 1 WHEN d < 4.0 THEN 2 END AS ring FROM d)
SELECT image_id, ring, {s6('avg(r / g)')} AS rg, {s6('avg(b / g)')} AS bg, count(*) AS n FROM k WHERE ring IS NOT NULL GROUP BY image_id, ring""")
def q_ring_stats(spark, sf_dir):
    centres = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(1.5).alias("cx"), F.lit(1.5).alias("cy"))
    out = S.ring_statistics(pa4(spark, sf_dir), centres, ID, [(0.0, 1.0), (1.0, 2.0), (2.0, 4.0)])
    return out.select("image_id", "ring", r6(F.col("rg")).alias("rg"), r6(F.col("bg")).alias("bg"), "n")


@query("q_ensemble_moments", f"{with_sql('px8')} SELECT image_id % 50 AS image_id, y, x, {s6('avg(v)')} AS mean, {s6('greatest(avg(v * v) - avg(v) * avg(v), 0.0)')} AS variance FROM px8 GROUP BY image_id % 50, y, x")
def q_ensemble_moments(spark, sf_dir):
    out = S.ensemble_moments(px8(spark, sf_dir).withColumn("image_id", F.col("image_id") % 50), ["image_id", "y", "x"], "v")
    return out.select("image_id", "y", "x", r6(F.col("mean")).alias("mean"), r6(F.col("variance")).alias("variance"))


@query("q_paper_balance", f"""{with_sql('pa4')}, s AS (SELECT image_id, r + 0.4 AS r, g + 0.42 AS g, b + 0.38 AS b FROM pa4),
l AS (SELECT *, {LUMA} AS l FROM s),
k AS (SELECT * FROM l WHERE l > 0.05 AND (greatest(r, g, b) - least(r, g, b) < 0.12 OR greatest(r, g, b) - least(r, g, b) < 0.22 * greatest(l, 0.0001))),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY l) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM k),
c AS (SELECT *, min(CASE WHEN i >= floor(0.6 * (n - 1)) THEN l END) OVER (PARTITION BY image_id) AS cut FROM o),
m AS (SELECT image_id, count(*) AS n, avg(r) FILTER (WHERE l >= cut) AS r, avg(g) FILTER (WHERE l >= cut) AS g, avg(b) FILTER (WHERE l >= cut) AS b FROM c GROUP BY image_id HAVING count(*) >= 8)
SELECT image_id, n, """ + ", ".join(f"{s6(f'greatest(0.5, least(2.0, ((r + g + b) / 3.0) / greatest({c}, 0.0001)))')} AS gain_{c}" for c in "rgb") + " FROM m")
def q_paper_balance(spark, sf_dir):
    lit = pa4(spark, sf_dir).select("image_id", (F.col("r") + 0.4).alias("r"), (F.col("g") + 0.42).alias("g"), (F.col("b") + 0.38).alias("b"))
    out = S.paper_balance(lit, ID, least=8)
    return out.select("image_id", "n", *(r6(F.col(f"gain_{c}")).alias(f"gain_{c}") for c in "rgb"))
