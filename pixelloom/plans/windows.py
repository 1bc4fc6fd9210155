"""Queries of the neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import windows as N
from pixelloom.plans.base import pa4, px8, query, r6, s6, with_sql

ID = ["image_id"]
ROW, COL = "PARTITION BY image_id, y ORDER BY x", "PARTITION BY image_id, x ORDER BY y"


def _separable(f: str, radius: int) -> str:
    frame = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"h AS (SELECT image_id, y, x, {f}(v) OVER ({ROW} {frame}) AS v FROM px8), f AS (SELECT image_id, y, x, {f}(v) OVER ({COL} {frame}) AS v FROM h)"


def _tap(value: str, order: str, k: int, n: int = 8) -> str:
    axis = order[-1]
    if k == 0:
        return value
    f = "lag" if k < 0 else "lead"
    edge = f"first_value({value}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" if k < 0 else f"last_value({value}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce({f}({value}, {abs(k)}) OVER ({order}), {edge})"


def _weighted(weights: tuple[float, ...], value: str, order: str) -> str:
    reach = len(weights) // 2
    return " + ".join(f"{_tap(value, order, k)} * {weights[k + reach]!r}" for k in range(-reach, reach + 1))


def _out(df):
    return df.select("image_id", "y", "x", r6(F.col("v")).alias("v"))


_V = f"SELECT image_id, y, x, {s6('v')} AS v FROM f"


@query("q_box_blur", f"{with_sql('px8')}, {_separable('avg', 1)} {_V}")
def q_box_blur(spark, sf_dir):
    return _out(N.box_blur(px8(spark, sf_dir), ID, "v", 1))


def _clamped(radius: int) -> str:
    sums = lambda order: "(" + " + ".join(_tap("v", order, k) for k in range(-radius, radius + 1)) + f") / {2 * radius + 1}"
    return f"h AS (SELECT image_id, y, x, {sums(ROW)} AS v FROM px8), f AS (SELECT image_id, y, x, {sums(COL)} AS v FROM h)"


@query("q_box_blur_clamp", f"{with_sql('px8')}, {_clamped(2)} {_V}")
def q_box_blur_clamp(spark, sf_dir):
    return _out(N.box_blur_clamped(px8(spark, sf_dir), ID, "v", 2))


@query("q_gauss7", f"{with_sql('px8')}, h AS (SELECT image_id, y, x, {_weighted(N.GAUSS7, 'v', ROW)} AS v FROM px8), f AS (SELECT image_id, y, x, {_weighted(N.GAUSS7, 'v', COL)} AS v FROM h) {_V}")
def q_gauss7(spark, sf_dir):
    return _out(N.gaussian7(px8(spark, sf_dir), ID, "v"))


@query("q_sobel", f"""{with_sql('px8')}, h AS (SELECT image_id, y, x, lead(v) OVER ({ROW}) - lag(v) OVER ({ROW}) AS d, lag(v) OVER ({ROW}) + 2 * v + lead(v) OVER ({ROW}) AS s FROM px8),
g AS (SELECT image_id, y, x, lag(d) OVER ({COL}) + 2 * d + lead(d) OVER ({COL}) AS gx, lead(s) OVER ({COL}) - lag(s) OVER ({COL}) AS gy FROM h)
SELECT image_id, y, x, {s6('gx')} AS gx, {s6('gy')} AS gy, {s6('sqrt(gx * gx + gy * gy)')} AS magnitude FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL""")
def q_sobel(spark, sf_dir):
    return N.sobel(px8(spark, sf_dir), ID, "v").select("image_id", "y", "x", *(r6(F.col(c)).alias(c) for c in ("gx", "gy", "magnitude")))


@query("q_dilate", f"{with_sql('px8')}, {_separable('max', 2)} {_V}")
def q_dilate(spark, sf_dir):
    return _out(N.extremum(px8(spark, sf_dir), ID, "v", 2, True))


@query("q_erode", f"{with_sql('px8')}, {_separable('min', 1)} {_V}")
def q_erode(spark, sf_dir):
    return _out(N.extremum(px8(spark, sf_dir), ID, "v", 1, False))


_F1 = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"


@query("q_close", f"{with_sql('px8')}, {_separable('max', 1)}, i AS (SELECT image_id, y, x, min(v) OVER ({ROW} {_F1}) AS v FROM f), e AS (SELECT image_id, y, x, min(v) OVER ({COL} {_F1}) AS v FROM i) SELECT image_id, y, x, {s6('v')} AS v FROM e")
def q_close(spark, sf_dir):
    return _out(N.close(px8(spark, sf_dir), ID, "v", 1))


_SUM5 = lambda order: "(" + " + ".join(_tap("bl", order, k) for k in range(-2, 3)) + ") / 5"


@query("q_sharpen", f"""{with_sql('pa4')}, l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l, 0.2126 * r + 0.7152 * g + 0.0722 * b AS bl FROM pa4),
h AS (SELECT image_id, y, x, r, g, b, l, {_SUM5(ROW)} AS bl FROM l), f AS (SELECT image_id, y, x, r, g, b, l, {_SUM5(COL)} AS bl FROM h),
d AS (SELECT *, l - bl AS d, greatest(0.02 * abs(bl), 0.001) AS fl FROM f),
t AS (SELECT *, greatest(0.0, least(1.0, (abs(d) - fl) / (2.0 * fl))) AS t FROM d),
s AS (SELECT *, greatest(-0.5 * abs(d), least(0.5 * abs(d), 0.4 * (CASE WHEN abs(d) <= fl THEN 0.0 ELSE t * t * (3.0 - 2.0 * t) END) * d)) AS s FROM t)
SELECT image_id, y, x, {s6('r + s')} AS r, {s6('g + s')} AS g, {s6('b + s')} AS b FROM s""")
def q_sharpen(spark, sf_dir):
    return N.sharpen(pa4(spark, sf_dir), ID).select("image_id", "y", "x", *(r6(F.col(c)).alias(c) for c in "rgb"))


@query("q_laplacian_energy", f"{with_sql('px8')}, e AS (SELECT image_id, abs(2 * v - lag(v) OVER ({ROW}) - lead(v) OVER ({ROW})) AS e FROM px8) SELECT image_id, {s6('avg(e)')} AS energy, count(*) AS n FROM e WHERE e IS NOT NULL GROUP BY image_id")
def q_laplacian_energy(spark, sf_dir):
    out = N.laplacian_energy(px8(spark, sf_dir), ID, "v")
    return out.select("image_id", r6(F.col("energy")).alias("energy"), "n")


@query("q_seam_ratio", f"""{with_sql('px8')}, e AS (SELECT image_id, x, abs(2 * v - lag(v) OVER ({ROW}) - lead(v) OVER ({ROW})) AS e, least(x % 7, 7 - x % 7) AS d FROM px8)
SELECT image_id, {s6('avg(CASE WHEN d <= 2 THEN e END)')} AS on_seam, {s6('avg(CASE WHEN d BETWEEN 3 AND 6 THEN e END)')} AS near_seam FROM e WHERE e IS NOT NULL AND x >= 1 GROUP BY image_id""")
def q_seam_ratio(spark, sf_dir):
    out = N.seam_ratio(px8(spark, sf_dir), ID, "v", 7)
    return out.select("image_id", r6(F.col("on_seam")).alias("on_seam"), r6(F.col("near_seam")).alias("near_seam"))


def _flagged(spark, sf_dir):
    return px8(spark, sf_dir).withColumn("hit", F.col("v") > 0)


_RUNS = f"{with_sql('px8')}, i AS (SELECT image_id, y, x, x - row_number() OVER ({ROW}) AS island FROM px8 WHERE v > 0), r AS (SELECT image_id, y AS line, min(x) AS start, max(x) AS stop FROM i GROUP BY image_id, y, island)"


@query("q_runs", f"{_RUNS} SELECT image_id, line, start, stop FROM r")
def q_runs(spark, sf_dir):
    return N.runs(_flagged(spark, sf_dir), ID, "hit")


@query("q_split_runs", f"{_RUNS}, k AS (SELECT image_id, line, count(*) AS k FROM r GROUP BY image_id, line) SELECT image_id, count(*) FILTER (WHERE k > 1) AS split FROM k GROUP BY image_id")
def q_split_runs(spark, sf_dir):
    return N.split_lines(_flagged(spark, sf_dir), ID, "hit")


@query("q_longest_run_gap", f"""{with_sql('px8')}, n AS (SELECT image_id, y, x, CASE WHEN x - lag(x) OVER ({ROW}) > 2 THEN 1 ELSE 0 END AS n FROM px8 WHERE v > 0.05),
g AS (SELECT *, sum(n) OVER ({ROW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n),
s AS (SELECT image_id, y AS line, max(x) - min(x) + 1 AS span, count(*) AS hits FROM g GROUP BY image_id, y, run),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, line ORDER BY span DESC, hits DESC) AS k FROM s)
SELECT image_id, line, span, hits FROM k WHERE k = 1""")
def q_longest_run_gap(spark, sf_dir):
    return N.longest_run(px8(spark, sf_dir).withColumn("hit", F.col("v") > 0.05), ID, "hit", gap=1)


@query("q_contour", f"""{with_sql('px8')}, m AS (SELECT image_id, y, x, CASE WHEN v > -0.05 THEN 1 ELSE 0 END AS f FROM px8),
t AS (SELECT *, coalesce(lag(f) OVER ({ROW}), 0) AS w, coalesce(lead(f) OVER ({ROW}), 0) AS e, coalesce(lag(f) OVER ({COL}), 0) AS n, coalesce(lead(f) OVER ({COL}), 0) AS s FROM m)
SELECT image_id, y, x FROM t WHERE f = 1 AND (w = 0 OR e = 0 OR n = 0 OR s = 0)""")
def q_contour(spark, sf_dir):
    return N.contour(px8(spark, sf_dir).withColumn("hit", F.col("v") > -0.05), ID, "hit").select("image_id", "y", "x")


@query("q_speckle", f"{with_sql('px8')}, {_separable('avg', 1)} SELECT f.image_id, f.y, f.x, {s6('f.v + sign(p.v - f.v) * greatest(abs(p.v - f.v) - 1.2 * 0.02, 0.0)')} AS v FROM f JOIN px8 AS p USING (image_id, y, x)")
def q_speckle(spark, sf_dir):
    return _out(N.speckle_threshold(px8(spark, sf_dir).withColumn("deviation", F.lit(0.02)), ID, "v", "deviation"))


_T = "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"


@query("q_text_blocks", f"""{with_sql('px8')}, a AS (SELECT image_id, y, x, abs(v) AS a, abs(v * v * 6) AS b FROM px8),
h AS (SELECT image_id, y, x, avg(a) OVER ({ROW} {_T}) AS a, avg(b) OVER ({ROW} {_T}) AS b FROM a), f AS (SELECT image_id, y, x, avg(a) OVER ({COL} {_T}) AS a, avg(b) OVER ({COL} {_T}) AS b FROM h)
SELECT image_id, y, x, (a > 0.1 AND b > 0.1) AS text FROM f""")
def q_text_blocks(spark, sf_dir):
    df = px8(spark, sf_dir).withColumn("w", F.col("v") * F.col("v") * 6)
    return N.text_blocks(df, ID, "v", "w", 0.1, half=2).select("image_id", "y", "x", "text")
