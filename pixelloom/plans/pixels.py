"""Queries of the per-pixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.plans.base import mosaic8, pa4, px4, px8, query, r6, s6, with_sql

def rgb() -> list:
    return [F.col(c) for c in "rgb"]

LUMA = "(0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2})"
LUMA_RGB = LUMA.format("r", "g", "b")


def _enc(x: str) -> str:
    c = f"greatest(0.0, least(1.0, {x}))"
    return f"(CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow({c}, 1.0 / 2.4) - 0.055 END)"


def _smooth(t: str) -> str:
    c = f"greatest(0.0, least(1.0, {t}))"
    return f"({c} * {c} * (3.0 - 2.0 * {c}))"


@query("q_luma", f"{with_sql('px4')} SELECT image_id, y, x, {s6(LUMA_RGB)} AS luma709, {s6('0.2627 * r + 0.678 * g + 0.0593 * b')} AS luma2020 FROM px4")
def q_luma(spark, sf_dir):
    return px4(spark, sf_dir).select("image_id", "y", "x", r6(C.luma(*rgb())).alias("luma709"), r6(C.luma(*rgb(), C.LUMA_2020)).alias("luma2020"))


@query("q_srgb_encode", f"{with_sql('px4')} SELECT image_id, y, x, CAST(floor(255.0 * {_enc('r * 3')} + 0.5) AS BIGINT) AS byte, {s6(_enc('g'))} AS encoded, {s6('CASE WHEN greatest(b * 4, 0.0) <= 0.0031308 THEN 12.92 * greatest(b * 4, 0.0) ELSE 1.055 * pow(greatest(b * 4, 0.0), 1.0 / 2.4) - 0.055 END')} AS open_encoded FROM px4")
def q_srgb_encode(spark, sf_dir):
    return px4(spark, sf_dir).select("image_id", "y", "x", C.to_srgb8(F.col("r") * 3).alias("byte"), r6(C.srgb_encode(F.col("g"))).alias("encoded"), r6(C.srgb_encode(F.col("b") * 4, lower_only=True)).alias("open_encoded"))


_DITHER = "([0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5][(y % 4) * 4 + x % 4 + 1] / 16.0 - 0.5)"


@query("q_dither_encode", f"{with_sql('px8')} SELECT image_id, y, x, {s6(_DITHER)} AS dither, CAST(floor(greatest(0.0, least(255.0, 255.0 * {_enc('v * 2')} + {_DITHER}))) AS BIGINT) AS byte FROM px8")
def q_dither_encode(spark, sf_dir):
    d = C.bayer_dither(F.col("y"), F.col("x"))
    return px8(spark, sf_dir).select("image_id", "y", "x", r6(d).alias("dither"), C.to_srgb8_dithered(F.col("v") * 2, d).alias("byte"))


def _roll(x: str, w: str) -> str:
    a = f"(({x} - 0.8) / greatest({w} - 0.8, 0.0001))"
    top = f"(least(1.0, {w}) - 0.8)"
    d = f"(greatest({w} - 0.8, 0.0001) / greatest({top}, 0.0001))"
    return f"(CASE WHEN {x} <= 0.8 THEN {x} ELSE 0.8 + {top} * {a} * (1.0 + {a} / {d}) / (1.0 + {a}) END)"


@query("q_rolloff", f"{with_sql('pa4')} SELECT image_id, y, x, {s6(_roll('(r * 5)', '2.0'))} AS white2, {s6(_roll('(g * 5)', '1.0'))} AS white1 FROM pa4")
def q_rolloff(spark, sf_dir):
    return pa4(spark, sf_dir).select("image_id", "y", "x", r6(C.rolloff(F.col("r") * 5, 2.0)).alias("white2"), r6(C.rolloff(F.col("g") * 5, 1.0)).alias("white1"))


_TONED = f"""{with_sql('px4')}, e AS (SELECT image_id, y, x, greatest(r * 2.0, 0.0) AS r, greatest(g * 2.0, 0.0) AS g, greatest(b * 2.0, 0.0) AS b FROM px4),
l AS (SELECT *, 0.2627 * r + 0.678 * g + 0.0593 * b AS lum FROM e),
t AS (SELECT image_id, y, x, r, g, b, CASE WHEN lum > 0.000001 THEN {_roll('lum', '1.5')} / lum ELSE 1.0 END AS k FROM l)
SELECT image_id, y, x, {s6('1.6605 * (r * k) + -0.5876 * (g * k) + -0.0728 * (b * k)')} AS r, {s6('-0.1246 * (r * k) + 1.1329 * (g * k) + -0.0083 * (b * k)')} AS g, {s6('-0.0182 * (r * k) + -0.1006 * (g * k) + 1.1187 * (b * k)')} AS b FROM t"""


@query("q_tone_map", _TONED)
def q_tone_map(spark, sf_dir):
    out = C.tone_mapped(*rgb(), ev=1.0, white=1.5, wide=True)
    return px4(spark, sf_dir).select("image_id", "y", "x", *(r6(v).alias(c) for c, v in zip("rgb", out)))


@query("q_toe", f"""{with_sql('px4')}, l AS (SELECT *, {LUMA_RGB} AS lum FROM px4),
u AS (SELECT *, CASE WHEN lum > 0.00000001 THEN log2(lum / (0.18 * (203.0 / 1000.0) * pow(2.0, -0.5))) END AS u FROM l),
s AS (SELECT *, CASE WHEN u IS NULL THEN 0.0 WHEN u >= -log2(0.18) THEN 1.0 ELSE pow(2.0, 0.25 * u * (1.0 - (greatest(u, 0.0) / 2.474) * (greatest(u, 0.0) / 2.474) * (3.0 - 2.0 * (greatest(u, 0.0) / 2.474)))) END AS k FROM u)
SELECT image_id, y, x, {s6('r * k')} AS r, {s6('g * k')} AS g, {s6('b * k')} AS b FROM s""")
def q_toe(spark, sf_dir):
    return px4(spark, sf_dir).select("image_id", "y", "x", *(r6(v).alias(c) for c, v in zip("rgb", C.shadow_toe(*rgb(), ev=0.5))))


@query("q_vibrance", f"""{with_sql('px4')}, l AS (SELECT *, greatest({LUMA_RGB}, 0.0) AS lum FROM px4),
c AS (SELECT *, least(greatest(r - lum, g - lum, b - lum, 0.0) / greatest(lum, 0.0001), 1.0) AS c FROM l),
e AS (SELECT *, 1.15 - 0.15 * c * c AS k FROM c)
SELECT image_id, y, x, {s6('lum + (r - lum) * k')} AS r, {s6('lum + (g - lum) * k')} AS g, {s6('lum + (b - lum) * k')} AS b FROM e""")
def q_vibrance(spark, sf_dir):
    return px4(spark, sf_dir).select("image_id", "y", "x", *(r6(v).alias(c) for c, v in zip("rgb", C.vibrance(*rgb(), 1.15))))


@query("q_white_score", f"{with_sql('px4')} SELECT image_id, y, x, {s6('CASE WHEN greatest(r, g, b) <= 0.0001 THEN 0.0 ELSE least(r, g, b) / greatest(r, g, b) END')} AS score, (greatest(r, g, b) - least(r, g, b) < 0.12 OR greatest(r, g, b) - least(r, g, b) < 0.22 * greatest({LUMA_RGB}, 0.0001)) AS grey FROM px4")
def q_white_score(spark, sf_dir):
    return px4(spark, sf_dir).select("image_id", "y", "x", r6(C.white_score(*rgb())).alias("score"), C.low_chroma(*rgb(), C.luma(*rgb())).alias("grey"))


_GAINS = "CASE WHEN r > 0.000001 AND g > 0.000001 AND b > 0.000001 THEN 1.0 / {0} ELSE 1.0 END"


@query("q_wb_gain", f"{with_sql('px4')} SELECT image_id, y, x, {', '.join(f'{s6(_GAINS.format(c))} AS gain_{c}' for c in 'rgb')} FROM px4")
def q_wb_gain(spark, sf_dir):
    return px4(spark, sf_dir).select("image_id", "y", "x", *(r6(v).alias(f"gain_{c}") for c, v in zip("rgb", C.wb_gains(rgb()))))


@query("q_bt2020_to_srgb", f"{with_sql('px4')} SELECT image_id, y, x, {s6('1.6605 * r + -0.5876 * g + -0.0728 * b')} AS r, {s6('-0.1246 * r + 1.1329 * g + -0.0083 * b')} AS g, {s6('-0.0182 * r + -0.1006 * g + 1.1187 * b')} AS b FROM px4")
def q_bt2020_to_srgb(spark, sf_dir):
    return px4(spark, sf_dir).select("image_id", "y", "x", *(r6(v).alias(c) for c, v in zip("rgb", C.mat3_apply(C.BT2020_TO_SRGB, *rgb()))))


_CCM = (1.8, -0.6, -0.2, -0.3, 1.5, -0.2, 0.1, -0.5, 1.4)


@query("q_ccm_apply", f"{with_sql('pa4')} SELECT image_id, y, x, " + ", ".join(f"{s6(f'greatest({_CCM[3 * k]} * r + {_CCM[3 * k + 1]} * g + {_CCM[3 * k + 2]} * b, 0.0) * pow(2.0, 0.5)')} AS {c}" for k, c in enumerate("rgb")) + " FROM pa4")
def q_ccm_apply(spark, sf_dir):
    gain = F.pow(F.lit(2.0), F.lit(0.5))
    return pa4(spark, sf_dir).select("image_id", "y", "x", *(r6(F.greatest(v, F.lit(0.0)) * gain).alias(c) for c, v in zip("rgb", C.mat3_apply(_CCM, *rgb()))))


_KNEE = "{0} * {1} + (greatest(r * 1.9, g * 1.0, b * 1.4) - {0} * {1}) * " + _smooth("({0} * 4 - 1.0 * 0.95) * (1.0 / greatest(1.0 - 1.0 * 0.95, 0.000001))")


@query("q_highlight_knee", f"{with_sql('pa4')} SELECT image_id, y, x, {s6(_KNEE.format('r', '1.9'))} AS r, {s6(_KNEE.format('g', '1.0'))} AS g, {s6(_KNEE.format('b', '1.4'))} AS b FROM pa4")
def q_highlight_knee(spark, sf_dir):
    out = C.highlight_knee([v * 4 for v in rgb()], [v * w for v, w in zip(rgb(), (1.9, 1.0, 1.4))])
    return pa4(spark, sf_dir).select("image_id", "y", "x", *(r6(v).alias(c) for c, v in zip("rgb", out)))


@query("q_cubic_weight", f"{with_sql('px8')} SELECT image_id, y, x, {s6('CASE WHEN abs(v * 5) < 1 THEN (1.5 * abs(v * 5) - 2.5) * abs(v * 5) * abs(v * 5) + 1.0 WHEN abs(v * 5) < 2 THEN ((-0.5 * abs(v * 5) + 2.5) * abs(v * 5) - 4.0) * abs(v * 5) + 2.0 ELSE 0.0 END')} AS weight FROM px8")
def q_cubic_weight(spark, sf_dir):
    return px8(spark, sf_dir).select("image_id", "y", "x", r6(C.cubic_weight(F.col("v") * 5)).alias("weight"))


@query("q_smoothstep", f"{with_sql('px8')} SELECT image_id, y, x, {s6(_smooth('(v * 4)'))} AS smooth, {s6(_smooth('(CAST(least(x, y, 7 - x, 7 - y) AS DOUBLE) / 4.0)'))} AS border, {s6('greatest(-0.1, least(0.1, v))')} AS clamped FROM px8")
def q_smoothstep(spark, sf_dir):
    eight = F.lit(8)
    return px8(spark, sf_dir).select("image_id", "y", "x", r6(C.smooth01(F.col("v") * 4)).alias("smooth"), r6(C.blend_weight(F.col("y"), F.col("x"), eight, eight)).alias("border"), r6(C.clampf(F.col("v"), -0.1, 0.1)).alias("clamped"))


_PLANE = "((y % 2) * 2 + x % 2)"
_COLOUR = f"(CASE WHEN {_PLANE} = cfa THEN 0 WHEN {_PLANE} = 3 - cfa THEN 2 ELSE 1 END)"


@query("q_mosaic_normalise", f"{with_sql('mosaic8')} SELECT image_id, y, x, {_PLANE} AS plane, {_COLOUR} AS colour, CASE WHEN {_COLOUR} = 0 THEN 0 WHEN {_COLOUR} = 2 THEN 3 WHEN y % 2 = cfa // 2 THEN 1 ELSE 2 END AS cell_colour, {s6(f'greatest(0.0, least(1.0, (raw - [64.0, 66.0, 68.0, 70.0][{_PLANE} + 1]) / greatest(1023.0 - [64.0, 66.0, 68.0, 70.0][{_PLANE} + 1], 1.0)))')} AS level, {s6(f'greatest((raw - [64.0, 66.0, 68.0, 70.0][{_PLANE} + 1]) / (1023.0 - [64.0, 66.0, 68.0, 70.0][{_PLANE} + 1]), 0.0)')} AS unclipped FROM mosaic8")
def q_mosaic_normalise(spark, sf_dir):
    y, x, cfa = F.col("y"), F.col("x"), F.col("cfa")
    black = F.get(F.array(*map(F.lit, (64.0, 66.0, 68.0, 70.0))), C.plane(y, x).cast("int"))
    return mosaic8(spark, sf_dir).select(
        "image_id", "y", "x", C.plane(y, x).cast("long").alias("plane"), C.cfa_colour(cfa, y, x).alias("colour"), C.cell_colour(cfa, y, x).alias("cell_colour"),
        r6(C.normalised(F.col("raw"), black, 1023.0)).alias("level"), r6(F.greatest((F.col("raw") - black) / (1023.0 - black), F.lit(0.0))).alias("unclipped"),
    )


@query("q_noise_variance", f"{with_sql('mosaic8')} SELECT image_id, y, x, {s6(f'[0.0001, 0.0002, 0.0004][{_COLOUR} + 1] * CAST(raw AS DOUBLE) + [0.5, 0.25, 0.125][{_COLOUR} + 1]')} AS variance FROM mosaic8")
def q_noise_variance(spark, sf_dir):
    noise = F.array(*map(F.lit, (0.0001, 0.5, 0.0002, 0.25, 0.0004, 0.125)))
    return mosaic8(spark, sf_dir).select("image_id", "y", "x", r6(C.noise_variance(F.col("raw"), noise, C.cfa_colour(F.col("cfa"), F.col("y"), F.col("x")))).alias("variance"))


_M = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE){' + 1.0' if i % 4 == 0 else ''} AS m{i}" for i in range(9))
_DET = "(m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6))"
_COF = ["m4 * m8 - m5 * m7", "m2 * m7 - m1 * m8", "m1 * m5 - m2 * m4", "m5 * m6 - m3 * m8", "m0 * m8 - m2 * m6", "m2 * m3 - m0 * m5", "m3 * m7 - m4 * m6", "m1 * m6 - m0 * m7", "m0 * m4 - m1 * m3"]


def _matrices(spark, sf_dir):
    from pixelloom.session import table

    m = F.array(*(F.get("embedding", F.lit(i)).cast("double") + (1.0 if i % 4 == 0 else 0.0) for i in range(9)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), m.alias("m"))


@query("q_mat3_inverse", f"WITH m AS (SELECT vec_id AS image_id, {_M} FROM embeddings) SELECT image_id, " + ", ".join(f"{s6(f'({c}) / {_DET}')} AS i{k}" for k, c in enumerate(_COF)) + f" FROM m WHERE abs({_DET}) >= 0.000000000001")
def q_mat3_inverse(spark, sf_dir):
    inverse = _matrices(spark, sf_dir).select("image_id", C.mat_inv(F.col("m")).alias("i")).where("i is not null")
    return inverse.select("image_id", *(r6(F.col("i")[k]).alias(f"i{k}") for k in range(9)))


_ADAPT = [sum(C.XYZ_D65_TO_SRGB[3 * r + k] * C.BRADFORD_D50_TO_D65[3 * k + c] for k in range(3)) for r in range(3) for c in range(3)]
_FULL = [" + ".join(f"({_ADAPT[3 * r + k]!r}) * m{3 * k + c}" for k in range(3)) for r in range(3) for c in range(3)]
_ROWS = ", ".join(f"{f} AS f{i}" for i, f in enumerate(_FULL))


@query("q_derive_ccm", f"WITH m AS (SELECT vec_id AS image_id, {_M} FROM embeddings), f AS (SELECT image_id, {_ROWS} FROM m) SELECT image_id, " + ", ".join(f"{s6(f'f{i} / (CASE WHEN abs(f{i // 3 * 3} + f{i // 3 * 3 + 1} + f{i // 3 * 3 + 2}) < 0.000000001 THEN 1.0 ELSE f{i // 3 * 3} + f{i // 3 * 3 + 1} + f{i // 3 * 3 + 2} END)')} AS c{i}" for i in range(9)) + " FROM f")
def q_derive_ccm(spark, sf_dir):
    none = F.lit(None).cast("array<double>")
    m = F.col("m")
    even = F.col("image_id") % 2 == 0
    ccm = C.derive_ccm(F.when(even, m), F.lit(21), F.when(~even, m), none)
    return _matrices(spark, sf_dir).select("image_id", ccm.alias("c")).select("image_id", *(r6(F.col("c")[k]).alias(f"c{k}") for k in range(9)))
