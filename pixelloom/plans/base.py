"""The registry of queries, and small rasters derived from the driver's tables in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The same rasters in SQL, to put after WITH.
SQL = {
    "px4": "px4 AS (SELECT vec_id AS image_id, i // 4 AS y, i % 4 AS x, CAST(embedding[4*i+1] AS DOUBLE) AS r, CAST(embedding[4*i+2] AS DOUBLE) AS g, CAST(embedding[4*i+3] AS DOUBLE) AS b, CAST(embedding[4*i+4] AS DOUBLE) AS a FROM (SELECT vec_id, embedding, unnest(range(0, 16)) AS i FROM embeddings))",
    "pa4": "pa4 AS (SELECT image_id, y, x, abs(r) AS r, abs(g) AS g, abs(b) AS b FROM px4)",
    "px8": "px8 AS (SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, CAST(embedding[i+1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings))",
    "mosaic8": "mosaic8 AS (SELECT image_id, y, x, CAST(floor(abs(v) * 2000) AS BIGINT) + 64 AS raw, image_id % 4 AS cfa FROM px8)",
    "quads": "quads AS (SELECT vec_id AS image_id, " + ", ".join(f"{base} + {scale} * CAST(embedding[{i + 1}] AS DOUBLE) AS {name}" for i, (name, base, scale) in enumerate([("x0", 10, 40), ("y0", 10, 40), ("x1", 90, 40), ("y1", 10, 40), ("x2", 90, 40), ("y2", 90, 40), ("x3", 10, 40), ("y3", 90, 40)])) + " FROM embeddings)",
}
_NEEDS = {"pa4": ["px4"], "mosaic8": ["px8"]}


def with_sql(*names: str) -> str:
    """WITH and the definitions of rasters and of what they need."""
    order: list[str] = []
    for name in names:
        order += [n for n in [*_NEEDS.get(name, []), name] if n not in order]
    return "WITH " + ", ".join(SQL[n] for n in order)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def r6(c: Column) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c.cast("double"), 6) + 0.0


def s6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


def _exploded(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding")
    return vectors.select("image_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))


def px4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 RGBA rasters: (image_id, y, x, r, g, b, a)."""
    at = lambda k: F.get("embedding", F.col("i") * 4 + k).cast("double")
    i = F.col("i")
    return _exploded(spark, sf_dir, 16).select("image_id", F.floor(i / 4).alias("y"), (i % 4).cast("long").alias("x"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), at(3).alias("a"))


def pa4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with absolute values, without alpha."""
    return px4(spark, sf_dir).select("image_id", "y", "x", *(F.abs(c).alias(c) for c in "rgb"))


def px8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grey rasters: (image_id, y, x, v)."""
    i = F.col("i")
    return _exploded(spark, sf_dir, 64).select("image_id", F.floor(i / 8).alias("y"), (i % 8).cast("long").alias("x"), F.get("embedding", i).cast("double").alias("v"))


def mosaic8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 sensor mosaics: (image_id, y, x, raw, cfa), black 64, white 1023."""
    return px8(spark, sf_dir).select("image_id", "y", "x", (F.floor(F.abs("v") * 2000) + 64).alias("raw"), (F.col("image_id") % 4).alias("cfa"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads about (10, 10) .. (90, 90) of a 100 x 100 frame: (image_id, q)."""
    corner = [(10, 10), (90, 10), (90, 90), (10, 90)]
    at = lambda i, base: float(base) + 40.0 * F.get("embedding", F.lit(i)).cast("double")
    q = F.array(*(F.struct(at(2 * i, x).alias("x"), at(2 * i + 1, y).alias("y")) for i, (x, y) in enumerate(corner)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), q.alias("q"))
