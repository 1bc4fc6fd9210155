"""Queries of the page finder, on scenes of a bright page made from each image's quad."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import finder as P
from pixelloom.plans.base import quads, query, r6
from pixelloom.plans.documents import _scene


def _rgb(spark, sf_dir):
    return _scene(spark, sf_dir).select("image_id", "y", "x", *(F.col("v").alias(c) for c in "rgb"))


def _rounded(found):
    corners = [F.transform(c, r6).alias(c) for c in ("px", "py")]
    return found.select("image_id", r6(F.col("score")).alias("score"), *corners)


@query("q_find_page")
def q_find_page(spark, sf_dir):
    return _rounded(P.find_pages(_rgb(spark, sf_dir), "image_id"))


@query("q_score_page")
def q_score_page(spark, sf_dir):
    """The scene's own quad, if its sides are borders of a page."""
    at = lambda c, n: F.transform("q", lambda p: p[c] * n / 100.0)
    given = quads(spark, sf_dir).select("image_id", at("x", 60).alias("px"), at("y", 48).alias("py"))
    return _rounded(P.score_pages(_rgb(spark, sf_dir), given, "image_id"))
