"""Connected components of masks, by runs instead of pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.windows import runs
from pixelloom.session import cut


def components(mask: DataFrame, by: list[str], flag: str, diagonal: bool = False) -> DataFrame:
    """(by, line, start, stop, label) of every run of the mask. The label is the component's first pixel, y * 2**32 + x.

    Runs of neighbouring lines that touch are linked. The least label moves along links and jumps to the label of its
    label, so rounds grow with the logarithm of a component's depth; each round is checkpointed."""
    found = cut(runs(mask, by, flag).withColumn("node", F.shiftleft("line", 32) + F.col("start")))
    reach = 1 if diagonal else 0
    below = found.select(*by, (F.col("line") - 1).alias("line"), F.col("start").alias("_a"), F.col("stop").alias("_b"), F.col("node").alias("_n"))
    touching = found.join(below, [*by, "line"]).where((F.col("_a") <= F.col("stop") + reach) & (F.col("_b") >= F.col("start") - reach))
    links = cut(touching.select(*by, F.col("node").alias("u"), F.col("_n").alias("v")).unionByName(touching.select(*by, F.col("_n").alias("u"), F.col("node").alias("v"))))
    labels = found.select(*by, "node", F.col("node").alias("label"))
    while True:
        offered = links.withColumnRenamed("v", "node").join(labels, [*by, "node"]).select(*by, F.col("u").alias("node"), "label")
        near = labels.unionByName(offered).groupBy(*by, "node").agg(F.min("label").alias("label"))
        jump = near.select(*by, F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(near.join(jump, [*by, "label"]).select(*by, "node", F.col("further").alias("label")))
        if new.join(labels.withColumnRenamed("label", "old"), [*by, "node"]).where("label <> old").isEmpty():
            return found.join(new, [*by, "node"]).drop("node")
        labels = new


def component_sizes(labelled: DataFrame, by: list[str]) -> DataFrame:
    """Pixels and centroid of each component."""
    n = F.col("stop") - F.col("start") + 1
    across = n * (F.col("start") + F.col("stop")) / 2.0
    return labelled.groupBy(*by, "label").agg(F.sum(n).alias("n"), (F.sum(across) / F.sum(n)).alias("cx"), (F.sum(n * F.col("line")) / F.sum(n)).alias("cy"))


def largest(labelled: DataFrame, by: list[str]) -> DataFrame:
    """The largest component of each group; the first of equals."""
    sizes = component_sizes(labelled, by)
    return sizes.groupBy(*by).agg(F.max(F.struct("n", (-F.col("label")).alias("back"), "cx", "cy")).alias("m")).select(*by, (-F.col("m.back")).alias("label"), "m.n", "m.cx", "m.cy")
