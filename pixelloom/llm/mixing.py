"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target number of words. Whole passes over the source are taken while the target
allows; the remaining budget is met by a subset of its documents. Documents are counted by exact length,
every length first gives its even share of the budget, larger lengths then fill up what rounding left,
and a bounded-knapsack dynamic programme over lengths and counts fits the rest as closely as any choice
of the documents left can. Which documents of a length are taken is decided by a seeded hash.

Only (source, length) counts reach the programme, one group per source, as many rows as the source has
distinct lengths. Documents of one source and length may be a third of all rows: they are dealt into
``SALTS`` parts by their hash and ranked within the part in which the count ends, never as one group.

Targets take one row a source in one task: sources are names of corpora, not URLs.

Defined results: null and empty texts have size 0 and are taken 0 times or with a whole pass, in words
0 either way; a null source is a source of its own, last in order; documents without an id take part,
their text decides ties; of equal rows any may be taken; an empty table, or one without words, gives
targets of 0; other columns pass through, and columns named as outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pixelloom.llm.support import fresh, word_count
from pixelloom.session import cut, ship

WEIGHTS, SHARE, MOST_PASSES, SEED, SALTS = (3, 1, 2), 1.5, 2, 11, 64
#: The dynamic programme covers a remaining budget of so many words at most.
PROGRAMME = 1 << 16


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Adds to each (source, source_size) its target: water-filling, so that target = min(most x size, weight x level).

    There is one row per source here, and sources are ordered as a whole."""
    order = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    cap = F.col("source_size") * F.lit(float(most))
    by_level = W.orderBy("fills_at", F.col("source").isNull(), "source")
    filled = ranked.withColumn("cap", cap).withColumn("fills_at", F.col("cap") / F.col("weight"))
    everything = W.partitionBy(F.lit(1))
    filled = filled.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
            "capped": F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    # With all sources that fill up earlier at their caps, this is the level. Where a source isn't filled by it, too many
    # may be taken for filled, which lowers it: the greatest of these is the true one.
    level = F.col("level")
    filled = filled.withColumn("own_level", (F.col("budget") - F.col("capped")) / F.col("open"))
    filled = filled.withColumn("level", F.max(F.when(F.col("own_level") <= F.col("fills_at"), F.col("own_level"))).over(everything))
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))
    return filled.select("source", "source_size", target.alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, programme: int = PROGRAMME) -> np.ndarray:
    """How many documents of each length (ascending, positive) to take for a sum nearest to the budget.

    Every length gives its even share; of what is left, more than ``programme`` words are filled by the longest documents
    that fit; the rest is fitted exactly by the programme. It needs 5 bytes for each of 2 x programme sums, whatever the lengths."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = counts * budget // total if total < 1 << 31 else np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((lengths * taken).sum())
    for i in range(len(lengths) - 1, -1, -1):
        if rest <= programme:
            break
        more = min(int(counts[i] - taken[i]), (rest - programme + int(lengths[i]) - 1) // int(lengths[i]), rest // int(lengths[i]))
        taken[i] += more
        rest -= more * int(lengths[i])
    if rest <= 0:
        return taken
    # A sum above twice the rest is further from it than none.
    span = 2 * rest + 1
    reach, first = np.zeros(span, dtype=bool), np.full(span, -1, dtype=np.int32)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    for i in range(int(np.searchsorted(lengths, span))):
        left, size = min(int(counts[i] - taken[i]), span // int(lengths[i])), 1
        while left > 0 and not reach[rest]:
            use = min(size, left)
            moved = use * int(lengths[i])
            if moved < span:
                new = np.flatnonzero(reach[: span - moved] & ~reach[moved:]) + moved
                # The step that first reaches a sum: what it adds to was reached before it.
                reach[new] = True
                first[new] = len(steps)
                steps.append((i, use))
            left, size = left - use, size * 2
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    goal = int(sums[np.argmin(np.abs(sums - rest))])
    while goal:
        i, use = steps[first[goal]]
        taken[i] += use
        goal -= use * int(lengths[i])
    return taken


def _quotas(histogram: DataFrame, programme: int) -> DataFrame:
    """For each source and length: whole passes, and the number of documents that are taken once more."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = int(target // size) if size else 0
        lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        extra = np.zeros(len(group), dtype=np.int64)
        some = lengths > 0
        if size and some.any():
            extra[some] = fit_budget(lengths[some], counts[some], min(size, max(0, round(target - passes * size))), programme)
        return pd.DataFrame({"source": group["source"], "size": lengths, "passes": passes, "extra": extra})

    ship(histogram.sparkSession)
    return histogram.groupBy("source").applyInPandas(one, "source string, size long, passes long, extra long")


def _salt(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(SALTS)).cast("int")


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST_PASSES, seed: int = SEED, programme: int = PROGRAMME) -> DataFrame:
    """One narrow row per document: doc_id, its text's hash, source, size, source_size, target and how often it is taken."""
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), hashed.alias("draw"))
    rows = cut(rows.withColumn("salt", _salt(F.col("draw"))))
    parts = rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = cut(parts.groupBy("source", "size").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("salt", "n"))).alias("parts")))
    goals = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    goals = cut(goals.withColumnRenamed("source", "gs"))
    lengths = histogram.join(goals, F.col("source").eqNullSafe(F.col("gs"))).select("source", "size", "n", "source_size", "target")
    quotas = _quotas(lengths, programme).withColumnsRenamed({"source": "qs", "size": "qz"})
    # Each part of a length gets its share of the count: the parts before it are taken whole.
    parts = histogram.join(quotas, F.col("source").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qz")))
    parts = parts.select("source", "size", "passes", "extra", "parts", F.explode(F.col("parts.salt")).alias("salt"))
    before = F.aggregate(F.filter("parts", lambda p: p["salt"] < F.col("salt")), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    parts = parts.withColumn("quota", F.greatest(F.lit(0), F.col("extra") - before)).drop("parts", "extra")
    parts = parts.join(goals, F.col("source").eqNullSafe(F.col("gs")))
    parts = parts.select(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("salt").alias("pt"), "passes", "quota", "source_size", "target")
    rank = F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("draw", "doc_id", "text_hash"))
    joined = rows.withColumn("rank", rank).join(parts, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")) & (F.col("salt") == F.col("pt")))
    return joined.select("doc_id", "text_hash", "source", "size", "source_size", "target", (F.col("passes") + (F.col("rank") <= F.col("quota")).cast("long")).alias("times"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    h, own, i, t, of, total, among, rank, copy = fresh(docs, "text_hash", "own_source", "i", "t", "of", "total", "among", "rank", "copy")
    plan = mix_plan(docs, text, source, **options).groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(t), F.col("source").alias(of)).agg(F.sum("times").alias(total), F.count(F.lit(1)).alias(among))
    keyed = docs.withColumns({h: F.xxhash64(F.coalesce(F.col(text), F.lit(""))), own: F.col(source).cast("string")})
    joined = keyed.join(plan.where(F.col(total) > 0), F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(t)) & F.col(own).eqNullSafe(F.col(of)))
    # Rows of equal id, text and source share what was taken of them; with unique ids there is one row and no remainder.
    joined = joined.withColumn(rank, F.row_number().over(W.partitionBy("doc_id", h, own).orderBy(h)))
    times = F.floor(F.col(total) / F.col(among)) + (F.col(rank) <= F.col(total) % F.col(among)).cast("long")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    plan = mix_plan(docs, text, source, **options)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source")
