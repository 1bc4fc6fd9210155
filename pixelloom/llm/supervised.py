"""What the trained operators share: bounded labelled samples, and scoring by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pixelloom.llm.support import id_bucket, small_batches
from pixelloom.llm.text_arrays import bounded_batches

#: About so many labelled documents are learned from. Longer ones are left to scoring: this bounds what the driver holds
#: to 200 MB of text, whatever the corpus.
SAMPLE_ROWS, SAMPLE_CHARS, LEAST_A_MARK = 4000, 50_000, 8
_FINE = 1 << 30


def _bounded_texts(docs: DataFrame, ids: DataFrame, chars: int) -> DataFrame:
    """(doc_id, text, *ids) of a bounded number of ids, one text for each id however often it repeats."""
    found = docs.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    met = found.join(F.broadcast(ids), F.col("i") == F.col("doc_id")).drop("i")
    return met.groupBy(*ids.columns).agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, marks: DataFrame, keep: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, per: str | None = None, seed: int = 3) -> pd.DataFrame:
    """(doc_id, text, mark) of a seeded sample, in random order. marks: (doc_id, mark); keep: which ids may be learned from.

    per: a column of ``marks`` whose values share the rows evenly; every value gets at least ``LEAST_A_MARK`` of its rows, so
    the sample is bounded by ``rows`` plus that for each value, and no value is left out. The ids are chosen first, a bounded
    number, and broadcast to the documents. Repeated label rows of an id count once, with the greatest mark."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_FINE))
    marks = marks.where(F.col("doc_id").isNotNull() & F.col("mark").isNotNull() & keep).groupBy("doc_id").agg(F.max("mark").alias("mark")).withColumn("draw", draw)
    counts = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    if per:
        share = F.greatest(F.lit(LEAST_A_MARK), F.lit(float(rows)) / F.count(F.lit(1)).over(W.partitionBy()))
    else:
        share = F.lit(float(rows)) * F.col("n") / F.sum("n").over(W.partitionBy())
    limits = counts.select(F.col("mark").alias("of"), (F.least(F.lit(1.0), share / F.col("n")) * _FINE).cast("long").alias("limit"))
    chosen = marks.join(F.broadcast(limits), F.col("mark") == F.col("of")).where(F.col("draw") < F.col("limit")).select("doc_id", "mark", "draw")
    got = _bounded_texts(docs, _known(chosen), chars).toPandas()
    got = got.sort_values(["draw", "doc_id"])
    return got[["doc_id", "text", "mark"]].reset_index(drop=True)


def _known(rows: DataFrame) -> DataFrame:
    """Rows of a bounded number, fetched and sent again, so that they are chosen once."""
    return rows.sparkSession.createDataFrame(rows.collect(), T.StructType([*rows.schema.fields]))


def unlabelled_sample(docs: DataFrame, without: list[int], keep: Column, rows: int, chars: int = SAMPLE_CHARS, seed: int = 4) -> list[str]:
    """About ``rows`` texts, a seeded sample of the ids that may be learned from, none of those in ``without``, in random order."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_FINE))
    ids = docs.where(F.col("doc_id").isNotNull() & keep).select("doc_id").distinct().withColumn("draw", draw)
    total = ids.count()
    if not total:
        return []
    limit = int(min(1.0, (rows + len(without)) / total) * _FINE)
    known = set(without)
    chosen = [r for r in ids.where(F.col("draw") < limit).collect() if r["doc_id"] not in known][:rows]
    if not chosen:
        return []
    got = _bounded_texts(docs, docs.sparkSession.createDataFrame(chosen, ids.schema), chars).toPandas()
    return got.sort_values(["draw", "doc_id"])["text"].tolist()


def scored(docs: DataFrame, held_out: Column, scorer: Callable[[], Callable[[pa.Array], list[pa.Array]]], outputs: T.StructType) -> DataFrame:
    """(doc_id, held_out, *outputs) of every row. scorer: makes, in the worker, the function from texts to output columns."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "held_out", *outputs.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in bounded_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *score(batch.column("text"))], names=names)

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["held_out"], *outputs.fields]))


def held_out(parts: int, remainder: int) -> Column:
    """Ids that nothing is learned from; a null id is none of them."""
    return F.coalesce(id_bucket(F.col("doc_id"), parts) == remainder, F.lit(False))


SCORE_AND_CLASS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
THRESHOLD = 0.3


def score_columns(p: np.ndarray) -> list[pa.Array]:
    p = np.clip(np.nan_to_num(p), 0.0, 1.0)
    return [pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))]
