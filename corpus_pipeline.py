"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read again
as the next stage's documents, which also cuts the lineage. What a stage has stored besides is dropped
as soon as its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm.bpe import bpe_digests
from pixelloom.llm.line_dedup import line_dedup
from pixelloom.llm.mixing import mixed
from pixelloom.llm.near_dedup import near_dedup
from pixelloom.llm.quality_rules import quality_rules
from pixelloom.llm.queries import TOKENIZER
from pixelloom.llm.support import documents
from pixelloom.session import release, stored, stored_so_far, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; a text that has lost lines gets its new length."""
    n_chars = "case when n_dropped > 0 then cast(char_length(text) as bigint) else n_chars end as n_chars"
    return line_dedup(docs).selectExpr("doc_id", "text", "lang", "source", n_chars)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs, TOKENIZER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: Weighted sampling, the fit of lengths and BPE aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = documents(spark, sf_dir), stored_so_far()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            release(spark, since)
    return docs
