"""Line dedup: lines whose key is found in many documents are dropped everywhere.

Normalised lines are hashed (MD5) and exploded, distinct documents are counted for each hash, and the
texts are put together again by position. Counting uses one row per document and distinct key, with a
partial count before the shuffle, so a line that is in every document costs one row per task. Lines that are
found most often, a bounded number, are broadcast to their positions, the others meet them by a shuffle. The
texts are shuffled once, to meet the positions that they lose.

Defined results: every row is a document of its own, whatever its id; equal rows get equal results; a
null or empty text is one empty line; empty keys are never dropped; a text that loses all its lines
becomes empty; order, carriage returns and white space of kept lines stay; an empty table gives an empty
table; all other columns pass through, and columns named as outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.support import ASCII_LOWER, ASCII_UPPER, SPACE_CHARS, fresh, once, spread_join
from pixelloom.session import cut

MIN_KEY_CHARS, MIN_DOCUMENTS = 1, 10


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), ASCII_UPPER, ASCII_LOWER)


def _hashes(text: Column, min_chars: int) -> Column:
    """A hash for each line; null for keys that are too short."""

    def one(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def _row_key(df: DataFrame, text: str) -> Column:
    """Equal for rows of equal id and text, which lose the same lines."""
    doc_id = F.col("doc_id").cast("string") if "doc_id" in df.columns else F.lit(None).cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id, F.lit("-")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))))


def line_dedup(df: DataFrame, text: str = "text", min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Replaces each text by its kept lines and adds ``n_lines`` and ``n_dropped``."""
    df = df.drop("n_lines", "n_dropped")
    key, lost, lines = fresh(df, "row_key", "lost", "lines")
    # Hashes are made once and checkpointed, 16 bytes a line, for both the count and the positions.
    hashed = cut(df.select(_row_key(df, text).alias(key), _hashes(F.col(text), min_chars).alias("hashes")))
    of_row = hashed.select(F.explode(F.array_compact(F.array_distinct("hashes"))).alias("hash"))
    common = of_row.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents)
    at = hashed.select(key, F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    positions = spread_join(at, common, "hash").groupBy(key).agg(F.collect_set("pos").alias(lost))
    out = df.withColumn(key, _row_key(df, text)).join(positions, key, "left")
    out = once(out, **{lines: F.split(F.coalesce(F.col(text), F.lit("")), "\n")})
    kept = F.when(F.col(lost).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
        F.array_join(
            F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))), lambda i: F.get(F.col(lines), i)),
            "\n",
        )
    )
    out = out.withColumns({text: kept, "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("long")})
    return out.select(*df.columns, "n_lines", "n_dropped")
