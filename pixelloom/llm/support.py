"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.session import ship, stored, table

#: White space of the word rule, for a character class and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """For Python in tasks: the package at hand, and Arrow batches so small that very long texts don't fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def narrow(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow result by a table: what a shuffle has dealt over many partitions is read again in few,
    where a checkpoint keeps a file for each of them and every shuffle after it writes as many."""
    return stored(df, "narrow")


def word_array(text: Column) -> Column:
    """Words, maximal runs without white space; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    """Number of words, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string")) % parts


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, inside higher-order functions too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, so that no filter or projection above makes the optimiser write their
    expressions out again: within higher-order functions that would mean for every element."""
    held, = fresh(df, "held")
    packed = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(c for c in df.columns if c not in columns), packed.alias(held)).select("*", *(F.col(f"{held}.{n}").alias(n) for n in columns)).drop(held)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


LEAST_SHARE = 2000


def share_of_partition(counts: DataFrame, n: str) -> tuple[int, bool]:
    """Half of the rows that a shuffle partition holds if ``n`` rows of each key are dealt evenly, and whether any key has
    more. Such keys are at most twice as many as there are partitions."""
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    share = max(LEAST_SHARE, (total or 0) // (2 * partitions))
    return share, (most or 0) > share


def spread_join(rows: DataFrame, found: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The inner join of many rows with ``found``, which has one row a key and, in ``n``, how many rows ask for it.

    What is asked for most often is broadcast, at most twice as many rows as there are partitions, so no task gets the rows
    of a hot key; the rest is joined by a shuffle."""
    found = narrow(found)
    share, any_hot = share_of_partition(found, n)
    if not any_hot:
        return rows.join(found, key)
    hot = F.broadcast(found.where(F.col(n) > share))
    cold = rows.join(hot.select(key), key, "left_anti").join(found.where(F.col(n) <= share), key)
    return rows.join(hot, key).unionByName(cold)
