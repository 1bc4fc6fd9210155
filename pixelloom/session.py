"""Sessions and storage shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PIXELLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only on a local master that names none, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return named or current
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow intermediate result by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of a wide intermediate result by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    _let_go(spark)
    return spark.read.schema(df.schema).parquet(path)


def _let_go(spark: SparkSession) -> None:
    """Free the shuffle files that nothing refers to any longer, now rather than when the driver's memory is full."""
    gc.collect()
    spark._jvm.System.gc()


#: Tables that ``stored`` has written, oldest first.
_tables: list[str] = []


def stored_so_far() -> int:
    return len(_tables)


def release(spark: SparkSession, since: int) -> None:
    """Drop all stored tables after the first ``since`` but the newest, which what follows reads, and let go of the shuffle
    files that nothing refers to any longer. For jobs of several stages, each of which ends in a stored table."""
    for path in _tables[since:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _tables[since:-1] = []
    _let_go(spark)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application. For operators with Python in tasks."""
    context, package = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="pixelloom-")) / "pixelloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, Path(package.name, path.relative_to(package)))
    context.addPyFile(str(archive))
