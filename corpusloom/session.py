"""Session helpers: shared scratch tables and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch that a Python worker gets at once, unless the session says so.
#: By rows alone, 10,000 long texts and what is made of them would be in memory together.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT = 4 << 20
#: Spark's setting that drops the shuffle files of a write, or another job, when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A folder of our own is used only where the setting is absent (tests, laptops).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        root = _OWN_ROOTS.get(app) or _OWN_ROOTS.setdefault(app, tempfile.mkdtemp(prefix="corpusloom-"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str = "cut", by: str | None = None) -> DataFrame:
    """Write ``df`` to a shared table and read it back, which ends its lineage.

    Lost executors re-read the table; nothing upstream runs again. ``by`` gives each value
    of a column a folder, and presses harder what is large enough to be read in parts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if by is None:
        df.write.parquet(path)
    else:
        df.write.partitionBy(by).option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def release(table: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing reads any more, as a loop leaves them behind.

    What was made from it must be written by then: a lost executor could not read it again.
    """
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def parts_of(table: DataFrame, column: str) -> tuple[list[DataFrame], int]:
    """The folders of a table of ``cut`` that was written by ``column``, and the table's bytes."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith(f"{column}="))
    parts = []
    for name in names:
        part = spark.read.schema(table.drop(column).schema).parquet(f"{table._scratch}/{name}")
        part._scratch = f"{table._scratch}/{name}"
        parts.append(part)
    return parts, files.getContentSummary(path).getLength()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind, which else stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def bound_batches(spark: SparkSession) -> None:
    """Have Python workers get batches of bounded size, however long the rows are."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH_LIMIT)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, and bound what they get at once."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-pkg-"), "corpusloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work a task per core when the files make fewer splits than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
