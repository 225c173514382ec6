"""Corpus scans: tables, files chosen by path, and streams."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Spark's names for "no file there".
NOTHING_FOUND = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Read just the named columns (``text`` by default)."""
    return spark.read.parquet(path).select(*(columns or ("text",)))


def select_files(spark: SparkSession, root: str, subset: str) -> DataFrame:
    """Rows of the Parquet files of a subset, with ``file_rank`` and ``row``.

    Dashes of the subset name are folders. Without a match every Parquet file under
    ``root`` is read. Files rank in path order, rows in file order.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    try:
        found = reader.parquet(f"{root}/{subset.replace('-', '/')}/*.parquet")
    except AnalysisException as error:
        if error.getCondition() not in NOTHING_FOUND:
            raise
        found = reader.option("recursiveFileLookup", "true").parquet(root)
    names = sorted(re.sub("^([a-z0-9]+):/+", r"\1:/", f) for f in found.inputFiles())
    ranks = spark.createDataFrame(list(enumerate(names)), "file_rank int, file_path string")
    path = F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/")
    rows = found.select("*", path.alias("file_path"), F.col("_metadata.row_index").alias("row"))
    return rows.join(ranks, "file_path")


def stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    max_files: int | None = None,
    max_bytes: str | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Corpus as a stream. ``max_files`` or ``max_bytes`` bound what one micro-batch takes in."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_table(spark: SparkSession, path: str, schema: StructType | str, **limits) -> DataFrame:
    """A table as a stream, be it one Parquet file or a folder of them.

    A stream takes a plain path for a folder, and a name filter looks at the files inside;
    a pattern that only the path itself matches takes both.
    """
    return stream(spark, re.sub(r"([^/])/*$", r"[\1]", path), schema, **limits)


def drain(stream_df: DataFrame, path: str, checkpoint: str) -> None:
    """Write everything a stream holds now to a Parquet folder, then stop."""
    (
        stream_df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
