"""File listings with readable sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def size_label(length: Column) -> Column:
    """Size in GB, MB or KB with one decimal; a unit starts strictly above 1024 of the last."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(length > gb, F.format_string("%.1f GB", length / gb))
        .when(length > mb, F.format_string("%.1f MB", length / mb))
        .otherwise(F.format_string("%.1f KB", length / kb))
    )


def qualified(spark: SparkSession, root: str) -> str:
    """Full form of a folder's path, the same for every way to write it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^([a-z0-9]+):/+", r"\1:/", full).rstrip("/")


def list_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``path``, ``length`` and ``size`` of the files under ``root`` whose key starts with
    ``prefix``. File contents are pruned from the scan."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    )
    if prefix:
        plain = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
        files = files.where(plain.startswith(f"{qualified(spark, root)}/{prefix}"))
    return files.withColumn("size", size_label(F.col("length")))
