"""Shared text expressions. Words are runs of anything but ASCII white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key() -> Column:
    """Hash of id and text, never null; with the id it tells rows apart."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` that are not in ``gone(doc_id, row)``, ``row`` being the ``row_key``.

    Of rows that repeat an id only those with the text named go; a null id matches a null id.
    The join is left to adaptive planning, which knows the real size of ``gone``.
    """
    named = gone.select(F.col("doc_id").alias("_gone"), F.col("row").alias("_gone_row")).distinct()
    same = (row_key() == F.col("_gone_row")) & df["doc_id"].eqNullSafe(F.col("_gone"))
    return df.join(named, same, "left_anti")
