"""Row operators: blanks, samples and shard assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank, text_or_empty
from corpusloom.operators.positions import id_bucket, order_value_at, row_ranks


def default_text(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, text_or_empty(text))


def drop_blank(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(~is_blank(text_or_empty(text)))


def first_n(docs: DataFrame, num_samples: int = 500_000, batch_size: int = 1_000, order: str = "doc_id") -> DataFrame:
    """First documents in order, rounded up to whole batches.

    The last key of the sample is found from counts, so the sample itself is a pushed
    down filter and never passes through one task.
    """
    rows = -(-num_samples // batch_size) * batch_size
    last = order_value_at(docs, order, rows)
    return docs.where(F.lit(False)) if last is None else docs.where(F.col(order) <= last)


def row_shards(docs: DataFrame, shards: int, order: str = "doc_id") -> DataFrame:
    """Row ``i`` goes to shard ``i mod shards``; every row counts, blank ones too."""
    ranked = row_ranks(docs, "row", bucket=id_bucket(order), order=[order])
    return ranked.withColumn("shard", F.pmod("row", F.lit(shards)).cast("int"))


def file_workers(docs: DataFrame, workers: int, file_rank: str = "file_rank") -> DataFrame:
    """File ``i`` goes to worker ``i mod workers``; output order is worker, file, row."""
    return docs.withColumn("worker", F.pmod(file_rank, F.lit(workers)).cast("int"))
