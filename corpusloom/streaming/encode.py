"""Encoding a stream of documents under a token budget."""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.budget import cap_by_stream
from corpusloom.operators.encoding import encode_docs
from corpusloom.operators.packing import token_count
from corpusloom.operators.positions import id_bucket, row_ranks
from corpusloom.operators.vocabulary import Vocabulary
from corpusloom.session import cut
from corpusloom.sources.vocab_store import exists

PROGRESS = "batch long, ts timestamp, docs long, tokens long"


class BudgetReached(Exception):
    """Ends the query before a micro-batch that is past the budget is committed."""


def stream_encode(
    docs: DataFrame, vocab: Vocabulary, path: str, checkpoint: str, max_tokens: int = 0, quiet: bool = True, batch_rows: int = 2_000,
) -> None:
    """Encode every micro-batch of ``docs`` into ``path/docs`` until the budget is reached.

    The budget is looked at every ``batch_rows`` rows, counted through the stream in order
    of ``doc_id`` inside a micro-batch, whatever the micro-batches' size: what follows the
    batch of rows that reaches it is not kept. Once it is reached the query stops and
    later input stays uncommitted for a run with a larger budget. Tokens of earlier
    micro-batches are read from the progress table, so the budget survives restarts. A
    batch that runs again overwrites what it wrote before.
    """
    last_print = [time.time()]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = progress(spark, path).where(F.col("batch") < batch_id)
        before = done.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("docs"), F.lit(0)).alias("d")).first()
        if max_tokens and before["t"] >= max_tokens:
            raise BudgetReached
        target = f"{path}/docs/batch={batch_id}"
        coded = encode_docs(batch, vocab, eot=True)
        if max_tokens:
            # All documents before were kept, so their number is this batch's first row.
            coded = cut(coded, "coded")
            ranked = row_ranks(coded, "_row", bucket=id_bucket("doc_id"), order=["doc_id"]).withColumn("_row", F.col("_row") + before["d"])
            coded = cap_by_stream(ranked, max_tokens - before["t"], batch_rows, "_row").drop("_row")
        coded.write.mode("overwrite").parquet(target)
        written = spark.read.parquet(target)
        row = written.agg(
            F.lit(batch_id).cast("long").alias("batch"), F.current_timestamp().alias("ts"),
            F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(token_count()), F.lit(0)).alias("tokens"),
        )
        row.write.mode("overwrite").parquet(f"{path}/progress/run={batch_id}")
        if not quiet and time.time() - last_print[0] >= 10:
            print(progress(spark, path).agg(F.sum("docs"), F.sum("tokens")).first())
            last_print[0] = time.time()

    run = docs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    except StreamingQueryException as error:
        if BudgetReached.__name__ not in str(error):
            raise


def progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per finished micro-batch, ready for ``encode_progress``."""
    if not exists(spark, f"{path}/progress"):
        return spark.createDataFrame([], PROGRESS)
    return spark.read.schema(PROGRESS).parquet(f"{path}/progress")


def encoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/docs").drop("batch")
