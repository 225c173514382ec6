"""Overlapping windows over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.packing import cut_windows, stream_positions, token_count
from corpusloom.operators.positions import id_bucket, row_ranks, running_totals
from corpusloom.session import cut

STATE = "shard int, windows long, rows long, tail array<int>"


def stream_pack(docs: DataFrame, to_ids, path: str, checkpoint: str, seq_len: int, shards: int) -> None:
    """Pack documents as they arrive; ``to_ids`` drops blanks and adds ``ids``.

    Between micro-batches each shard keeps the tokens no window has consumed, at most
    ``seq_len`` of them, and the number of its windows. Inside a micro-batch the windows
    are cut as for a table, so a shard is not limited to one task. State and windows are
    stored per batch id: a batch that runs again starts from the same state.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _state(spark, path, batch_id - 1, shards)
        seen = state.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("r")).first()["r"]
        ranked = row_ranks(batch, "row", bucket=id_bucket("doc_id"), order=["doc_id"])
        ranked = ranked.withColumn("shard", F.pmod(F.col("row") + seen, F.lit(shards)).cast("int"))
        fresh = cut(to_ids(ranked).select("shard", "row", "ids"), "arrivals")
        held = state.select("shard", F.lit(-1).cast("long").alias("row"), F.col("tail").alias("ids"))
        pending = held.unionByName(fresh)
        positioned = stream_positions(pending, ["shard"], "row")
        lengths = pending.groupBy("shard").agg(F.sum(token_count()).alias("len"))
        new = F.greatest(F.floor((F.col("len") - 1) / seq_len), F.lit(0)).cast("long")
        lengths = state.select("shard", "windows").join(lengths, "shard", "left").select(
            "shard", "windows", F.coalesce(new, F.lit(0)).alias("new")
        )
        windows = cut_windows(positioned, seq_len, seq_len, ["shard"]).join(F.broadcast(state.select("shard", "windows")), "shard")
        windows.select(
            "shard", (F.col("windows") + F.col("window")).alias("window"), "tokens"
        ).write.mode("overwrite").parquet(f"{path}/windows/batch={batch_id}")

        # What is left over is found by sizes, so ids move once; a shard has ``seq_len`` such rows at most.
        first = F.col("new") * seq_len
        sizes = pending.select("shard", "row", token_count().alias("n")).where("n > 0")
        placed = running_totals(sizes, {"start": F.col("n")}, bucket=id_bucket("row"), order=["row"], by=["shard"])
        last = placed.join(F.broadcast(lengths.select("shard", "new")), "shard").where(F.col("start") + F.col("n") > first)
        rest = pending.join(F.broadcast(last.select("shard", "row", "start", "new")), ["shard", "row"]).withColumn(
            "ids", F.when(F.col("start") >= first, F.col("ids")).otherwise(
                F.slice("ids", (first - F.col("start") + 1).cast("int"), F.size("ids"))
            )
        )
        tails = rest.groupBy("shard").agg(F.flatten(F.sort_array(F.collect_list(F.struct("start", "ids")))["ids"]).alias("tail"))
        total = seen + batch.count()
        lengths.join(tails, "shard", "left").select(
            "shard", (F.col("windows") + F.col("new")).alias("windows"), F.lit(total).cast("long").alias("rows"),
            F.coalesce("tail", F.array().cast("array<int>")).alias("tail"),
        ).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")

    docs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _state(spark: SparkSession, path: str, batch_id: int, shards: int) -> DataFrame:
    if batch_id < 0:
        return spark.range(shards).select(
            F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("windows"),
            F.lit(0).cast("long").alias("rows"), F.array().cast("array<int>").alias("tail"),
        )
    return spark.read.schema(STATE).parquet(f"{path}/state/batch={batch_id}")


def packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/windows").drop("batch")
