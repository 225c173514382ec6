"""The training feed as files: windows in the order ranks read them, with an offset index.

Windows of a rank lie one after the other by feed and slot in a binary token store, so a
trainer reads a batch as one stretch of bytes. The index has a row per (rank, feed): where
its windows begin and how many there are. A reader that resumes at a step looks up the
feeds of its steps and opens just their bytes, whatever lies before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import batching, packing
from corpusloom.operators.positions import id_bucket, running_totals
from corpusloom.session import cut
from corpusloom.sources import token_store
from corpusloom.sources.vocab_store import exists

INDEX = "feed_index"
STORE = "windows"
#: Stretches looked up one by one; with more of them the whole store is read.
RANGES = 10_000


def feed_index(order: DataFrame, seq_len: int) -> DataFrame:
    """``(rank, feed, worker, batch, start, n_windows)`` from ``order(rank, feed, slot, worker, batch)``.

    ``start`` is the token at which the feed's windows begin, ranks after each other.
    """
    feeds = cut(
        order.groupBy("rank", "feed").agg(F.first("worker").alias("worker"), F.first("batch").alias("batch"), F.count(F.lit(1)).alias("n_windows")), "feeds"
    )
    inside = running_totals(feeds, {"before": F.col("n_windows")}, bucket=id_bucket("feed"), order=["feed"], by=["rank"])
    ranks = feeds.groupBy("rank").agg(F.sum("n_windows").alias("n"))
    base = running_totals(ranks, {"base": F.col("n")}, bucket=F.col("rank").cast("long"), order=["rank"]).select("rank", "base")
    placed = inside.join(base, "rank")  # one row a rank
    return placed.select("rank", "feed", "worker", "batch", ((F.col("base") + F.col("before")) * (seq_len + 1)).alias("start"), "n_windows")


def write(
    windows: DataFrame, order: DataFrame, path: str, seq_len: int, vocab_size: int, part_tokens: int = token_store.PART_TOKENS, force: bool = False
) -> DataFrame:
    """Write ``windows(shard, window, tokens)`` in ``order(shard, window, rank, feed, slot, worker, batch)``; returns the index.

    Windows that know their ``spot`` in the feed already, as ``batches`` gives it, are not
    joined with the order. The index is written last: without one a store is not complete
    and is written anew.
    """
    spark = windows.sparkSession
    if force or not exists(spark, f"{path}/{INDEX}"):
        index = cut(feed_index(order, seq_len), "feed_index")
        if "spot" in windows.columns:
            placed = windows.select((F.col("spot") * (seq_len + 1)).alias("start"), F.col("tokens").alias("ids"))
        else:
            spot = order.select("shard", "window", "rank", "feed", "slot").join(index.select("rank", "feed", "start"), ["rank", "feed"])
            placed = windows.join(spot, ["shard", "window"]).select((F.col("start") + F.col("slot") * (seq_len + 1)).alias("start"), F.col("tokens").alias("ids"))
        token_store.write(placed, f"{path}/{STORE}", vocab_size, part_tokens // (seq_len + 1) * (seq_len + 1), force=True)
        index.repartitionByRange("rank", "feed").sortWithinPartitions("rank", "feed").write.mode("overwrite").parquet(f"{path}/{INDEX}")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{INDEX}")


def read_steps(
    spark: SparkSession, path: str, seq_len: int, vocab_size: int, from_step: int, steps: int, grad_accum: int = 1
) -> DataFrame:
    """``(step, rank, micro, epoch, feed, slot, tokens)`` of ``steps`` steps from ``from_step`` on.

    A rank that has used up its feeds starts over in the same order, as without the break.
    """
    index = read_index(spark, path)
    sizes = index.groupBy("rank").agg(F.count(F.lit(1)).alias("rank_batches")).collect()  # one row a rank
    ranks = [F.struct(F.lit(r["rank"]).alias("rank"), F.lit(r["rank_batches"]).cast("long").alias("rank_batches")) for r in sizes]
    turns = spark.range(from_step * grad_accum, (from_step + steps) * grad_accum if ranks else from_step * grad_accum)
    each = turns.select("id", F.inline(F.array(*ranks) if ranks else F.from_json(F.lit("[]"), "array<struct<rank:int,rank_batches:bigint>>")))
    due = each.select(
        "rank", F.call_function("div", "id", F.lit(grad_accum)).alias("step"), F.pmod("id", F.lit(grad_accum)).cast("int").alias("micro"),
        F.call_function("div", "id", "rank_batches").alias("epoch"), F.pmod("id", "rank_batches").alias("feed"),
    )
    # Feeds of one epoch follow each other, so what is to be read is a stretch per rank and epoch.
    spots = cut(due.join(index, ["rank", "feed"]), "due")
    width = seq_len + 1
    end = F.col("start") + F.col("n_windows") * width
    stretches = spots.groupBy("rank", "epoch").agg(F.min("start").alias("a"), F.max(end).alias("b"))
    found = stretches.select("a", "b").distinct().orderBy("a", "b").limit(RANGES + 1).collect()
    merged: list[list[int]] = []
    for r in found:
        if merged and r["a"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], r["b"])
        else:
            merged.append([r["a"], r["b"]])
    blocks = token_store.read(spark, f"{path}/{STORE}", vocab_size, ranges=merged if len(found) <= RANGES else None)
    wanted = spots.select(
        "step", "rank", "micro", "epoch", "feed", F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("n_windows"))).alias("slot", "_k"),
        (F.col("start") / width).cast("long").alias("_first"),
    ).withColumn("window", F.col("_first") + F.col("slot")).drop("_first", "_k")
    return packing.cut_windows(blocks, seq_len, width).join(wanted, "window").select("step", "rank", "micro", "epoch", "feed", "slot", "tokens")

