"""Token budgets, counted over batches of documents in reading order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.packing import token_count
from corpusloom.operators.positions import id_bucket, running_totals
from corpusloom.session import cut

# Room for the buckets of one file.
ROW_BITS = 32


def worker_cap(max_tokens: int, workers: int) -> int:
    """Budget of one worker, with a fifth to spare for uneven workers; 0 is no limit, also
    where a tiny budget rounds down to it."""
    return int(max_tokens * 1.2 / workers) if max_tokens else 0


def encode_in_waves(
    files: DataFrame, encode: Callable[[DataFrame], DataFrame], max_tokens: int, workers: int, batch_rows: int = 5_000, spare: float = 1.1
) -> DataFrame:
    """As much of ``encode(files)`` as the workers' caps can take, in whole batches.

    ``files`` has ``worker, file_rank, row``; with ``file_path``, in rank order, a wave
    opens just its files. The first wave is a batch of each worker. The next ones follow
    the tokens still missing at the tokens a row has had so far, with some to spare, so
    rows far beyond the budget are neither read nor encoded. Waves are stored tables; a
    worker whose stored rows reach its cap takes no more part.
    """
    cap = worker_cap(max_tokens, workers)
    if not cap:
        return cut(encode(files), "encoded")
    path = ["file_path"] if "file_path" in files.columns else []
    # Rows per file come from file footers; a batch ends where its file or its rows end.
    sizes = cut(files.groupBy("worker", "file_rank", *path).agg(F.count(F.lit(1)).alias("n")), "file_rows")
    placed = cut(
        running_totals(sizes, {"ahead": F.col("n")}, bucket=F.col("file_rank").cast("long"), order=["file_rank"], by=["worker"]), "file_places"
    )
    ends = placed.select(
        "worker", "file_rank", *path,
        F.explode(F.transform(
            F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n") / batch_rows)), lambda k: F.col("ahead") + F.least(k * batch_rows, F.col("n"))
        )).alias("end"),
    )
    waves: list[DataFrame] = []
    done: dict[int, int] = {}
    goal = {r["worker"]: 1 for r in placed.select("worker").distinct().collect()}  # one entry a worker
    while goal:
        # The batch that holds a worker's goal ends the wave for it; the last batch if none does.
        wanted = files.sparkSession.createDataFrame([(w, done.get(w, 0), g) for w, g in goal.items()], "worker int, low long, goal long")
        reached = ends.join(F.broadcast(wanted), "worker").where((F.col("end") > F.col("low")) & (F.col("end") - F.col("goal") < batch_rows))
        upto = cut(reached.groupBy("worker", "low").agg(F.max("end").alias("high"), F.max("file_rank").alias("last_rank")), "wave")
        bounds = {r["worker"]: (r["low"], r["high"]) for r in upto.collect()}
        if not bounds:
            break
        spots = placed.join(F.broadcast(upto.withColumnRenamed("worker", "_w")), (F.col("worker") == F.col("_w")) & (F.col("file_rank") <= F.col("last_rank")) & (F.col("ahead") + F.col("n") > F.col("low")))
        opened = spots.select("worker", "file_rank", *path, "ahead", "low", "high")
        part = files
        if path:
            first, last = opened.agg(F.min("file_path"), F.max("file_path")).first()
            part = part.where(F.col("file_path").between(first, last))
        at = F.col("ahead") + F.col("row")
        part = part.join(opened.drop(*path), ["worker", "file_rank"]).where((at >= F.col("low")) & (at < F.col("high"))).select(*files.columns)
        waves.append(cut(encode(part), "wave"))
        done |= {w: high for w, (_, high) in bounds.items()}
        sums = reduce(DataFrame.unionByName, waves).groupBy("worker").agg(F.sum(token_count()).alias("t"))
        tokens = {r["worker"]: r["t"] for r in sums.collect()}
        total = {r["worker"]: r["n"] for r in placed.groupBy("worker").agg(F.sum("n").alias("n")).collect()}
        rate = max(sum(tokens.values()), 1) / max(sum(done.values()), 1)
        goal = {
            w: done[w] + int((cap - tokens.get(w, 0)) * spare / max(tokens.get(w, 0) / done[w], rate / 2)) + 1
            for w in done if tokens.get(w, 0) < cap and done[w] < total[w]
        }
    return reduce(DataFrame.unionByName, waves) if waves else cut(encode(files), "encoded")


def cap_by_worker(
    encoded: DataFrame, max_tokens: int, workers: int, batch_rows: int = 5_000
) -> DataFrame:
    """Batch budget over ``worker, file_rank, row``: a worker stops after the batch that
    reaches its cap, then the joined stream is cut at exactly ``max_tokens``.

    Returns the kept documents with ``start``, in worker, file and row order.
    """
    rows = encoded.withColumn("_batch", F.floor(F.col("row") / batch_rows).cast("long"))
    cap = worker_cap(max_tokens, workers)
    if cap:
        sums = rows.groupBy("worker", "file_rank", "_batch").agg(F.sum(token_count()).alias("t"))
        seen = running_totals(
            sums, {"before": F.col("t")}, bucket=F.col("file_rank").cast("long"), order=["_batch"], by=["worker"],
        )
        # Kept batches are a prefix of each worker's order: one row per worker tells where it ends.
        spot = F.struct("file_rank", "_batch")
        edges = seen.where(F.col("before") < cap).groupBy("worker").agg(F.max(spot).alias("_edge"))
        rows = rows.join(F.broadcast(edges), "worker").where(spot <= F.col("_edge")).drop("_edge")
    return trim(worker_order(rows), max_tokens).drop("_batch")


def worker_order(rows: DataFrame) -> DataFrame:
    """Add ``start`` along the worker-major order in which shards are joined."""
    local = running_totals(
        rows, {"start": token_count()}, by=["worker"], order=["file_rank", "row"],
        bucket=F.shiftleft(F.col("file_rank").cast("long"), ROW_BITS) + id_bucket("row"),
    )
    sums = rows.groupBy("worker").agg(F.sum(token_count()).alias("t"))
    base = running_totals(sums, {"base": F.col("t")}, bucket=F.col("worker").cast("long"), order=["worker"])
    return local.join(F.broadcast(base.select("worker", "base")), "worker").withColumn("start", F.col("start") + F.col("base")).drop("base")


def trim(positioned: DataFrame, max_tokens: int) -> DataFrame:
    """Cut the stream at ``max_tokens``, inside a document where it falls there."""
    if not max_tokens:
        return positioned
    room = F.lit(max_tokens).cast("long") - F.col("start")
    return positioned.where(room > 0).withColumn(
        "ids", F.when(room >= F.size("ids"), F.col("ids")).otherwise(F.slice("ids", F.lit(1), room.cast("int")))
    )


def cap_by_stream(encoded: DataFrame, max_tokens: int, batch_rows: int = 2_000, row: str = "row") -> DataFrame:
    """Streaming budget over ``row``: stop after the batch that reaches it, nothing is cut."""
    if not max_tokens:
        return encoded
    rows = encoded.withColumn("_batch", F.floor(F.col(row) / batch_rows).cast("long"))
    sums = rows.groupBy("_batch").agg(F.sum(token_count()).alias("t"))
    seen = running_totals(sums, {"before": F.col("t")}, bucket=id_bucket("_batch"), order=["_batch"])
    last = seen.where(F.col("before") < max_tokens).agg(F.max("_batch")).scalar()
    return rows.where(F.col("_batch") <= last).drop("_batch")
