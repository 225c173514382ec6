"""Shuffles, batches and the order in which training steps consume them."""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from corpusloom.session import ship

#: Rounds of the permutation, and walks out of its range that are followed. The range
#: exceeds ``n`` by less than a square root of it: up to n = 1024 no walk can be longer,
#: beyond that a longer one has a chance below 1e-40.
ROUNDS = 6
WALKS = 32


def _sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid of at least ``n`` cells."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


@lru_cache(maxsize=256)
def _shifts(seed: int | None, n: int) -> tuple[np.ndarray, ...]:
    """For each round, by how much a cell moves for every value of its other coordinate."""
    a, b = _sides(n)
    out = []
    for k in range(ROUNDS):
        fixed, side = (a, b) if k % 2 else (b, a)
        lead = f"{k}:" if seed is None else f"{seed}:{k}:"
        out.append(np.array([int(md5(f"{lead}{i}".encode()).hexdigest()[:13], 16) % side for i in range(fixed)], dtype=np.int64))
    return tuple(out)


def _permute(index: np.ndarray, seed: int | None, n: int, inverse: bool) -> np.ndarray:
    a, b = _sides(n)
    shifts = _shifts(seed, n)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = np.divmod(x, b)
        for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if k % 2:
                right = (right + (-shifts[k][left] if inverse else shifts[k][left])) % b
            else:
                left = (left + (-shifts[k][right] if inverse else shifts[k][right])) % a
        return left * b + right

    out = step(index)
    for _ in range(WALKS):
        beyond = np.flatnonzero(out >= n)
        if not len(beyond):
            break
        out[beyond] = step(out[beyond])
    return out


def permuted(index: Column, seed: Column, n: int, inverse: bool = False) -> Column:
    """Image of ``index`` under a seeded permutation of ``0 .. n - 1``.

    An index is a cell of a grid. Rounds move it along its row or its column by a hash of
    the other coordinate, which can be undone round by round; an image beyond ``n`` is
    moved again. Every place is computed by itself, in both directions: nothing is sorted
    or exchanged, however many windows there are. A worker hashes each row and column of
    the grid once, about a square root of ``n`` of them.
    """
    ship(SparkSession.active())

    @arrow_udf("long")
    def image(indexes: pa.Array, seeds: pa.Array) -> pa.Array:
        given = indexes.is_valid().to_numpy(zero_copy_only=False)
        x, out = indexes.fill_null(0).to_numpy(), np.zeros(len(indexes), dtype=np.int64)
        for seed in seeds.unique().to_pylist():
            own = seeds.is_null() if seed is None else pa.compute.equal(seeds, seed).fill_null(False)
            rows = np.flatnonzero(own.to_numpy(zero_copy_only=False) & given)
            out[rows] = _permute(x[rows], seed, n, inverse)
        return pa.array(out, mask=~given)

    return image(index.cast("long"), seed.cast("long"))


def window_grid(spark: SparkSession, shards: int, n_windows: int) -> DataFrame:
    """``(shard, window)`` of equal shards. Their number is known from token counts, so
    orders and schedules are planned without touching a token."""
    i = F.col("id")
    return spark.range(shards * n_windows).select(
        F.floor(i / n_windows).cast("long").alias("shard"), F.pmod(i, F.lit(n_windows)).alias("window")
    )


def seeded_shuffle(windows: DataFrame, n_windows: int, seed: int = 0) -> DataFrame:
    """Add ``place``, the shuffled position of each of a shard's ``n_windows`` windows; the seed differs per shard."""
    return windows.withColumn("place", permuted(F.col("window"), F.lit(seed) + F.col("shard"), n_windows))


def window_at(places: DataFrame, n_windows: int, seed: int = 0) -> DataFrame:
    """Add ``window``, the window of a shard that a ``place`` holds: the reverse of ``seeded_shuffle``."""
    return places.withColumn("window", permuted(F.col("place"), F.lit(seed) + F.col("shard"), n_windows, inverse=True))


def equal_shards(spark: SparkSession, shards: int, n_windows: int) -> DataFrame:
    """``(shard, windows)`` of equal shards, for ``batches``."""
    return spark.range(shards).select(F.col("id").alias("shard"), F.lit(n_windows).cast("long").alias("windows"))


def batches(placed: DataFrame, batch_size: int, workers: int, sizes: DataFrame | None = None) -> DataFrame:
    """Batch, slot and feed order of every window.

    ``shard = rank * workers + worker``. The workers of a rank take turns; one that has
    run out is passed over, so the feed order counts what the others still give.

    With ``sizes(shard, windows)``, the windows of every shard where they are known
    beforehand, windows are not counted, and may have any other columns: each finds its
    place by itself, without a join. ``spot`` is then its place among all windows, ranks
    after each other, by feed and slot.
    """
    rows = placed.withColumns({
        "rank": F.floor(F.col("shard") / workers).cast("int"),
        "worker": F.pmod("shard", F.lit(workers)).cast("int"),
        "batch": F.floor(F.col("place") / batch_size).cast("long"),
        "slot": F.pmod("place", F.lit(batch_size)).cast("int"),
    })
    if sizes is None:
        per_worker = rows.groupBy("rank", "worker").agg((F.max("batch") + 1).alias("n"), F.count(F.lit(1)).alias("k"))
    else:
        per_worker = sizes.where("windows > 0").select(
            F.floor(F.col("shard") / workers).cast("int").alias("rank"), F.pmod("shard", F.lit(workers)).cast("int").alias("worker"),
            F.ceil(F.col("windows") / batch_size).cast("long").alias("n"), F.col("windows").alias("k"),
        )
    per_rank = per_worker.groupBy("rank").agg(
        F.collect_list(F.struct("worker", "n", "k")).alias("given"), F.sum("n").alias("rank_batches"), F.sum("k").alias("_k")
    )
    earlier = F.aggregate(
        "given", F.lit(0).cast("long"),
        lambda acc, g: acc + F.least(g["n"], F.col("batch") + (g["worker"] < F.col("worker")).cast("long")),
    )
    # One row per rank, each with one entry per worker.
    if sizes is None:
        return rows.join(F.broadcast(per_rank.drop("_k")), "rank").withColumn("feed", earlier).drop("given")
    ranks = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    per_rank = per_rank.withColumn("_k", F.coalesce(F.sum("_k").over(ranks), F.lit(0)))
    ahead = F.aggregate(
        "given", F.col("_k"), lambda acc, g: acc + F.least(g["k"], (F.col("batch") + (g["worker"] < F.col("worker")).cast("long")) * batch_size)
    )
    return rows.join(F.broadcast(per_rank), "rank").withColumns({"feed": earlier, "spot": ahead + F.col("slot")}).drop("given", "_k")


def take_batches(batched: DataFrame, n: int) -> DataFrame:
    return batched.where(F.col("feed") < n)


def epoch_schedule(spark: SparkSession, batched: DataFrame, steps: int, grad_accum: int, world: int) -> DataFrame:
    """Which batch each (step, rank, micro step) reads; a used-up rank starts over in the same order."""
    feeds = batched.groupBy("rank", "feed").agg(
        F.first("worker").alias("worker"), F.first("batch").alias("batch"), F.first("rank_batches").alias("rank_batches")
    )
    sizes = feeds.groupBy("rank").agg(F.first("rank_batches").alias("rank_batches"))
    turns = spark.range(steps * grad_accum).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1))))
    wanted = turns.join(F.broadcast(sizes), "rank").select(
        "rank",
        F.floor(F.col("id") / grad_accum).cast("long").alias("step"),
        F.pmod("id", F.lit(grad_accum)).cast("int").alias("micro"),
        F.floor(F.col("id") / F.col("rank_batches")).cast("long").alias("epoch"),
        F.pmod("id", F.col("rank_batches")).alias("feed"),
    )
    return wanted.join(feeds.drop("rank_batches"), ["rank", "feed"])


def budget_report(
    stream_tokens: DataFrame, batch_size: int, grad_accum: int, world: int, seq_len: int, max_steps: int
) -> DataFrame:
    """Tokens per step, steps and training tokens; ``stream_tokens(tokens)`` is the corpus."""
    per_step = batch_size * grad_accum * world * seq_len
    steps = max(max_steps // world, 1) if world > 1 else max_steps
    return stream_tokens.select(
        F.lit(per_step).cast("long").alias("step_tokens"),
        F.lit(steps).cast("long").alias("steps"),
        F.lit(steps * per_step).cast("long").alias("training_tokens"),
        F.col("tokens").alias("corpus_tokens"),
        F.round(F.lit(steps * per_step) / F.col("tokens"), 6).alias("epochs"),
    )
