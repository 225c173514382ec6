"""Top-k routing of vectors to groups, its load, and the bias that evens the load out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from corpusloom.operators.positions import FANOUT_BITS, id_bucket, running_totals
from corpusloom.session import ship

# Scores that are held at once for a batch of rows.
BLOCK_CELLS = 4 << 20


def label_centroids(vectors: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean vector per group, summed by coordinate before anything is shuffled."""
    return (
        vectors.select(group, F.posexplode(vector).alias("dim", "v"))
        .groupBy(group, "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
        .groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda p: p["v"]).alias("centroid"))
    )


def gate_matrix(centroids: DataFrame, group: str = "label") -> tuple[list[int], np.ndarray]:
    """The gate as a matrix: a row per group, as every task needs it."""
    rows = centroids.orderBy(group).collect()
    return [r[group] for r in rows], np.array([r["centroid"] for r in rows])


def topk_routing(
    vectors: DataFrame, groups: list[int], gate: np.ndarray, bias: list[float], k: int = 2,
    vector: str = "embedding", eps: float = 1e-6,
) -> DataFrame:
    """Best ``k`` groups per row by score plus bias, ties to the smaller group.

    Rows are divided by their root mean square first. Weights come from the scores
    without bias, by softmax, and add up to one over the chosen groups. Groups are scored
    in blocks beside the best so far, so no more than ``BLOCK_CELLS`` scores are held.
    """
    offsets = np.asarray(bias, dtype=np.float64)
    names = np.asarray(groups, dtype=np.int32)

    @arrow_udf("array<struct<place:int,grp:int,weight:double>>")
    def route(batch: pa.Array) -> pa.Array:
        rows = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
        rows = rows / np.sqrt((rows**2).mean(axis=1, keepdims=True) + eps)
        best = np.empty((len(rows), 0), dtype=np.int64)
        chosen = np.empty((len(rows), 0))
        step = max(k, BLOCK_CELLS // max(len(rows), 1))
        for lo in range(0, len(gate), step):
            score = np.concatenate([chosen, rows @ gate[lo:lo + step].T], axis=1)
            group = np.concatenate([best, np.broadcast_to(np.arange(lo, min(lo + step, len(gate))), (len(rows), min(step, len(gate) - lo)))], axis=1)
            order = np.argsort(-(score + offsets[group]), axis=1, kind="stable")[:, :k]
            best, chosen = np.take_along_axis(group, order, axis=1), np.take_along_axis(score, order, axis=1)
        weight = np.exp(chosen - chosen.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        width = best.shape[1]
        flat = pa.StructArray.from_arrays(
            [pa.array(np.tile(np.arange(width, dtype=np.int32), len(rows))),
             pa.array(names[best].ravel()), pa.array(weight.ravel())],
            names=["place", "grp", "weight"],
        )
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * width + 1, width, dtype=np.int32)), flat)

    kept = [c for c in vectors.columns if c != vector]
    return vectors.select(*kept, F.explode(route(F.col(vector))).alias("_r")).select(*kept, "_r.*")


def topk_routing_blocks(
    vectors: DataFrame, gate: DataFrame, k: int = 2, vector: str = "embedding", eps: float = 1e-6, block_groups: int = 1 << 15
) -> DataFrame:
    """``topk_routing`` for gates of any size: ``gate(grp, centroid, bias)`` stays a table.

    Groups are dealt to blocks. A task has one block, which comes first in its partition,
    and a part of the rows, which pass it by; it gives each its best ``k`` groups of the
    block. The short lists of a row are merged and weighted at the end. A row moves once
    for each block, a block once for each part. Rows are told apart by their other columns.
    """
    ship(vectors.sparkSession)
    kept = [c for c in vectors.columns if c != vector]
    blocks = max(1, -(-gate.count() // block_groups))
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = F.struct(*kept)
    place = [F.col("block"), F.col("part")]
    passing = vectors.select(
        each(blocks).alias("block"), F.pmod(F.xxhash64(*kept), F.lit(parts)).cast("int").alias("part"), row.alias("row"),
        F.transform(vector, lambda x: x.cast("double")).alias("v"), F.lit(None).cast("int").alias("grp"), F.lit(None).cast("double").alias("bias"),
    )
    held = gate.select(
        F.pmod(F.xxhash64("grp"), F.lit(blocks)).cast("int").alias("block"), each(parts).alias("part"), F.lit(None).cast(passing.schema["row"].dataType).alias("row"),
        F.transform("centroid", lambda x: x.cast("double")).alias("v"), F.col("grp").cast("int").alias("grp"), F.col("bias").cast("double").alias("bias"),
    )
    dealt = passing.unionByName(held).repartition(*place).sortWithinPartitions(*place, F.col("grp").isNull(), "grp")

    def score(batches):
        now, names, rows_of, bias, matrix = None, [], [], [], None
        for batch in batches:
            spots = list(zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()))
            groups = batch.column("grp").to_pylist()
            edges = [0, *[i for i in range(1, len(spots)) if spots[i] != spots[i - 1] or (groups[i] is None) != (groups[i - 1] is None)], len(spots)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if spots[a] != now:
                    now, names, rows_of, bias, matrix = spots[a], [], [], [], None
                values = batch.column("v").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                if groups[a] is not None:
                    names += groups[a:b]
                    rows_of.append(values)
                    bias += batch.column("bias").slice(a, b - a).to_pylist()
                    continue
                if not names:
                    continue
                if matrix is None:
                    matrix, offsets, numbers = np.concatenate(rows_of), np.array(bias), np.array(names, np.int32)
                    rows_of.clear()
                step = max(1, BLOCK_CELLS // len(numbers))
                for lo in range(0, b - a, step):
                    some = values[lo:lo + step]
                    found = (some / np.sqrt((some**2).mean(axis=1, keepdims=True) + eps)) @ matrix.T
                    best = np.argsort(-(found + offsets), axis=1, kind="stable")[:, :k]  # groups ascend, so ties go to the smaller
                    chosen, width = np.take_along_axis(found, best, axis=1), best.shape[1]
                    lists = pa.StructArray.from_arrays(
                        [pa.array(-(chosen + offsets[best]).ravel()), pa.array(numbers[best].ravel()), pa.array(chosen.ravel())], ["order", "grp", "score"]
                    )
                    sizes = pa.array(np.arange(0, len(some) * width + 1, width, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(a + lo, len(some)), pa.ListArray.from_arrays(sizes, lists)], ["row", "best"])

    partial = dealt.mapInArrow(score, f"row {passing.schema['row'].dataType.simpleString()}, best array<struct<order:double,grp:int,score:double>>")
    merged = partial.groupBy("row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    top = F.array_max(F.transform("best", lambda b: b["score"]))
    parts_of = merged.withColumn("best", F.transform("best", lambda b: F.struct(b["grp"].alias("grp"), F.exp(b["score"] - top).alias("e"))))
    total = F.aggregate("best", F.lit(0.0), lambda s, b: s + b["e"])
    return parts_of.select("row.*", total.alias("_t"), F.posexplode("best").alias("place", "_b")).select(
        *kept, F.col("place").cast("int").alias("place"), "_b.grp", (F.col("_b.e") / F.col("_t")).alias("weight")
    )


def weighted_combine(assigned: DataFrame, group_values: DataFrame, shared: Column, row: str = "vec_id") -> DataFrame:
    """Sum of the weighted values of a row's groups, plus a term every row gets.

    ``group_values(grp, value)`` has one row per group; the join takes its form by that
    table's size, and adaptive skew handling covers a group that holds most assignments.
    """
    return (
        assigned.join(group_values, "grp")
        .groupBy(row)
        .agg((F.sum(F.col("weight") * F.col("value")) + F.first(shared)).alias("combined"))
    )


def expert_load(routed: DataFrame, layers: int, experts: list[str]) -> DataFrame:
    """Load per layer and expert with zeros filled in, its spread and peak per layer.

    Layers without any routed row are left out.
    """
    spark = routed.sparkSession
    counts = routed.groupBy("layer", "expert").agg(F.count(F.lit(1)).alias("c"))
    grid = spark.range(layers).select(
        F.col("id").cast("int").alias("layer"), F.explode(F.array(*[F.lit(e) for e in experts])).alias("expert")
    )
    full = grid.join(counts, ["layer", "expert"], "left").select(
        "layer", "expert", F.coalesce("c", F.lit(0)).alias("n")
    )
    stats = full.groupBy("layer").agg(F.sum("n").alias("total"), F.stddev_samp("n").alias("sd"), F.max("n").alias("top"), F.avg("n").alias("mean"))
    return full.join(stats.where("total > 0"), "layer").select(
        "layer", "expert", "n",
        (F.col("n") / F.col("total")).alias("share"),
        (F.col("sd") / F.col("total")).alias("utilization_std"),
        (F.col("top") / F.col("mean")).alias("max_load_ratio"),
    )


def load_bias(counts: DataFrame, k: int, experts: list[str], speed: float = 0.001) -> DataFrame:
    """Bias of each (layer, expert) after every step, from ``counts(step, layer, expert, n)``.

    The bias falls where the load is above its even share and rises below it. Experts
    without rows in a step count as zero load.
    """
    totals = counts.groupBy("step", "layer").agg((F.sum("n") / F.lit(k)).alias("rows"))
    grid = totals.withColumn("expert", F.explode(F.array(*[F.lit(e) for e in experts])))
    full = grid.join(counts, ["step", "layer", "expert"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    target = F.col("rows") * k / F.lit(len(experts))
    moves = full.withColumn("move", F.signum(F.col("n") - target).cast("long"))
    summed = running_totals(
        moves, {"before": F.col("move")}, bucket=id_bucket("step", FANOUT_BITS), order=["step"], by=["layer", "expert"],
    )
    return summed.select("step", "layer", "expert", "n", ((F.col("before") + F.col("move")) * F.lit(-speed)).alias("bias"))
