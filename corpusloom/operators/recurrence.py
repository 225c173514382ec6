"""Per-key decayed state over time: ``h_t = a_t h_{t-1} + u_t`` with readout ``q_t h_t``.

One step is an affine map of the state, and so is any run of steps. Rows are
range-partitioned by key and time, so a hot key spreads over many tasks. Each task
follows its runs from a zero state and keeps the decay accumulated so far; the state
that really reaches a run is then added by ``h = h0 + decay * h_in``. Only the last row
of each run is needed to chain the runs of a key that lies in several parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusloom.session import cut


def log_decay(z: Column) -> Column:
    """``-softplus(z)``, the logarithm of the decay factor."""
    return -(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))


def fold(log_a: np.ndarray, u: np.ndarray, h: float = 0.0) -> np.ndarray:
    """States of consecutive rows of one key."""
    out = np.empty(len(u))
    for i, (a, x) in enumerate(zip(np.exp(log_a).tolist(), u.tolist())):
        h = a * h + x
        out[i] = h
    return out


def decayed_state(rows: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``h`` and ``readout`` to rows with ``log_a``, ``u`` and ``q``."""
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        rows.repartitionByRange(parts, key, *order)
        .sortWithinPartitions(key, *order)
        .withColumns({"_part": F.spark_partition_id(), "_key": F.col(key).cast("string")})
    )
    schema = StructType([*ranged.schema.fields, StructField("_h", DoubleType()), StructField("_log", DoubleType())])
    local = cut(ranged.mapInArrow(_local_states, schema), "runs")

    ends = local.groupBy("_key", "_part").agg(F.max_by(F.struct("_h", "_log"), F.struct(*order)).alias("e"))
    # Keys in several parts lie across part borders, so their runs are at most two per part.
    spread = ends.join(ends.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "_key")
    carried = spread.select("_key", "_part", "e._h", "e._log").groupBy("_key").applyInPandas(
        _chain, "_key string, _part int, h_in double"
    )
    h = F.col("_h") + F.exp("_log") * F.coalesce("h_in", F.lit(0.0))
    return (
        local.join(F.broadcast(carried), ["_key", "_part"], "left")
        .withColumn("h", h)
        .withColumn("readout", F.col("q") * F.col("h"))
        .select(*rows.columns, "h", "readout")
    )


def _local_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, h, log = None, 0.0, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("_key").dictionary_encode()
        code = codes.indices.to_numpy()
        names = codes.dictionary.to_pylist()
        log_a, u = batch.column("log_a").to_numpy(), batch.column("u").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        states, logs = np.empty(len(code)), np.empty(len(code))
        for lo, hi in zip(cuts, cuts[1:]):
            if names[code[lo]] != key:
                key, h, log = names[code[lo]], 0.0, 0.0
            states[lo:hi] = fold(log_a[lo:hi], u[lo:hi], h)
            logs[lo:hi] = log + np.cumsum(log_a[lo:hi])
            h, log = float(states[hi - 1]), float(logs[hi - 1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(states), pa.array(logs)], names=[*batch.schema.names, "_h", "_log"]
        )


def _chain(runs: pd.DataFrame) -> pd.DataFrame:
    runs = runs.sort_values("_part")
    after = fold(runs["_log"].to_numpy(), runs["_h"].to_numpy())
    return pd.DataFrame({"_key": runs["_key"], "_part": runs["_part"], "h_in": np.concatenate([[0.0], after[:-1]])})
