"""Operators with per-key state in the state store."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators import recurrence
from corpusloom.operators.recurrence import fold
from corpusloom.operators.training_log import closes_interval

#: Groups that the keys of a stateful operator are dealt to.
GROUPS = 1_024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Stateful Python operators need the RocksDB provider. Their classes are also loaded by
    a process that does not see shipped files, so they travel by value."""
    for module in (sys.modules[__name__], recurrence):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_interval(log: DataFrame, every: int, path: str, checkpoint: str) -> None:
    """Interval losses of a streamed log, written as their closing steps arrive.

    As in the batch form an interval is its steps' sum over the nominal length, and the
    step on its boundary closes it, whether or not steps are missing. Steps serve as event
    time: state is dropped once the log is two intervals further.
    """
    step = F.col("step")
    timed = log.select("step", "loss", F.timestamp_seconds(step).alias("at")).withWatermark("at", f"{2 * every} seconds")
    sums = timed.groupBy(F.window("at", f"{every} seconds").alias("span")).agg(
        F.sum("loss").alias("total"), F.max(closes_interval(step, every)).alias("closed")
    )
    closed = sums.where("closed").select(F.unix_seconds("span.end").alias("step"), (F.col("total") / every).alias("loss"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (
        closed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """What ``stream_interval`` wrote. An interval that got late steps counts as last written."""
    rows = spark.read.schema("step long, loss double, batch long").parquet(path)
    return rows.groupBy("step").agg(F.max_by("loss", "batch").alias("loss"))


class DecayedState(StatefulProcessor):
    """States of the keys of one group, carried from micro-batch to micro-batch."""

    def __init__(self, key: str, key_type: str, order: list[str], columns: list[str]):
        self.key, self.key_type, self.order, self.columns = key, key_type, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", f"keys array<{self.key_type}>, h array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(self.order)
        held = self.state.get()
        # A group with the null key has no other.
        keys = [None if k is None or k != k else k for k in arrived[self.key].tolist()]
        h = dict(zip(*held)) if held else {}
        first: dict = {}
        codes = np.array([first.setdefault(k, len(first)) for k in keys])
        turns = np.argsort(codes, kind="stable")
        arrived, codes = arrived.iloc[turns], codes[turns]
        log_a, u = arrived["log_a"].to_numpy(), arrived["u"].to_numpy()
        states, edges = np.empty(len(codes)), np.flatnonzero(np.diff(codes, prepend=-1)).tolist()
        for name, lo, hi in zip(first, edges, [*edges[1:], len(codes)]):
            states[lo:hi] = fold(log_a[lo:hi], u[lo:hi], h.get(name, 0.0))
            h[name] = float(states[hi - 1])
        self.state.update((list(h), list(h.values())))
        yield arrived[self.columns].assign(h=states, readout=arrived["q"].to_numpy() * states)

    def close(self) -> None:
        pass


def stream_decayed_state(rows: DataFrame, key: str, order: list[str], groups: int = GROUPS) -> DataFrame:
    """Streaming form of ``decayed_state`` for rows that arrive in time order.

    Keys are dealt to ``groups``, whose states are read and written together: what a call
    of the processor costs is paid per group, not per key. A stream keeps the number it
    began with. A group's rows of one micro-batch meet in one task; the source's rate limit
    bounds them.
    """
    use_state_store(rows.sparkSession)
    schema = rows.withColumns({"h": F.lit(0.0), "readout": F.lit(0.0)}).schema
    group = F.when(F.col(key).isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    return rows.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(
        DecayedState(key, rows.schema[key].dataType.simpleString(), order, rows.columns), schema, outputMode="Append", timeMode="None"
    )
