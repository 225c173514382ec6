"""The token store as a streaming sink and a streaming source.

As a sink, every task of a micro-batch writes its rows, as they arrive, into a part of its
own; committing the micro-batch adds one file to the store's manifest. The file is named
by the micro-batch, so one that runs again after a failure is in the store once, whichever
attempt was committed. The stream's order is that of micro-batches, partitions and rows;
inside a micro-batch it can be that of a column, for input that comes in several files.

As a source, the offset is a token position. Parts that were added since are read once,
and a query that restarts goes on where its checkpoint says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, DataSourceStreamReader, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.functions.ids import id_width
from corpusloom.session import ship
from corpusloom.sources.token_store import MANIFEST, PART_TOKENS, SCHEMA, ByteRanges, StoreReader, _dtype, _filesystem

#: What a manifest file of a micro-batch holds; ``rows`` counts documents, for the budget.
EPOCH = pa.schema([("part", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64()), ("rows", pa.int64()), ("epoch", pa.int64())])


@dataclass
class TaskPart(WriterCommitMessage):
    name: str
    tokens: int
    rows: int


def _epoch_file(root: str, epoch: int) -> str:
    return f"{root}/{MANIFEST}/epoch-{epoch:012d}.parquet"


def _committed(files: fs.FileSystem, root: str) -> list[dict]:
    """Manifest rows of all micro-batches in stream order."""
    if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    return sorted(pq.read_table(f"{root}/{MANIFEST}", filesystem=files).to_pylist(), key=lambda r: (r["start"], r["part"]))


class StreamSink(DataSourceStreamArrowWriter):
    def __init__(self, path: str, width: int, max_tokens: int, batch_rows: int):
        self.path, self.width, self.max_tokens, self.batch_rows = path, width, max_tokens, batch_rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskPart:
        """One part with the ids, and beside it the length of each row, for a budget that ends inside."""
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        name, tokens, rows = f"stream-{uuid.uuid4().hex}", 0, 0
        with files.open_output_stream(f"{root}/{name}.bin") as out, files.open_output_stream(f"{root}/{name}.rows") as lengths:
            for batch in iterator:
                ids = batch.column("ids")
                values = ids.flatten().to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or values.max() >= 1 << 8 * self.width):
                    raise ValueError(f"a token id does not fit in {self.width} bytes")
                sizes = np.nan_to_num(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.uint32)
                out.write(values.astype(_dtype(self.width)).tobytes())
                lengths.write(sizes.tobytes())
                tokens, rows = tokens + len(values), rows + len(sizes)
        return TaskPart(name, tokens, rows)

    def _within_budget(self, files: fs.FileSystem, root: str, parts: list[TaskPart], tokens: int, rows: int) -> list[TaskPart]:
        """Parts, the last one cut, up to the batch of rows that reaches the budget."""
        if not self.max_tokens:
            return parts
        kept = []
        for part in parts:
            if tokens >= self.max_tokens and rows % self.batch_rows == 0:
                break
            if tokens + part.tokens >= self.max_tokens:
                with files.open_input_stream(f"{root}/{part.name}.rows") as f:
                    sums = tokens + np.cumsum(np.frombuffer(f.read(), np.uint32).astype(np.int64))
                ends = np.flatnonzero((sums >= self.max_tokens) & ((rows + 1 + np.arange(len(sums))) % self.batch_rows == 0))
                if len(ends):
                    last = int(ends[0])
                    return [*kept, TaskPart(part.name, int(sums[last]) - tokens, last + 1)]
            kept.append(part)
            tokens, rows = tokens + part.tokens, rows + part.rows
        return kept

    def commit(self, messages, batchId: int) -> None:
        files, root = _filesystem(self.path)
        parts = [m for m in messages if m]
        if files.get_file_info(_epoch_file(root, batchId)).type == fs.FileType.File:
            self.abort(messages, batchId)  # an earlier attempt is in the store already
            return
        before = _committed(files, root)
        at, rows = sum(r["n_tokens"] for r in before), sum(r["rows"] for r in before)
        table = []
        for part in self._within_budget(files, root, parts, at, rows):
            table.append({"part": f"{part.name}.bin", "start": at, "n_tokens": part.tokens, "bytes": part.tokens * self.width, "rows": part.rows, "epoch": batchId})
            at += part.tokens
        files.create_dir(f"{root}/{MANIFEST}", recursive=True)
        hidden = f"{root}/{MANIFEST}/_{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            pq.write_table(pa.Table.from_pylist(table, EPOCH), out)
        files.move(hidden, _epoch_file(root, batchId))
        used = {r["part"] for r in table}
        for part in parts:
            files.delete_file(f"{root}/{part.name}.rows")
            if f"{part.name}.bin" not in used:
                files.delete_file(f"{root}/{part.name}.bin")

    def abort(self, messages, batchId: int) -> None:
        files, root = _filesystem(self.path)
        for part in (m for m in messages if m):
            for kind in ("bin", "rows"):
                if files.get_file_info(f"{root}/{part.name}.{kind}").type == fs.FileType.File:
                    files.delete_file(f"{root}/{part.name}.{kind}")


class SortedSink(DataSourceArrowWriter):
    """A micro-batch that was sorted, which Spark does in a batch only; else the same sink."""

    def __init__(self, sink: StreamSink, epoch: int):
        self.sink, self.epoch = sink, epoch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskPart:
        return self.sink.write(iterator)

    def commit(self, messages) -> None:
        self.sink.commit(messages, self.epoch)

    def abort(self, messages) -> None:
        self.sink.abort(messages, self.epoch)


class StreamSource(DataSourceStreamReader):
    """Offsets are token positions. A micro-batch takes all that was added since the last
    one, in ranges of bounded size, one a task."""

    def __init__(self, path: str, width: int, range_tokens: int):
        self.path, self.width, self.range_tokens = path, width, range_tokens

    def initialOffset(self) -> dict:
        return {"tokens": 0}

    def latestOffset(self) -> dict:
        return {"tokens": stored_tokens(self.path)}

    def partitions(self, start: dict, end: dict) -> list[ByteRanges]:
        if start["tokens"] >= end["tokens"]:
            return []
        return StoreReader(self.path, self.width, self.range_tokens, [(start["tokens"], end["tokens"])]).partitions()

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        return StoreReader(self.path, self.width, self.range_tokens).read(partition)


class TokenStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenstream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> StreamSource:
        return StreamSource(self.options["path"], id_width(int(self.options["vocab_size"])), int(self.options.get("range_tokens", PART_TOKENS)))

    def streamWriter(self, schema, overwrite: bool) -> StreamSink:
        return StreamSink(
            self.options["path"], id_width(int(self.options["vocab_size"])), int(self.options.get("max_tokens", 0)), int(self.options.get("batch_rows", 2_000))
        )

    def writer(self, schema, overwrite: bool) -> SortedSink:
        return SortedSink(self.streamWriter(schema, overwrite), int(self.options["epoch"]))


class BudgetReached(Exception):
    """Ends the query before a micro-batch that is past the budget is committed."""


def write_stream(
    encoded: DataFrame, path: str, checkpoint: str, vocab_size: int, max_tokens: int = 0, batch_rows: int = 2_000,
    order: str | None = None, to_ids: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Write a stream of ``ids``, or of rows that ``to_ids`` gives them, to a store until its
    input or the budget ends.

    The budget is looked at every ``batch_rows`` rows of the stream; what follows the batch
    that reaches it is not kept, and the query stops. With ``order`` rows lie in order of
    that column inside a micro-batch, sorted before ``to_ids``, whatever files they came in.
    """
    spark = encoded.sparkSession
    ship(spark)
    spark.dataSource.register(TokenStream)
    if order:
        _write_sorted(encoded, path, checkpoint, vocab_size, max_tokens, batch_rows, order, to_ids)
        return
    encoded = to_ids(encoded)
    sink = encoded.select("ids").writeStream.format("tokenstream").option("vocab_size", vocab_size).option("path", path)
    run = sink.option("max_tokens", max_tokens).option("batch_rows", batch_rows).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not run.awaitTermination(2):
        if max_tokens and stored_tokens(path) >= max_tokens:
            _stop(run)


def _write_sorted(rows: DataFrame, path: str, checkpoint: str, vocab_size: int, max_tokens: int, batch_rows: int, order: str, to_ids) -> None:
    def handle(batch: DataFrame, batch_id: int) -> None:
        if max_tokens and stored_tokens(path) >= max_tokens:
            raise BudgetReached
        batch.sparkSession.dataSource.register(TokenStream)
        ids = to_ids(batch.repartitionByRange(order).sortWithinPartitions(order)).select("ids")
        sink = ids.write.format("tokenstream").option("vocab_size", vocab_size).option("max_tokens", max_tokens)
        sink.option("batch_rows", batch_rows).option("epoch", batch_id).mode("append").save(path)

    run = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    except StreamingQueryException as error:
        if BudgetReached.__name__ not in str(error):
            raise


def _stop(run: StreamingQuery) -> None:
    run.stop()
    run.awaitTermination()


def stored_tokens(path: str) -> int:
    files, root = _filesystem(path)
    return sum(r["n_tokens"] for r in _committed(files, root))


def read_stream(spark: SparkSession, path: str, vocab_size: int, range_tokens: int = PART_TOKENS) -> DataFrame:
    """Blocks ``(start, ids)`` of a store as they are added."""
    ship(spark)
    spark.dataSource.register(TokenStream)
    reader = spark.readStream.format("tokenstream").option("vocab_size", vocab_size).option("range_tokens", range_tokens)
    return reader.option("path", path).load()
