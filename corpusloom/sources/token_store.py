"""Binary token store: raw fixed-width ids in ordered parts, and a manifest.

A part is written under a name of its own by one task. Only parts that Spark commits
enter the manifest, so files of failed or repeated attempts are never read. Parts in
manifest order are one flat stream; nothing copies them into a single file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from corpusloom.functions.ids import id_width, pack_ids, unpack_ids
from corpusloom.operators.positions import running_totals
from corpusloom.session import cut, parts_of, release, ship, tidied
from corpusloom.sources.inventory import size_label
from corpusloom.sources.vocab_store import exists

MANIFEST = "manifest.parquet"
PART_TOKENS = 64 << 20
BLOCK_TOKENS = 1 << 16
#: Small ranges are put together to so many tokens a task, and to more in a store that has
#: so many tasks by then.
TASK_TOKENS = 1 << 20
TASKS = 256
#: Parts are written in so many waves, one after the other, unless the packed rows take less
#: than these bytes.
WAVES = 8
WAVE_BYTES = 32 << 20
SCHEMA = "start long, ids array<int>"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and bare path of a URI; a plain path is a mounted folder."""
    scheme, mark, rest = path.partition("://")
    if mark and scheme in ("s3a", "s3n"):  # Hadoop's names for one store
        path = f"s3://{rest}"
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _dtype(width: int) -> np.dtype:
    return np.dtype("uint32" if width == 4 else "uint16")


@dataclass
class PartsWritten(WriterCommitMessage):
    parts: list[tuple[str, int, int, int]]


@dataclass
class ByteRange:
    file: str
    offset: int
    start: int
    tokens: int


@dataclass
class ByteRanges(InputPartition):
    """What a task reads: ranges that follow each other, in one part or in several."""

    ranges: list[ByteRange]


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, part_tokens: int, wave: str | None = None):
        self.path, self.width, self.part_tokens, self.wave = path, width, part_tokens, wave

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartsWritten:
        files, root = _filesystem(self.path)
        files.create_dir(root, recursive=True)
        parts, out, part = [], None, None
        for batch in iterator:
            starts = batch.column("start").to_numpy()
            ids = batch.column("ids")
            sizes = pa.compute.list_value_length(ids).to_numpy()
            values = ids.flatten().to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < 0 or values.max() >= 1 << 8 * self.width):
                raise ValueError(f"a token id does not fit in {self.width} bytes")
            flat = values.astype(_dtype(self.width))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            # Rows that follow each other in one part are written at once.
            parts_of = starts // self.part_tokens
            breaks = np.flatnonzero((np.diff(parts_of) != 0) | (starts[1:] != starts[:-1] + sizes[:-1])) + 1
            edges = [0, *breaks.tolist(), len(starts)] if len(starts) else [0]
            for i, j in zip(edges, edges[1:]):
                start = int(starts[i])
                if out is None or start // self.part_tokens != part:
                    if out is not None:
                        out.close()
                    part = start // self.part_tokens
                    name = f"tokens-{start:020d}-{uuid.uuid4().hex[:8]}.bin"
                    out = files.open_output_stream(f"{root}/{name}")
                    parts.append([name, start, 0, 0])
                elif start != parts[-1][1] + parts[-1][2]:
                    raise ValueError(f"token {start} does not follow part {parts[-1][0]}")
                count = int(bounds[j] - bounds[i])
                out.write(flat[bounds[i]:bounds[j]].tobytes())
                parts[-1][2] += count
                parts[-1][3] += count * self.width
        if out is not None:
            out.close()
        return PartsWritten([tuple(p) for p in parts])

    def commit(self, messages) -> None:
        rows = [p for m in messages if m for p in m.parts]
        if self.wave:
            files, root = _filesystem(self.path)
            files.create_dir(root, recursive=True)
            with files.open_output_stream(f"{root}/{self.wave}") as out:
                pq.write_table(_table(rows), out)
        else:
            _publish(self.path, rows)

    def abort(self, messages) -> None:
        files, root = _filesystem(self.path)
        for m in messages:
            for part in m.parts if m else ():
                files.delete_file(f"{root}/{part[0]}")


def _table(rows: list[tuple[str, int, int, int]]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.table({
        "part": pa.array(columns[0], pa.string()), "start": pa.array(columns[1], pa.int64()),
        "n_tokens": pa.array(columns[2], pa.int64()), "bytes": pa.array(columns[3], pa.int64()),
    })


def _publish(path: str, rows: list[tuple[str, int, int, int]]) -> None:
    """Make the parts a store: its manifest, without what an earlier one named."""
    rows = sorted(rows, key=lambda p: p[1])
    for before, after in zip(rows, rows[1:]):
        if before[1] + before[2] != after[1]:
            raise ValueError(f"part {after[0]} does not follow part {before[0]}")
    files, root = _filesystem(path)
    files.create_dir(root, recursive=True)
    old = _own_parts(files, root)
    with files.open_output_stream(f"{root}/{MANIFEST}") as out:
        pq.write_table(_table(rows), out)
    for name in old - {r[0] for r in rows}:
        files.delete_file(f"{root}/{name}")


def _withdraw(path: str) -> None:
    """Delete a store, its manifest first: nobody finds parts of it that are gone."""
    files, root = _filesystem(path)
    old = _own_parts(files, root)
    if files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        files.delete_file(f"{root}/{MANIFEST}")
    for name in old:
        files.delete_file(f"{root}/{name}")


def _apart(df: DataFrame, path: str) -> bool:
    """Whether rows surely come from elsewhere: from files outside the folder, or from no files."""
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    root = _filesystem(path)[1].strip("/")
    return (
        kinds <= {"LogicalRelation", "LocalRelation", "Range", "OneRowRelation"} and "RelationV2" not in plan.toString()
        and not any(f"{root}/" in f for f in df.inputFiles())
    )


def _own_parts(files: fs.FileSystem, root: str) -> set[str]:
    """Part files in the folder itself that its manifest names and that are still there."""
    if files.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return set()
    named = pq.read_table(f"{root}/{MANIFEST}", columns=["part"], filesystem=files)["part"].to_pylist()
    own = [n for n in named if "/" not in n]
    found = files.get_file_info([f"{root}/{n}" for n in own]) if own else []
    return {n for n, info in zip(own, found) if info.type == fs.FileType.File}


def _located(root: str, part: str) -> str:
    """A part's path; parts of a merged store are named from its folder, or by a full path."""
    if part.startswith("/") or "://" in part:
        return part
    while part.startswith("../"):
        root, part = root.rstrip("/").rpartition("/")[0], part[3:]
    return f"{root}/{part}"


class StoreReader(DataSourceReader):
    """Byte ranges of the parts; a path to a single headerless file works as well."""

    def __init__(self, path: str, width: int, range_tokens: int, ranges: list[tuple[int, int]] | None = None):
        self.path, self.width, self.range_tokens, self.ranges = path, width, range_tokens, ranges

    def partitions(self) -> list[ByteRanges]:
        """Ranges of at most ``range_tokens``, as many of them a task as make it worth while:
        tasks grow with the tokens of a store, not with the number of its parts."""
        ranges = self._ranges()
        most = max(TASK_TOKENS, min(PART_TOKENS, sum(r.tokens for r in ranges) // TASKS))
        tasks, held = [], 0
        for r in ranges:
            if tasks and held + r.tokens <= most:
                tasks[-1].ranges.append(r)
            else:
                tasks.append(ByteRanges([r]))
                held = 0
            held += r.tokens
        return tasks

    def _ranges(self) -> list[ByteRange]:
        files, root = _filesystem(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            parts = [(root, 0, info.size // self.width)]
        else:
            rows = pq.read_table(f"{root}/{MANIFEST}", filesystem=files).to_pylist()
            if any(r["bytes"] != r["n_tokens"] * self.width for r in rows):
                raise ValueError(f"the store's ids are not {self.width} bytes wide")
            parts = [(_located(root, r["part"]), r["start"], r["n_tokens"]) for r in rows]
        out = []
        for file, start, n in parts:
            for low, high in self.ranges if self.ranges is not None else [(start, start + n)]:
                a, b = max(low - start, 0), min(high - start, n)
                out += [ByteRange(file, at * self.width, start + at, min(self.range_tokens, b - at)) for at in range(a, b, self.range_tokens)]
        return out

    def read(self, partition: ByteRanges | None) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.path)
        for part in partition.ranges if partition else ():  # None: nothing to read at all
            with files.open_input_file(part.file) as f:
                for at in range(0, part.tokens, BLOCK_TOKENS):
                    n = min(BLOCK_TOKENS, part.tokens - at)
                    raw = f.read_at(n * self.width, part.offset + at * self.width)
                    values = np.frombuffer(raw, dtype=_dtype(self.width)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.start + at], pa.int64()),
                         pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))],
                        names=["start", "ids"],
                    )


class TokenStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenstore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoreReader:
        return StoreReader(
            self.options["path"], id_width(int(self.options["vocab_size"])),
            int(self.options.get("range_tokens", PART_TOKENS)), json.loads(self.options.get("ranges", "null")),
        )

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(
            self.options["path"], id_width(int(self.options["vocab_size"])),
            int(self.options.get("part_tokens", PART_TOKENS)), *([self.options["wave"]] if "wave" in self.options else []),
        )


def write(
    positioned: DataFrame, path: str, vocab_size: int, part_tokens: int = PART_TOKENS, force: bool = False
) -> DataFrame:
    """Write ``(start, ids)`` rows as a store and report what is there.

    An existing store is kept unless ``force``. Parts are equal stretches of the stream,
    known from the positions, so no sampling pass is needed to balance them.

    A store takes several times the disk of packed rows. So these are stored first, in
    ``WAVES`` folders with whole parts each, and moved to their parts folder by folder. A
    store that is replaced goes before that, as one file that is opened to be written,
    but only at the end where rows may come from it.
    """
    spark = positioned.sparkSession
    action = "kept"
    found = exists(spark, f"{path}/{MANIFEST}")
    if force or not found:
        ship(spark)
        spark.dataSource.register(TokenStore)
        if found and _apart(positioned, path):
            _withdraw(path)
        part = F.floor(F.col("start") / part_tokens)
        with tidied(spark):
            rows = cut(positioned.select("start", pack_ids(F.col("ids")).alias("ids"), F.pmod(part, F.lit(WAVES)).cast("int").alias("wave")), "pieces", by="wave")
            waves, size = parts_of(rows, "wave")
            names: list[str] = []

            def send(piece: DataFrame, **options) -> None:
                (
                    piece.select("start", "ids").repartition(part).sortWithinPartitions("start").select("start", unpack_ids(F.col("ids")).alias("ids"))
                    .write.format("tokenstore").option("vocab_size", vocab_size).option("part_tokens", part_tokens).options(**options)
                    .mode("overwrite").save(path)
                )

            if len(waves) <= 1 or size < WAVE_BYTES:
                send(rows)
            else:
                files, root = _filesystem(path)
                try:
                    for wave in waves:
                        names.append(f"wave-{uuid.uuid4().hex}.parquet")
                        send(wave, wave=names[-1])
                        release(wave)
                    tables = [pq.read_table(f"{root}/{name}", filesystem=files) for name in names]
                    _publish(path, [tuple(r.values()) for t in tables for r in t.to_pylist()])
                except BaseException:
                    _drop_waves(path, names, parts=True)
                    raise
                _drop_waves(path, names)
            release(rows)
        action = "written"
    return report(spark, path, vocab_size).withColumn("action", F.lit(action))


def _drop_waves(path: str, names: list[str], parts: bool = False) -> None:
    files, root = _filesystem(path)
    for name in names:
        if files.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            for part in pq.read_table(f"{root}/{name}", columns=["part"], filesystem=files)["part"].to_pylist() if parts else ():
                files.delete_file(f"{root}/{part}")
            files.delete_file(f"{root}/{name}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{MANIFEST}")


def report(spark: SparkSession, path: str, vocab_size: int) -> DataFrame:
    """Tokens and size of a store."""
    return manifest(spark, path).agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).select("tokens", "bytes", size_label(F.col("bytes")).alias("size"), F.lit(id_width(vocab_size)).alias("bytes_per_token"))


def read(
    spark: SparkSession, path: str, vocab_size: int, range_tokens: int = PART_TOKENS, ranges: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Blocks ``(start, ids)`` of a store or of one flat file; with ``ranges`` of token
    positions, which do not overlap, only their bytes."""
    ship(spark)
    spark.dataSource.register(TokenStore)
    reader = spark.read.format("tokenstore").option("vocab_size", vocab_size).option("range_tokens", range_tokens)
    return (reader if ranges is None else reader.option("ranges", json.dumps(ranges))).load(path)


def merge(spark: SparkSession, stores: list[str], path: str) -> DataFrame:
    """One stream out of the stores of several workers, in the given order.

    Only a manifest is written: the parts stay where they are and get new offsets. Stores
    beside the merged one are named from its folder, so all of them can move together.
    """
    beside = f"{path.rstrip('/').rpartition('/')[0]}/"
    named = lambda s: f"../{s.removeprefix(beside)}/" if s.startswith(beside) else f"{s}/"
    tagged = [manifest(spark, s).withColumns({"worker": F.lit(i), "part": F.concat(F.lit(named(s.rstrip("/"))), "part")}) for i, s in enumerate(stores)]
    rows = reduce(DataFrame.unionByName, tagged)
    sums = rows.groupBy("worker").agg(F.sum("n_tokens").alias("t"))
    base = running_totals(sums, {"base": F.col("t")}, bucket=F.col("worker").cast("long"), order=["worker"])
    merged = rows.join(base.select("worker", "base"), "worker")
    merged = merged.withColumn("start", F.col("start") + F.col("base")).drop("base")
    merged.coalesce(1).sortWithinPartitions("start").write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return manifest(spark, path)
