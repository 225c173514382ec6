"""Removal of lines that many documents share, with two Bloom filters.

Every document gives the hashes of its distinct line keys, added up per batch of rows. By
leading hash bits they fall into shards of bounded size; a task that holds a shard marks
each hash in a filter of once-seen ones and, when it comes again, in a filter of
twice-seen ones. The second filter is folded to the size its content needs. Documents then
probe it, and only lines it suspects of being repeated are shuffled, as 256-bit digests,
for exact counts and the choice of first occurrences.

The folded filters are sent to all tasks while they are smaller than a fixed bound; beyond
it hashes meet the filters of their shards in a shuffle, hot shards split over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shingles import mix
from corpusloom.llm.skew import join_weighted
from corpusloom.llm.text import row_key, text_of
from corpusloom.session import cut, ship

LEAST_DOCUMENTS = 10
LEAST_CHARS = 1
#: Hashes a shard is planned for and bits of its filters, 16 a hash.
SHARD_KEYS = 1 << 18
SHARD_BITS = SHARD_KEYS * 16
PROBES = 4
#: A filter is folded while no more than this share of its bits would be set.
FOLD_SHARE = 0.25
#: Most bytes of folded filters that are sent to all tasks.
FILTER_BYTES = 64 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HIT = "id long, row long, digest binary, lines array<int>"


def line_keys(text: bytes) -> list[bytes]:
    """Key of each line: stripped of ASCII white space, A-Z in lower case."""
    return [line.strip() for line in text.translate(LOWER).split(b"\n")]


def distinct_keys(text: bytes, least_chars: int) -> dict[bytes, list[int]]:
    """Numbers of the lines with each key of ``least_chars`` code points or more."""
    found: dict[bytes, list[int]] = {}
    for i, key in enumerate(line_keys(text)):
        if len(key) >= least_chars:
            found.setdefault(key, []).append(i)
    if least_chars > 1:
        found = {k: v for k, v in found.items() if len(k) - sum(b & 0xC0 == 0x80 for b in k) >= least_chars}
    return found


def _digests(keys) -> list[bytes]:
    return [blake2b(k, digest_size=32).digest() for k in keys]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8").astype(np.uint64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("_text").cast(pa.binary()).to_pylist()


def _places(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Bit numbers of each hash before they are taken modulo a filter's size."""
    step = mix(hashes) | np.uint64(1)
    for k in range(PROBES):
        yield hashes + step * np.uint64(k)


def shard_of(hashes: np.ndarray, log_shards: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - log_shards)).astype(np.int64) if log_shards else np.zeros(len(hashes), np.int64)


def hash_counts(docs: DataFrame, least_chars: int) -> DataFrame:
    """``(h, n)``: in how many documents of a batch of rows each hash occurs."""

    def run(batches):
        for batch in batches:
            found = [_hashes(_digests(distinct_keys(t, least_chars))) for t in _texts(batch)]
            values, counts = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["h", "n"])

    return docs.select(text_of().alias("_text")).mapInArrow(run, "h long, n long")


class ShardFilter:
    """The two filters of one shard while its hashes pass."""

    def __init__(self, shard: int):
        self.shard, self.rows = shard, 0
        self.once, self.twice = np.zeros(SHARD_BITS, bool), np.zeros(SHARD_BITS, bool)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        values, at = np.unique(hashes, return_inverse=True)
        total = np.bincount(at, weights=counts)
        self.rows += int(counts.sum())
        places = np.stack([p & np.uint64(SHARD_BITS - 1) for p in _places(values)], axis=1).astype(np.int64)
        again = (total > 1) | self.once[places].all(axis=1)
        self.twice[places[again].ravel()] = True
        self.once[places.ravel()] = True

    def folded(self) -> bytes:
        bits = self.twice
        while len(bits) > 64:
            half = bits[:len(bits) // 2] | bits[len(bits) // 2:]
            if half.sum() > FOLD_SHARE * len(half):
                break
            bits = half
        return np.packbits(bits, bitorder="little").tobytes()


def twice_filters(counts: DataFrame, log_shards: int) -> DataFrame:
    """``(shard, bits, rows)``: the folded filter of twice-seen hashes of each shard."""

    def run(batches):
        now: ShardFilter | None = None
        emit = lambda f: pa.RecordBatch.from_pydict({"shard": [f.shard], "bits": [f.folded()], "rows": [f.rows]})
        for batch in batches:
            hashes = batch.column("h").to_numpy().view(np.uint64)
            n, shards = batch.column("n").to_numpy(), shard_of(hashes, log_shards)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if now is None or now.shard != shards[a]:
                    if now is not None:
                        yield emit(now)
                    now = ShardFilter(int(shards[a]))
                now.add(hashes[a:b], n[a:b])
        if now is not None:
            yield emit(now)

    shard = F.shiftrightunsigned("h", 64 - log_shards) if log_shards else F.lit(0).cast("long")
    dealt = counts.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard").select("h", "n")
    return dealt.mapInArrow(run, "shard long, bits binary, rows long")


class Probe:
    """Folded filters of all shards side by side."""

    def __init__(self, rows: list, log_shards: int):
        self.log_shards = log_shards
        self.size, self.first = np.ones(1 << log_shards, np.uint64), np.zeros(1 << log_shards, np.int64)
        parts, at = [b"\0"], 1
        for row in rows:
            self.size[row["shard"]], self.first[row["shard"]] = len(row["bits"]) * 8, at
            parts.append(bytes(row["bits"]))
            at += len(row["bits"])
        self.bits = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        shards = shard_of(hashes, self.log_shards)
        mask, first = self.size[shards] - np.uint64(1), self.first[shards]
        found = np.ones(len(hashes), bool)
        for place in _places(hashes):
            bit = place & mask
            found &= (self.bits[first + (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _suspects(docs: DataFrame, least_chars: int, test: Callable[[pa.RecordBatch], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """``HIT`` rows of lines that ``test(batch)(row number, hashes)`` suspects."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            out, suspects = ([], [], [], []), test(batch)
            for i, text in enumerate(_texts(batch)):
                keys = distinct_keys(text, least_chars)
                digests = _digests(keys)
                lines = list(keys.values())
                for j in np.flatnonzero(suspects(i, _hashes(digests))).tolist():
                    for column, value in zip(out, (ids[i], rows[i], digests[j], lines[j])):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["id", "row", "digest", "lines"])

    return docs.mapInArrow(run, HIT)


def _suspects_by_shuffle(keyed: DataFrame, filters: DataFrame, log_shards: int, least_chars: int) -> DataFrame:
    """Suspected lines where the filters are too large to send to all tasks.

    Hashes go to their shard's filter, which comes first in sort order. A shard with more
    hashes than its size accounts for is split by row into parts that each get its filter.
    """
    per_part = 4 * SHARD_KEYS
    split = {r["shard"]: -(-r["rows"] // per_part) for r in filters.where(F.col("rows") > per_part).select("shard", "rows").collect()}

    def hashes(batches):
        for batch in batches:
            found = [_hashes(_digests(distinct_keys(t, least_chars))) for t in _texts(batch)]
            sizes = [len(f) for f in found]
            flat = np.concatenate(found or [np.empty(0, np.uint64)])
            rows = np.repeat(batch.column("row").to_numpy(), sizes)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            shards = shard_of(flat, log_shards)
            parts = np.array([split.get(s, 1) for s in shards.tolist()], np.int64)
            columns = [pa.array(shards), pa.array(np.abs(rows) % np.maximum(parts, 1)), pa.array(flat.view(np.int64)), ids, pa.array(rows)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "h", "id", "row"])

    def probe(batches):
        now, test = None, None
        for batch in batches:
            shards, bits = batch.column("shard").to_numpy(), batch.column("bits").to_pylist()
            flat, keep = batch.column("h").to_numpy().view(np.uint64), np.zeros(len(shards), bool)
            heads = [i for i, b in enumerate(bits) if b is not None]
            for a, b in zip([0, *heads], [*heads, len(shards)]):
                if a < b and bits[a] is not None:
                    now, test = int(shards[a]), Probe([{"shard": 0, "bits": bits[a]}], 0)
                    a += 1
                if a < b and now == int(shards[a]):
                    keep[a:b] = test(flat[a:b])
            yield batch.filter(pa.array(keep)).select(["id", "row", "h"])

    sent = keyed.mapInArrow(hashes, "shard long, part long, h long, id long, row long")
    parts = F.greatest(F.ceil(F.col("rows") / per_part), F.lit(1)).cast("long")
    held = filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "bits")
    both = sent.withColumn("bits", F.lit(None).cast("binary")).unionByName(
        held.select("shard", "part", F.lit(0).cast("long").alias("h"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("row"), "bits")
    )
    dealt = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("bits").isNull())
    named = dealt.mapInArrow(probe, "id long, row long, h long").groupBy("id", "row").agg(F.collect_set("h").alias("_marked"))
    marked = keyed.join(named.withColumnsRenamed({"id": "_id", "row": "_row"}), (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")))

    def listed(batch):
        marks = batch.column("_marked")
        return lambda i, found: np.isin(found.view(np.int64), marks[i].values.to_numpy())

    return _suspects(marked.select("id", "row", "_text", "_marked"), least_chars, listed)


def suspected_lines(docs: DataFrame, least_chars: int, filter_bytes: int) -> DataFrame:
    """``HIT`` rows of all lines whose key may occur in two documents or more."""
    counts = cut(hash_counts(docs, least_chars), "line_hashes")
    log_shards = max(0, (-(-counts.count() // SHARD_KEYS) - 1).bit_length())
    filters = cut(twice_filters(counts, log_shards), "line_filters")
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("row"), text_of().alias("_text"))
    size = filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)).alias("bytes")).first()["bytes"]
    if size > filter_bytes:
        return _suspects_by_shuffle(keyed, filters, log_shards, least_chars)
    probe = Probe(filters.select("shard", "bits").collect(), log_shards)
    return _suspects(keyed, least_chars, lambda batch: lambda i, hashes: probe(hashes))


def repeated_lines(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, keep_first: bool = False, filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """``(id, row, lines)``: numbers of the lines that each document loses.

    A key counts once for each row of the table it occurs in, repeated rows too. With
    ``keep_first`` the first line of the smallest id (then row hash) that has it stays.
    """
    ship(docs.sparkSession)
    # Rows alike in id and text are one entry with their number.
    hits = cut(
        suspected_lines(docs, least_chars, filter_bytes).groupBy("id", "row", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("lines").alias("lines")),
        "suspected_lines",
    )
    counts = hits.groupBy("digest").agg(
        F.sum("n").alias("documents"), F.count(F.lit(1)).alias("entries"), F.min(F.struct("id", "row")).alias("first")
    ).where(F.col("documents") >= least_documents)
    repeated = cut(counts.select("digest", "entries", "first"), "repeated_keys")
    lost = join_weighted(hits.select("id", "row", "digest", "lines"), repeated, "digest", F.col("entries"), hits.count())
    if keep_first:
        is_first = F.col("first").eqNullSafe(F.struct("id", "row"))
        lost = lost.withColumn("lines", F.when(is_first, F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines")))
    return lost.groupBy("id", "row").agg(F.flatten(F.collect_list("lines")).alias("lines"))


def _drop(text: str, lost: list[int] | None) -> tuple[int, int, str]:
    lines = text.split("\n")
    gone = set(lost or ())
    return len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_lines`` (before dropping), ``n_dropped`` and ``kept``, the rest of the text.

    Null or empty text is one empty line, whose key is too short to be repeated, and gives
    an empty text. Rows that repeat an id, or have none, are documents of their own. Empty
    tables give no rows; other columns are not looked at.
    """
    lost = repeated_lines(docs, **options).withColumnsRenamed({"id": "_id", "row": "_row"})
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), text_of().alias("_text"))
    joined = keyed.join(lost, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "_text", "lines")

    def run(batches):
        for batch in batches:
            found = [_drop(t, lost) for t, lost in zip(batch.column("_text").to_pylist(), batch.column("lines").to_pylist())]
            n_lines, n_dropped, kept = zip(*found) if found else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")
