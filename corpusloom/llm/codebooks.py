"""Vector codes by product quantization, in integers throughout.

Vectors become integers and are cut into parts; every part has a codebook that rounds of
assignment and averaging refine. The nearest entry is searched in the Walsh-Hadamard
domain: transformed differences have ``width`` times the squared length of plain ones, so
their squares, added up coefficient by coefficient in order of sequency, are lower bounds
that rule entries out early, and the last sum is the exact distance.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.skew import join_weighted
from corpusloom.session import cut, ship

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows searched together, coefficients added between two eliminations, and the share of
#: entries left from which on they are picked out one by one.
BLOCK_ROWS = 256
STEP = 4
FEW = 1 / 16


@dataclass(frozen=True)
class Codes:
    """``rows``: ``vec_id``, ``label``, ``code`` (one byte a part) and ``error``; ``codebooks[part][entry]``."""

    rows: DataFrame
    codebooks: list[list[list[int]]]


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, q)`` of rows with a vector of finite components only; ``q`` is array<long>."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    finite = vectors.where(F.col("embedding").isNotNull() & ~F.exists(x, bad))
    floor = lambda v: F.when(F.abs(v) < F.lit(float(1 << 40)), F.floor(v * scale)).otherwise(F.lit((1 << 62) - 1))
    return finite.select(F.col("vec_id").cast("long"), "label", F.transform(x, floor).alias("q"))


@lru_cache
def sequency_order(width: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by their number of sign changes."""
    at = np.arange(width)
    signs = np.bitwise_count(at[:, None] & at) & 1
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def padded(length: int) -> int:
    return 1 << max(length - 1, 0).bit_length()


def transform(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, padded with zeros to a power of two, in sequency order."""
    n, length = rows.shape
    width = padded(length)
    out = np.zeros((n, width), np.int64)
    out[:, :length] = rows
    step = 1
    while step < width:
        pairs = out.reshape(n, width // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return out[:, sequency_order(width)]


def nearest(rows: np.ndarray, entries: np.ndarray, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lowest of equals, and its squared distance.

    ``rows`` and ``entries`` are transformed. Whatever is best after some coefficients is
    summed to the end; entries whose sum exceeds that leave. While many are left, sums of
    all entries go on together, which costs less than picking out the others.
    """
    n, width = rows.shape
    best, error = np.empty(n, np.int64), np.empty(n, np.int64)
    columns = np.ascontiguousarray(entries.T)
    held = np.empty((2, BLOCK_ROWS, len(entries)), np.int64)
    for a in range(0, n, BLOCK_ROWS):
        part = rows[a:a + BLOCK_ROWS]
        sums, gap = held[:, :len(part)]
        sums[:] = 0
        bound = np.full(len(part), np.iinfo(np.int64).max)
        c, alive = 0, np.ones(sums.shape, bool)
        while c < width and np.count_nonzero(alive) > FEW * alive.size:
            for c in range(c, min(c + STEP, width)):
                np.subtract(part[:, c, None], columns[c], out=gap)
                np.multiply(gap, gap, out=gap)
                np.add(sums, gap, out=sums)
            c += 1
            bound = np.minimum(bound, ((part - entries[sums.argmin(axis=1)]) ** 2).sum(axis=1))
            np.less_equal(sums, bound[:, None], out=alive)
        row, entry = np.nonzero(alive)
        left = sums[row, entry]
        if stats is not None:
            stats["terms"] = stats.get("terms", 0) + c * sums.size
        while c < width:
            more = part[row, c:c + STEP] - entries[entry, c:c + STEP]
            left = left + (more * more).sum(axis=1)
            if stats is not None:
                stats["terms"] += more.size
            c += STEP
            stays = left <= bound[row]
            row, entry, left = row[stays], entry[stays], left[stays]
        # Pairs are in order of row, then entry, and every row has one: its bound's.
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(left, first)
        nearest_ones = np.flatnonzero(left == np.repeat(least, np.diff(np.append(first, len(left)))))
        lowest = nearest_ones[np.flatnonzero(np.diff(row[nearest_ones], prepend=-1))]
        best[a:a + len(part)], error[a:a + len(part)] = entry[lowest], least // width
    return best, error


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    """Vectors as rows of one length, shorter ones followed by zeros."""
    values, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    if (sizes == length).all():
        return values.reshape(len(sizes), length)
    out = np.zeros((len(sizes), length), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _assigned(batch: pa.RecordBatch, codebooks: list[np.ndarray], length: int):
    """Vectors of a batch, cut into parts, with entry and distance in each part's codebook."""
    parts = np.split(_matrix(batch.column("q"), length), len(codebooks), axis=1)
    return [(part, *nearest(transform(part), transform(book))) for part, book in zip(parts, codebooks)]


def _refined(rows: DataFrame, codebooks: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Codebooks with each used entry replaced by the floor of its parts' mean.

    Every task adds up its own rows; what is merged has parts x entries rows a task.
    """
    width = length // len(codebooks)

    def run(batches):
        totals = [(np.zeros((len(b), width), np.int64), np.zeros(len(b), np.int64)) for b in codebooks]
        for batch in batches:
            for (sums, counts), (part, best, _) in zip(totals, _assigned(batch, codebooks, length)):
                np.add.at(sums, best, part)
                counts += np.bincount(best, minlength=len(counts))
        for p, (sums, counts) in enumerate(totals):
            used = np.flatnonzero(counts)
            lists = pa.array(sums[used].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p)), pa.array(used), pa.array(counts[used]), lists], ["part", "entry", "n", "sums"])

    partial = rows.select("q").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    merged = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", i)) for i in range(width)]).alias("sums"))
    out = [b.copy() for b in codebooks]
    for r in merged.collect():  # at most parts x entries rows
        out[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes and final codebooks of ``vectors(vec_id, embedding, label)``.

    Rows whose vector is null or has null, NaN or infinite components are left out. The
    first codebooks are the parts of the rows with the smallest ids (null ids last, equal
    ids by components); with fewer rows than entries there are that many entries. Equal
    entries and distances go to the lower index, entries nothing is assigned to stay.
    Vectors are taken at the length of the longest, rounded up to a multiple of ``parts``,
    with zeros for what is missing. An empty table gives no rows and empty codebooks. Components that
    are too large for exact sums in 64 bits are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part")
    ship(vectors.sparkSession)
    rows = cut(quantized(vectors, scale), "quantized")
    widest = rows.agg(F.max(F.size("q")).alias("length"), F.max(F.array_max(F.transform("q", F.abs))).alias("most")).first()
    length = -(-(widest["length"] or 0) // parts) * parts
    # Coefficients of a difference reach twice width x largest component, and width of their squares are added.
    if padded(length // parts) ** 2 * (2 * (widest["most"] or 0)) ** 2 >= 1 << 63:
        raise ValueError("components are too large for exact sums in 64 bits")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    start = np.zeros((len(first), length), np.int64)
    for i, r in enumerate(first):
        start[i, :len(r["q"])] = r["q"]
    codebooks = np.split(start, parts, axis=1) if length else [start] * parts
    if first and length:
        for _ in range(rounds):
            codebooks = _refined(rows, codebooks, length)

    def run(batches):
        for batch in batches:
            found = _assigned(batch, codebooks, length) if length else [(None, *np.zeros((2, batch.num_rows), np.int64))] * parts
            code = np.stack([best for _, best, _ in found], axis=1).astype(np.uint8)
            error = sum(error for _, _, error in found)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    coded = cut(rows.mapInArrow(run, f"vec_id long, label {label}, code binary, error long"), "codes")
    return Codes(coded, [b.tolist() for b in codebooks])


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over rows of the same label, nulls together."""
    keyed = codes.withColumn("_key", F.to_json(F.struct("label")))
    sums = cut(keyed.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label_errors")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    return join_weighted(keyed, sums, "_key", F.col("_n"), total).drop("_key", "_n")


def codebooks_text(codebooks: list[list[list[int]]]) -> str:
    return ",".join(str(x) for book in codebooks for entry in book for x in entry)


def codebooks_digest(codebooks: list[list[list[int]]]) -> Column:
    return F.lit(hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest())
