"""Expressions over arrays of token ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

# Width of a stored id: two bytes reach vocabularies of 65,536 entries.
NARROW_LIMIT = 65_536


def id_width(vocab_size: int) -> int:
    """Bytes per stored id."""
    return 4 if vocab_size > NARROW_LIMIT else 2


def append_id(ids: Column, token: int) -> Column:
    return F.concat(ids, F.array(F.lit(token).cast("int")))


def ids_text(ids: Column) -> Column:
    """Ids joined by spaces, for reports and comparisons."""
    return F.array_join(ids.cast("array<string>"), " ")


def byte_ids(text: Column, offset: int = 3) -> Column:
    """UTF-8 byte values shifted past the special ids: an id scheme that needs no training."""

    @arrow_udf("array<int>")
    def to_ids(texts: pa.Array) -> pa.Array:
        raw = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
        values = np.add(data, offset, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(values))

    return to_ids(text)


#: Leading byte of packed ids, the bytes of an id. Eight is for arrays with nulls in them,
#: which are the smallest number.
_WIDTHS = {1: np.dtype("u1"), 2: np.dtype("<u2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}
_NULL = np.iinfo(np.int64).min


def _fit(values: pa.Array) -> np.ndarray:
    """The values as the narrowest numbers that hold all of them."""
    if values.null_count:
        return values.cast(pa.int64()).fill_null(_NULL).to_numpy().astype("<i8", copy=False)
    plain = values.to_numpy()
    low, high = (int(plain.min()), int(plain.max())) if len(plain) else (0, 0)
    return plain.astype(_WIDTHS[4 if low < 0 or high >= 1 << 16 else 2 if high >= 1 << 8 else 1], copy=False)


def _headers(ends: np.ndarray) -> np.ndarray:
    """Marks the first byte of each row in bytes that rows end at ``ends``."""
    marks = np.zeros(ends[-1], dtype=bool)
    marks[ends[:-1][np.diff(ends) > 0]] = True
    return marks


def pack_ids(ids: Column) -> Column:
    """An array of ids as bytes, as few an id as its batch needs: what moves or is stored in between."""

    @arrow_udf("binary")
    def pack(arrays: pa.Array) -> pa.Array:
        sizes = pa.compute.list_value_length(arrays)
        given = sizes.is_valid().to_numpy(zero_copy_only=False)
        values = _fit(arrays.flatten())
        width = values.dtype.itemsize
        ends = np.concatenate([[0], np.cumsum(np.where(given, sizes.fill_null(0).to_numpy() * width + 1, 0))]).astype(np.int64)
        marks = _headers(ends)
        data = np.empty(ends[-1], dtype=np.uint8)
        data[marks] = width
        data[~marks] = np.frombuffer(values.tobytes(), dtype=np.uint8)
        missing = None if given.all() else pa.py_buffer(np.packbits(given, bitorder="little").tobytes())
        large = pa.Array.from_buffers(pa.large_binary(), len(arrays), [missing, pa.py_buffer(ends), pa.py_buffer(data)])
        return large.cast(pa.binary())

    return pack(ids)


def unpack_ids(raw: Column) -> Column:
    """The ids that ``pack_ids`` packed."""

    @arrow_udf("array<int>")
    def unpack(rows: pa.Array) -> pa.Array:
        whole = rows.cast(pa.large_binary())
        at = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset:whole.offset + len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]]
        ends = at - at[0]
        lengths = np.diff(ends)
        marks = _headers(ends)
        widths = np.ones(len(lengths), dtype=np.int64)
        widths[lengths > 0] = data[marks]
        counts = np.maximum(lengths - 1, 0) // widths
        kinds = np.unique(widths[lengths > 1]).tolist()
        if len(kinds) <= 1:
            values = pa.array(np.frombuffer(data[~marks].tobytes(), dtype=_WIDTHS[kinds[0] if kinds else 1]).astype(np.int64 if kinds == [8] else np.int32))
        else:  # rows of several batches
            pieces = [np.frombuffer(data[a + 1:b].tobytes(), dtype=_WIDTHS[w]).astype(np.int64) for a, b, w in zip(ends, ends[1:], widths.tolist()) if b > a]
            values = pa.array(np.concatenate(pieces))
        if 8 in kinds:
            values = pa.compute.if_else(pa.compute.equal(values, _NULL), None, values)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        missing = None
        if rows.null_count:
            missing = pa.py_buffer(np.packbits(rows.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
        out = values.cast(pa.int32())
        return pa.Array.from_buffers(pa.list_(pa.int32()), len(rows), [missing, pa.py_buffer(offsets)], children=[out])

    # So no step looks into packed ids before they are where they are wanted, as a filter by length would.
    return unpack.asNondeterministic()(raw)
