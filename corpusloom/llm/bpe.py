"""Byte-level BPE encoding and decoding with a contiguous array of ranks.

A short piece is a list of parts and, beside it, the rank of each adjacent pair. The
smallest rank is searched again and again, its boundary is deleted and the two
neighbouring ranks are looked up anew: for a few dozen bytes nothing beats that scan.
Pieces beyond ``LONG_PIECE`` bytes, where repeated scans would be quadratic, take their
merges from a heap in the same order. Vocabulary and merges come from a tokenizer JSON
file whose path is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import PIECE_PATTERN, printable_byte
from corpusloom.llm.piece_cache import MAX_PIECES, PieceCache, blocks
from corpusloom.llm.text import text_of
from corpusloom.session import ship

LONG_PIECE = 256
NONE = 1 << 30
SHIFT = 20  # ids are below 2**20, so a pair is one integer

PIECES = regex.compile(PIECE_PATTERN)
#: A space before something other than a space or letter that could start a piece.
ODD_SPACE = re.compile(r" (?:\s|\Z)")
PIECE_START = re.compile(r"(?= \S)")


def pieces(chunk: str) -> list[str]:
    """Pieces of a chunk; a space and letters, with one mark at most, need no pattern."""
    if chunk[0] == " ":
        if chunk[1:].isalpha():
            return [chunk]
        if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
    return PIECES.findall(chunk)


def rank_scan(parts: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge ``parts`` in order of rank, leftmost first among equals."""
    row = [ranks.get(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:])]
    while row:
        best = min(row)
        if best == NONE:
            break
        i = row.index(best)
        parts[i] = merged[best]
        del parts[i + 1], row[i]
        if i:
            row[i - 1] = ranks.get(parts[i - 1] << SHIFT | parts[i], NONE)
        if i < len(row):
            row[i] = ranks.get(parts[i] << SHIFT | parts[i + 1], NONE)
    return parts


def rank_heap(parts: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """The same merges for long pieces, in n log n."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(parts[i] << SHIFT | parts[i + 1], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ranks.get(parts[i] << SHIFT | parts[j], NONE) != rank:
            continue
        parts[i], alive[j], after[i] = merged[rank], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n:
                r = ranks.get(parts[a] << SHIFT | parts[after[a]], NONE)
                if r != NONE:
                    heapq.heappush(heap, (r, a))
    return [p for p, keep in zip(parts, alive) if keep]


class Codec:
    """A byte-level tokenizer file. Special tokens in a text are ids of their own."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.setup(json.load(f))

    def setup(self, config: dict) -> None:
        vocab, merges = config["model"]["vocab"], config["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merged = [vocab[a + b] for a, b in pairs]
        self.ranks = {vocab[a] << SHIFT | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.byte_ids = [vocab[printable_byte(b)] for b in range(256)]
        byte_of = {printable_byte(b): b for b in range(256)}
        self.specials = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in self.specials}
        tokens |= {i: t.encode() for t, i in self.specials.items()}
        self.token_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        marks = "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.special = re.compile(f"({marks})") if marks else None
        self.pieces: dict[str, list[int]] = {}
        self.cache = PieceCache(self._encode_chunks)

    def encode_piece(self, piece: bytes) -> list[int]:
        parts = list(map(self.byte_ids.__getitem__, piece))
        return (rank_scan if len(parts) <= LONG_PIECE else rank_heap)(parts, self.ranks, self.merged)

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        known, out = self.pieces, []
        if len(known) > MAX_PIECES:
            known.clear()
        for c in chunks:
            if c in self.specials:
                out.append([self.specials[c]])
                continue
            ids: list[int] = []
            for p in pieces(c):
                found = known.get(p)
                if found is None:
                    found = known[p] = self.encode_piece(p.encode())
                ids = ids + found if ids else found
            out.append(ids)
        return out

    def chunks(self, text: str) -> list[str]:
        """Stretches that no piece crosses: they begin at a space before a visible
        character, and special tokens stand alone."""
        if self.special is not None and any(s in text for s in self.specials):
            out = []
            for part in self.special.split(text):
                out += [part] if part in self.specials else self._plain_chunks(part)
            return out
        return self._plain_chunks(text)

    def _plain_chunks(self, text: str) -> list[str]:
        if ODD_SPACE.search(text):
            return [c for c in PIECE_START.split(text) if c]
        head, *rest = text.split(" ")
        return [head, *[" " + c for c in rest]] if head else [" " + c for c in rest]

    def encode(self, texts: list[str]) -> list:
        """Ids of each text, as arrays."""
        found, bounds = [], [0]
        for t in texts:
            found += self.chunks(t)
            bounds.append(len(found))
        return self.cache.gather(found, bounds)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the text; bytes that are no UTF-8 become replacement characters."""
        raw = b"".join(map(self.token_bytes.__getitem__, ids))
        return raw if _valid(raw) else raw.decode("utf-8", "replace").encode()


def _valid(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _batches(rows: Iterator[pa.RecordBatch], path: str):
    """Blocks of rows with their ids: ``(batch slice, list of id arrays)``."""
    tool = codec(path)
    for batch in rows:
        texts = batch.column("_text").to_pylist()
        for a, b in blocks([len(t) for t in texts]):
            yield batch.slice(a, b - a), tool.encode(texts[a:b])


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids``. Null texts are empty and have no ids;
    repeated rows are encoded alike; an empty table gives none."""
    ship(docs.sparkSession)
    source = docs.select(*keep, text_of().alias("_text"))

    def run(batches):
        for rows, ids in _batches(batches, path):
            sizes = pa.array([len(i) for i in ids], pa.int64())
            offsets = pa.array([0, *pc.cumulative_sum(sizes).to_pylist()], pa.int32())
            flat = pa.array([], pa.int32()) if not ids else pa.concat_arrays([pa.array(i.astype("int32")) for i in ids])
            columns = [rows.column(c) for c in keep] + [sizes, pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(run, f"{kept}, n_tokens long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the text decoded from them."""
    ship(docs.sparkSession)

    def run(batches):
        tool = codec(path)
        for rows, ids in _batches(batches, path):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(tool.decode(i.tolist())).hexdigest() for i in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col("doc_id").cast("long"), text_of().alias("_text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
