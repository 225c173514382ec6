"""Text to token ids and back."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from corpusloom.functions.ids import append_id
from corpusloom.functions.text import pieces_around_specials, text_or_empty
from corpusloom.operators.vocabulary import Vocabulary

# Entries a worker remembers before it starts over, and bytes of their texts and ids; the
# characters of unknown pieces that are merged side by side, as this takes a hundred times
# their size; and the length from which a piece is merged on its own.
CACHE_LIMIT = 500_000
CACHE_BYTES = 32 << 20
MERGE_CHARS = 1 << 18
LONG_PIECE = 512
NO_RANK = np.int64(1 << 40)


class PairRanks:
    """Hash table from a pair of ids to its merge rank, read with whole arrays at once."""

    def __init__(self, merges):
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, dtype=np.int64)
        pairs = np.array([(left << 32) | right for left, right, _ in merges], dtype=np.int64)
        for rank, (key, slot) in enumerate(zip(pairs.tolist(), self._slots(pairs).tolist())):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & (len(self.keys) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.values[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(len(keys), NO_RANK, dtype=np.int64)
        open_, slots = np.arange(len(keys)), self._slots(keys)
        while len(open_):
            held = self.keys[slots]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            going = ~hit & (held != -1)
            open_, slots = open_[going], (slots[going] + 1) & (len(self.keys) - 1)
        return out


class PieceEncoder:
    """Ids of pieces by lowest-ranked merge, remembered per worker process."""

    def __init__(self, specials, alphabet, merges):
        self.specials = {s: i for i, s in enumerate(specials)}
        self.byte_id = np.full(256, -1, dtype=np.int32)
        self.byte_id[list(alphabet)] = np.arange(len(specials), len(specials) + len(alphabet))
        self.merges = merges
        self.new_ids = np.array([m[2] for m in merges], dtype=np.int32)
        self.ranks = PairRanks(merges)
        self.rank_of = None
        self._forget()

    def _forget(self) -> None:
        self.entry: dict[str, int] = {}
        self.starts = self.sizes = np.empty(0, dtype=np.int64)
        self.store = np.empty(0, dtype=np.int32)
        self.held = 0

    def locate(self, pieces: list[str]) -> np.ndarray:
        """Entry numbers of distinct pieces; unknown ones are encoded together."""
        unknown = [w for w in pieces if w not in self.entry]
        if unknown and (len(self.entry) + len(unknown) > CACHE_LIMIT or self.held > CACHE_BYTES):
            self._forget()
            unknown = pieces
        parts = np.cumsum([len(w) for w in unknown]) // MERGE_CHARS
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(unknown)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                self._learn(unknown[a:b])
        return np.fromiter(map(self.entry.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _learn(self, pieces: list[str]) -> None:
        raw = [b"" if w in self.specials else w.encode() for w in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        alone = [(i, self.specials[pieces[i]]) for i in np.flatnonzero(sizes == 0) if pieces[i] in self.specials]
        found = [(np.array([i for i, _ in alone], np.int64), np.array([t for _, t in alone], np.int32))]
        for i in np.flatnonzero(sizes > LONG_PIECE):
            ids = self.merge_long([t for t in self.byte_id[list(raw[i])].tolist() if t >= 0])
            found.append((np.full(len(ids), i), np.array(ids, np.int32)))
            raw[i] = b""
        words = np.repeat(np.arange(len(raw)), list(map(len, raw)))
        ids = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        found += self.merge_all(words[ids >= 0], ids[ids >= 0])
        words, ids = (np.concatenate(c) for c in zip(*found))
        ids = ids[np.argsort(words, kind="stable")]
        counts = np.bincount(words, minlength=len(pieces))
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(counts) - counts])
        self.sizes = np.concatenate([self.sizes, counts])
        self.store = np.concatenate([self.store, ids])
        self.entry.update(zip(pieces, range(first, first + len(pieces))))
        self.held += int(sizes.sum()) + ids.nbytes

    def merge_all(self, words: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge the symbols of many words side by side, each round the best pair of every
        word; words without a pair left are set aside."""
        found = []
        while len(ids):
            rank = np.full(len(ids), NO_RANK, dtype=np.int64)
            rank[:-1] = self.ranks.of(ids[:-1], ids[1:])
            rank[:-1][words[:-1] != words[1:]] = NO_RANK
            heads = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            lengths = np.diff(np.concatenate([heads, [len(ids)]]))
            best = np.repeat(np.minimum.reduceat(rank, heads), lengths)
            done = best == NO_RANK
            found.append((words[done], ids[done]))
            hit = (rank == best) & ~done
            # In a run such as "aaa" the pairs overlap: every other one counts, from the left.
            spot = np.arange(len(ids))
            opens = hit & ~np.concatenate([[False], hit[:-1]])
            hit &= (spot - np.maximum.accumulate(np.where(opens, spot, 0))) % 2 == 0
            ids = np.where(hit, self.new_ids[np.where(hit, rank, 0)] if len(self.new_ids) else ids, ids)
            keep = ~done & ~np.concatenate([[False], hit[:-1]])
            words, ids = words[keep], ids[keep]
        return found

    def merge_long(self, ids: list[int]) -> list[int]:
        """One long piece: neighbours are linked and candidates queued, n log n in all."""
        if self.rank_of is None:
            self.rank_of = {(m[0], m[1]): (r, m[2]) for r, m in reversed(list(enumerate(self.merges)))}
        ranks = self.rank_of
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        queue = [(*ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(queue)
        end = len(ids)
        while queue:
            _, new, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= end or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < end:
                    p = (ids[k], ids[after[k]])
                    if p in ranks:
                        heapq.heappush(queue, (*ranks[p], k, p))
        return [t for t in ids if t >= 0]


# Encoders of this worker process; they outlive a task and keep what they have seen.
_ENCODERS: dict[int, PieceEncoder] = {}


def encode_batch(batch: pa.Array, digest: int, specials, alphabet, merges) -> pa.Array:
    """Ids of a batch of piece arrays.

    The batch is reduced to its distinct pieces first; only those are looked up, and the
    ids of every document are gathered from them with array arithmetic.
    """
    encoder = _ENCODERS.get(digest)
    if encoder is None:
        _ENCODERS.clear()
        encoder = _ENCODERS[digest] = PieceEncoder(specials, alphabet, merges)
    batch = batch.fill_null([]) if batch.null_count else batch
    coded = batch.flatten().dictionary_encode()
    entry = encoder.locate(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    length = encoder.sizes[entry]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    values = encoder.store[np.repeat(encoder.starts[entry] - (ends - length), length) + np.arange(total)]
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(batch).to_numpy(zero_copy_only=False))])
    offsets = np.concatenate([[0], ends])[bounds].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def piece_ids(words: Column, vocab: Vocabulary) -> Column:
    """Ids of an array of pieces."""
    specials, alphabet, merges = vocab.specials, list(vocab.alphabet), list(vocab.merges)
    digest = hash((tuple(specials), tuple(alphabet), tuple(merges)))

    @arrow_udf("array<int>")
    def encode(batch: pa.Array) -> pa.Array:
        return encode_batch(batch, digest, specials, alphabet, merges)

    return encode(words)


def encode_text(text: Column, vocab: Vocabulary) -> Column:
    return piece_ids(pieces_around_specials(text, vocab.specials), vocab)


def encode_docs(docs: DataFrame, vocab: Vocabulary, eot: bool = False, text: str = "text") -> DataFrame:
    """Add ``ids``. The vocabulary travels with the task, so no text is shuffled."""
    ids = encode_text(text_or_empty(text), vocab)
    out = docs.withColumn("ids", ids)
    end = vocab.special_id("<|EOT|>")
    if eot and end is not None:
        out = out.withColumn("ids", append_id(F.col("ids"), end))
    return out


def decode_ids(ids: Column, vocab: Vocabulary, skip_special: bool = True) -> Column:
    """Text of an id array; unfinished UTF-8 sequences become replacement characters."""
    hidden = len(vocab.specials) if skip_special else 0
    tokens = pa.array([b"" if i < hidden else t for i, t in enumerate(vocab.token_bytes)], pa.large_binary())

    @arrow_udf("string")
    def decode(batch: pa.Array) -> pa.Array:
        flat = tokens.take(batch.flatten())
        lengths = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.fill_null([])).to_numpy(zero_copy_only=False))])
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(lengths, pa.int64()), flat), pa.scalar(b"", pa.large_binary()))
        return pa.array([b.decode("utf-8", errors="replace") for b in joined.to_pylist()], pa.string())

    return decode(ids)


def encode_stats(encoded: DataFrame, worker: str = "worker", width: int = 2) -> DataFrame:
    """Tokens, documents and size per worker, and over all (worker is null)."""
    return (
        encoded.rollup(worker)
        .agg(F.sum(F.size("ids").cast("long")).alias("tokens"), F.count(F.lit(1)).alias("docs"))
        .withColumn("gib", F.round(F.col("tokens") * width / F.lit(1024.0**3), 6))
        .withColumn("bytes_per_token", F.lit(width))
    )
