"""Ids of text pieces, remembered per worker process and gathered in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np

#: Pieces and ids a worker remembers before it starts afresh. Only speed depends on it.
MAX_PIECES = 600_000
MAX_IDS = 6_000_000
#: Bytes of text that are taken together.
BLOCK_BYTES = 4 << 20


class PieceCache:
    """Piece to ids. ``encode`` gets the pieces not seen before, each once."""

    def __init__(self, encode: Callable[[list], Sequence[Sequence[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.rows: dict = {}
        self.ids = np.empty(1 << 12, np.uint32)
        self.first = np.zeros(1 << 10, np.int64)
        self.count = np.zeros(1 << 10, np.int64)
        self.used = 0

    def _add(self, pieces: list) -> None:
        found = self.encode(pieces)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total, at = int(sizes.sum()), len(self.rows)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while at + len(pieces) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        self.first[at:at + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.count[at:at + len(pieces)] = sizes
        self.used += total
        self.rows.update(zip(pieces, range(at, at + len(pieces))))

    def gather(self, pieces: list, bounds: Sequence[int]) -> list[np.ndarray]:
        """Ids of each text; text ``i`` has the pieces ``bounds[i]:bounds[i + 1]``."""
        if len(self.rows) > MAX_PIECES or self.used > MAX_IDS:
            self.clear()
        rows = np.fromiter(map(self.rows.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            new = [pieces[i] for i in unknown.tolist()]
            self._add(list(dict.fromkeys(new)))
            rows[unknown] = np.fromiter(map(self.rows.__getitem__, new), np.int64, len(new))
        count = self.count[rows]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.first[rows] - ends[:-1], count) + np.arange(ends[-1])]
        at = ends[np.asarray(bounds)]
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def blocks(sizes: Sequence[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``most`` bytes, or one longer row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
