"""Hashed word shingles of texts, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes that are hashed together; longer texts go through in slices cut at white space.
SLICE_BYTES = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


PLACE = odd_constants(WORDS, 5)
SHORT = odd_constants(WORDS, 6)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _slices(data: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    start, n = 0, len(data)
    while start < n:
        end = min(start + SLICE_BYTES, n)
        if end < n:
            more = np.flatnonzero(space[end:end + SLICE_BYTES])
            while not len(more) and end < n:
                end = min(end + SLICE_BYTES, n)
                more = np.flatnonzero(space[end:end + SLICE_BYTES])
            end = min(end + (int(more[0]) if len(more) else 0), n)
        yield start, end
        start = end


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``raw``; A-Z count as a-z."""
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts, hashes = [], []
    for a, b in _slices(data, space):
        part, gap = data[a:b], space[a:b]
        low = part + ((part >= 65) & (part <= 90)) * np.uint8(32)
        power, inverse = _power_tables(b - a + 1)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:b - a], out=sums[1:])
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        first, last = edge[0::2], edge[1::2]
        starts.append(first + a)
        hashes.append(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer words than a shingle has its whole sequence as one; a text without
    words has an empty set.
    """
    raw = b"\n".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1
    starts, words = word_hashes(raw)
    first = np.searchsorted(starts, np.append(begins, len(raw) + 1))
    if len(words) >= WORDS:
        m = len(words) - WORDS + 1
        grams = words[:m] * PLACE[0]
        for k in range(1, WORDS):
            grams = grams + words[k:k + m] * PLACE[k]
        grams = mix(grams)
    else:
        grams = np.empty(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= WORDS:
            out.append(np.unique(grams[a:b - WORDS + 1]))
        elif n:
            out.append(mix(np.array([(words[a:b] * SHORT[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
