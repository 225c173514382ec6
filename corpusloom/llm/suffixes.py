"""Repeated passages across documents, removed to the byte, by suffix sorting.

A passage is ``WINDOW`` bytes. What must be sorted is narrowed down exactly first. The
smallest 32-byte hash of a window is its anchor, so equal windows have equal anchors. The
windows that follow each other with one anchor form a segment. Where a whole segment
occurs before, all its windows do; an anchor with one kind of segment has no other
repeats. What is left are segments that share an anchor but not their surroundings: the
edges of copied passages.

Their suffixes are sorted by the difference-cover algorithm: triples at positions 1 and 2
modulo 3 are sorted and named, names are sorted by recursion, the remaining suffixes are
merged in, and neighbours in that order are compared over a window's length. Names of five
levels tell windows apart, so recursion needs no more. All segments of an anchor meet in
one block; an anchor with very many of them is dealt to several blocks, whose first
windows are then compared among blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.piece_cache import blocks
from corpusloom.llm.shingles import BASE, INVERSE, mix
from corpusloom.llm.text import row_key, text_of
from corpusloom.session import cut, ship

WINDOW = 100
GRAM = 32
ANCHORED = WINDOW - GRAM + 1
SCAN_BYTES = 1 << 20
SORT_BYTES = 1 << 20
#: Segments of one anchor in a block.
GROUP = 4096

SECOND_BASE = 0xD6E8FEB86659FD93
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _tables[base] = np.multiply.accumulate(steps)
    return _tables[base]


class Prints:
    """Hashes of any stretches of one byte array."""

    def __init__(self, data: np.ndarray, base: int = BASE, inverse: int = INVERSE):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, n + 1)[:n], out=self.sums[1:])
        self.inverse = _powers(inverse, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each window, by doubling."""
    best, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[:len(best) - step], best[step:]
        later = right < left
        best, at = np.where(later, right, left), np.where(later, at[step:], at[:len(at) - step])
        size += step
    return at


def segments(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per segment: number of its text, start in it, length, anchor and segment hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    empty = {k: np.empty(0, np.int64) for k in ("row", "start", "size", "gram", "mark")}
    if len(data) < WINDOW or not (sizes >= WINDOW).any():
        return empty
    prints = Prints(data)
    place = np.arange(len(data) - GRAM + 1)
    grams = prints.of(place, place + GRAM)
    anchor = _sliding_argmin(grams, ANCHORED)
    long = sizes >= WINDOW
    row_of = np.repeat(np.arange(len(texts)), np.where(long, sizes - WINDOW + 1, 0))
    counts = np.where(long, sizes - WINDOW + 1, 0)
    start = np.arange(len(row_of)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[row_of]
    p = anchor[start]
    edge = np.flatnonzero((np.diff(p) != 0) | (np.diff(row_of) != 0))
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(p) - 1]])
    a, b, at = start[first], start[last] + WINDOW, p[first]
    mark = mix(prints.of(a, b) + (at - a).astype(np.uint64) * np.uint64(BASE))
    return {"row": row_of[first], "start": a - begins[row_of[first]], "size": b - a, "gram": grams[at].view(np.int64), "mark": mark.view(np.int64)}


def _scan_block(ids: np.ndarray, keys: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """Segments of a block of documents; repeats inside the block are settled here."""
    found = segments(texts)
    doc, key = ids[found["row"]], keys[found["row"]]
    order = np.lexsort((found["start"], key, doc, found["mark"], found["gram"]))
    same = np.zeros(len(order), bool)
    if len(order):
        g, m = found["gram"][order], found["mark"][order]
        same[1:] = (g[1:] == g[:-1]) & (m[1:] == m[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        d, k, s = doc[order], key[order], found["start"][order]
        same &= (d != d[head]) | (k != k[head]) | (s != s[head])  # a repeated row is no earlier place
    done = np.zeros(len(order), bool)
    done[order] = same
    lone = mix((key * np.int64(31) + found["start"]).view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(done, lone, found["gram"])), pa.array(np.where(done, lone, found["mark"])), pa.array(doc), pa.array(key),
            pa.array(found["start"]), pa.array(found["size"].astype(np.int32)), pa.array(done),
        ],
        ["gram", "mark", "doc", "row", "start", "size", "done"],
    )


def suffix_order(text: np.ndarray, reach: int = 1, need: int = WINDOW) -> np.ndarray:
    """Positions of ``text``, positive integers, in order of their suffixes.

    ``reach`` is how many bytes a symbol stands for. Once that is ``need``, equal symbols
    mean equal windows, and their order does not matter.
    """
    n = len(text)
    if reach >= need or n < 3:
        return np.argsort(text, kind="stable") if reach >= need else np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    base = int(text.max()) + 1
    t = np.concatenate([text, np.zeros(4, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)  # one beyond the end keeps both halves of the names apart
    sample = np.concatenate([one, np.arange(2, n, 3)])
    pair = t[sample] * base + t[sample + 1]
    if base >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    names, named = np.unique(pair * base + t[sample + 2], return_inverse=True)
    named = named.astype(np.int64) + 1
    inner = np.argsort(named) if len(names) == len(sample) else suffix_order(named, 3 * reach, need)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[inner]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[inner]
    sorted_sample = sorted_sample[sorted_sample < n]
    # Merge: a suffix at 0 modulo 3 is compared by one symbol and a rank, or by two and a rank.
    span = n + 4
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * span + rank[rest + 1])]
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(t[ones] * span + rank[ones + 1], t[rest] * span + rank[rest + 1])
    two_key = lambda i: (t[i] * base + t[i + 1]) * span + rank[i + 2]
    before = before + np.searchsorted(two_key(twos), two_key(rest))
    out = np.empty(n, np.int64)
    # Among suffixes that agree beyond a window, ranks may be in either order; places stay apart.
    at = np.maximum.accumulate(before) + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at], out[~taken] = rest, sorted_sample
    return out


def first_windows(pieces: list[bytes], docs: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the pieces: piece, start in it, and whether none equal lies before.

    Pieces are put one after the other with a mark between them that is in no text.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    at = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\x00".join(pieces) + b"\x00", np.uint8)
    text = raw.astype(np.int64) + 2
    text[at + sizes] = 1
    order = suffix_order(text)
    counts = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    window_at = np.full(len(text), -1, np.int64)
    window_at[at[owner] + inside] = np.arange(len(owner))
    sorted_windows = window_at[order]
    sorted_windows = sorted_windows[sorted_windows >= 0]
    where = (at[owner] + inside)[sorted_windows]
    equal = np.ones(max(len(where) - 1, 0), bool)
    for k in range(WINDOW - 1, -1, -1):  # neighbours in order differ late if at all, so begin there
        equal[equal] = raw[where[:-1][equal] + k] == raw[where[1:][equal] + k]
        if not equal.any():
            break
    run = np.concatenate([[0], np.cumsum(~equal)]) if len(where) else np.empty(0, np.int64)
    doc, key, start = docs[owner][sorted_windows], keys[owner][sorted_windows], (starts[owner] + inside)[sorted_windows]
    by_place = np.lexsort((start, key, doc, run))
    head = np.concatenate([[True], run[by_place][1:] != run[by_place][:-1]]) if len(run) else np.empty(0, bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(run) else np.empty(0, np.int64)
    d, k, s = doc[by_place], key[by_place], start[by_place]
    is_first = (d == d[lead]) & (k == k[lead]) & (s == s[lead])
    first = np.empty(len(owner), bool)
    first[sorted_windows[by_place]] = is_first
    return owner, inside, first


def _sort_block(rows: list[tuple]) -> pa.RecordBatch:
    """Spans of windows that lie earlier in the block, and the first windows of anchors
    that are spread over blocks, with their hashes."""
    docs, keys, starts, pieces, spread = zip(*rows)
    docs, keys, starts, spread = np.array(docs, np.int64), np.array(keys, np.int64), np.array(starts, np.int64), np.array(spread, bool)
    owner, inside, first = first_windows(pieces, docs, keys, starts)
    late = np.flatnonzero(~first)
    breaks = np.flatnonzero((np.diff(late) != 1) | (np.diff(owner[late]) != 0)) if len(late) else np.empty(0, np.int64)
    lo, hi = (late[np.concatenate([[0], breaks + 1])], late[np.concatenate([breaks, [len(late) - 1]])]) if len(late) else (late, late)
    open_ = np.flatnonzero(first & spread[owner])
    marks = [np.empty(0, np.uint64)] * 2
    if len(open_):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = (np.cumsum(sizes) - sizes)[owner[open_]] + inside[open_]
        marks = [Prints(data, b, pow(b, -1, 1 << 64)).of(at, at + WINDOW) for b in (BASE, SECOND_BASE)]
    both = np.concatenate([lo, open_])
    begin = starts[owner[both]] + inside[both]
    end = np.concatenate([begin[:len(lo)] + (inside[hi] - inside[lo]) + WINDOW, begin[len(lo):] + WINDOW])
    none = pa.nulls(len(lo), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs[owner[both]]), pa.array(keys[owner[both]]), pa.array(begin), pa.array(end),
            *[pa.concat_arrays([none, pa.array(m.view(np.int64))]) for m in marks],
        ],
        ["doc", "row", "start", "end", "mark_a", "mark_b"],
    )


def _order_key() -> Column:
    """Documents in order of id, those without one first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc, row, start, end)``: stretches of documents covered by windows that start earlier.

    ``doc`` is the id, or the smallest long for a null one, ``row`` the hash of id and
    text that tells rows of one id apart. Stretches may overlap.
    """
    ship(docs.sparkSession)
    source = docs.select(_order_key().alias("doc"), row_key().alias("row"), text_of().alias("_text"))

    def scan(batches):
        for batch in batches:
            ids, keys = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            for a, b in blocks([len(t) for t in texts], SCAN_BYTES):
                yield _scan_block(ids[a:b], keys[a:b], texts[a:b])

    found = source.mapInArrow(scan, "gram long, mark long, doc long, row long, start long, size int, done boolean")
    kind, anchor = Window.partitionBy("gram", "mark"), Window.partitionBy("gram")
    place = F.struct("doc", "row", "start")
    met = found.repartition("gram").withColumns({"first": F.min(place).over(kind)}).withColumns({
        "kinds": F.min("mark").over(anchor) != F.max("mark").over(anchor), "n": F.count(F.lit(1)).over(anchor),
    })
    earlier = F.col("done") | (place != F.col("first"))
    left = cut(
        met.select("gram", "doc", "row", "start", "size", earlier.alias("earlier"), "kinds", "n").where(F.col("earlier") | F.col("kinds")), "segments"
    )
    settled = left.where("earlier").select("doc", "row", "start", (F.col("start") + F.col("size")).alias("end"))

    salts = F.ceil(F.col("n") / GROUP)
    edges = left.where(~F.col("earlier")).select(
        "doc", "row", F.struct("start", "size", "gram", F.pmod(F.xxhash64("row", "start"), salts).cast("int").alias("salt"), (salts > 1).alias("spread")).alias("s")
    )

    def slice_text(batches):
        for batch in batches:
            rows = []
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            for doc, key, text, segs in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), texts, batch.column("segs").to_pylist()):
                rows += [(s["gram"], s["salt"], doc, key, s["start"], text[s["start"]:s["start"] + s["size"]], s["spread"]) for s in segs]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["gram", "salt", "doc", "row", "start", "piece", "spread"])

    listed = edges.groupBy("doc", "row").agg(F.collect_set("s").alias("segs"))
    pieces = source.join(listed, ["doc", "row"]).mapInArrow(
        slice_text, "gram long, salt int, doc long, row long, start long, piece binary, spread boolean"
    )

    def sort(batches):
        held: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "salt", "doc", "row", "start", "piece", "spread"))):
                if row[:2] != key:  # groups stay whole; their size is bounded by the salts
                    if size >= SORT_BYTES:
                        yield _sort_block(held)
                        held, size = [], 0
                    key = row[:2]
                held.append(row[2:])
                size += len(row[5])
        if held:
            yield _sort_block(held)

    sorted_ = cut(
        pieces.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
        .mapInArrow(sort, "doc long, row long, start long, end long, mark_a long, mark_b long"), "sorted",
    )
    inside = sorted_.where(F.col("mark_a").isNull()).select("doc", "row", "start", "end")
    across = sorted_.where(F.col("mark_a").isNotNull())
    firsts = across.groupBy("mark_a", "mark_b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = across.join(firsts, ["mark_a", "mark_b"]).where(place != F.col("first")).select("doc", "row", "start", "end")
    return settled.unionByName(inside).unionByName(later)


def _joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``spans`` (start, end in bytes,
    maximal and ascending), and ``kept``, the remaining bytes.

    Null texts are empty; texts shorter than a window lose nothing. Rows alike in
    id and text are one document and lose the same. Rows without an id come before all
    others; rows of one id with different texts come in the order of a hash of the text.
    An empty table gives no rows.
    """
    spans = repeated_spans(docs)
    by_doc = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    source = docs.select(F.col("doc_id").cast("long"), _order_key().alias("doc"), row_key().alias("row"), text_of().alias("_text"))

    def remove(batches):
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            runs = [_joined(f) for f in batch.column("found").to_pylist()]
            kept = []
            for text, cuts in zip(texts, runs):
                edges = [0, *[e for c in cuts for e in c], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], kind), pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = source.join(by_doc, ["doc", "row"], "left").select("doc_id", "_text", "found")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
