"""Learning a byte-level subword vocabulary from distributed counts.

A word is held as a string with one character per symbol, ``chr(SYMBOL_BASE + id)``.
Applying a merge is then ``replace('ab', 'n')``: left to right and without overlaps, as
the method demands, and string order is id order. While learning, a row holds thousands
of words, one a line, so that a merge is one call and pairs are counted as arrays.

All pairs are counted rarely. The most frequent of them are candidates whose counts the
driver keeps exact: a merge changes only words that hold its pair, so each round selects
those words and adds up what their pairs lose and gain. Pairs that are no candidates only
become rarer, so the best candidate is the best pair as long as it ranks before the last
one that was taken in. When none does any more, all pairs are counted anew.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import (
    DEFAULT_SPECIALS,
    byte_chars,
    pieces,
    printable_byte,
    text_or_empty,
)
from corpusloom.session import cut, release, ship

SYMBOL_BASE = 256
_SURROGATES = (0xD800, 0xE000)


def symbol_char(token_id: int) -> str:
    """Character that stands for a symbol; the surrogate gap is skipped, order is kept."""
    code = SYMBOL_BASE + token_id
    if code >= _SURROGATES[0]:
        code += _SURROGATES[1] - _SURROGATES[0]
    return chr(code)


def symbol_id(char: str) -> int:
    code = ord(char)
    if code >= _SURROGATES[1]:
        code -= _SURROGATES[1] - _SURROGATES[0]
    return code - SYMBOL_BASE


@dataclass
class Vocabulary:
    """Special tokens, alphabet and ranked merges: at most ``vocab_size`` small entries."""

    specials: tuple[str, ...]
    alphabet: list[int]
    merges: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def token_bytes(self) -> list[bytes]:
        """Bytes of every token, by id."""
        out = [s.encode() for s in self.specials] + [bytes([b]) for b in self.alphabet]
        for left, right, new in self.merges:
            if new == len(out):
                out.append(out[left] + out[right])
        return out

    @property
    def tokens(self) -> list[str]:
        """Printable form of every token, by id."""
        raw = self.token_bytes
        n = len(self.specials)
        return [*self.specials, *["".join(map(printable_byte, t)) for t in raw[n:]]]

    @property
    def size(self) -> int:
        return len(self.token_bytes)

    def special_id(self, token: str) -> int | None:
        return self.specials.index(token) if token in self.specials else None

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        n = len(self.specials)
        rows = [(i, t, i < n) for i, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "id int, token string, is_special boolean")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(r, *m) for r, m in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left int, right int, new_id int")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each piece occurs. Partial sums run before the shuffle, so a frequent
    piece costs one row per task."""
    return (
        docs.select(F.explode(pieces(text_or_empty(text))).alias("w"))
        .groupBy("w")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def byte_rank(b: Column) -> Column:
    """Order of a byte's printable stand-in among all 256."""
    visible = ((b >= 33) & (b <= 126)) | ((b >= 161) & (b <= 255) & (b != 173))
    below = F.when(b <= 32, b).when(b <= 160, b - 94).otherwise(F.lit(67))
    return F.when(visible, b).otherwise(below + 256)


def alphabet(words: DataFrame) -> DataFrame:
    """Distinct bytes of the words with their order: 256 rows at most."""
    chars = F.split(byte_chars(F.col("w")), "")
    return (
        words.select(F.explode(F.array_distinct(chars)).alias("c"))
        .where(F.col("c") != "")
        .distinct()
        .select(F.ascii("c").alias("byte"))
        .select("byte", byte_rank(F.col("byte")).alias("code"))
    )


def symbol_words(words: DataFrame, alphabet_bytes: list[int], n_specials: int) -> DataFrame:
    """Words as symbol strings. Bytes outside the alphabet have no symbol and vanish."""
    source = "".join(chr(b) for b in range(256))
    kept = {b: symbol_char(n_specials + i) for i, b in enumerate(alphabet_bytes)}
    matched = "".join(chr(b) for b in alphabet_bytes)
    dropped = "".join(c for c in source if ord(c) not in kept)
    return words.select(
        "w", "n",
        F.translate(byte_chars(F.col("w")), matched + dropped, "".join(kept.values())).alias("s"),
    )


def pair_counts(words: DataFrame) -> DataFrame:
    """Weighted counts of neighbouring symbols, overlapping ones included."""
    pairs = F.regexp_extract_all("s", F.lit("(?s)(?=(..))."), F.lit(1))
    return (
        words.select("n", F.explode(pairs).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("n").alias("cnt"))
    )


def best_pairs(words: DataFrame, limit: int, min_frequency: int = 1) -> DataFrame:
    """Most frequent pairs, ties to the smaller ids."""
    return (
        pair_counts(words)
        .where(F.col("cnt") >= min_frequency)
        .orderBy(F.col("cnt").desc(), "pair")
        .limit(limit)
    )


def _accept(
    ranked: list[tuple[int, int]], vocab: Vocabulary, known: dict[bytes, int], raw: list[bytes], vocab_size: int
) -> list[tuple[int, int, int]]:
    """Longest run of best pairs whose order one count already settles.

    Merging a pair only changes counts of pairs that share an end with it, and a new
    pair is never more frequent than the old pair it grew from. So the greedy order is
    known up to the first pair that chains with an accepted one.
    """
    taken: list[tuple[int, int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for left, right in ranked:
        if len(raw) >= vocab_size or left in rights or right in lefts:
            break
        joined = raw[left] + raw[right]
        new = known.get(joined)
        repeats = new is not None
        if not repeats:
            new = len(raw)
            known[joined] = new
            raw.append(joined)
        taken.append((left, right, new))
        lefts.add(left)
        rights.add(right)
        if repeats or left == right:
            break
    vocab.merges.extend(taken)
    return taken


LINE = 10
PAIR_BITS = 21
LINES = "s string, n array<long>"


def pair_code(left: int, right: int) -> int:
    """One integer per pair, in order of its ids."""
    return ord(symbol_char(left)) << PAIR_BITS | ord(symbol_char(right))


def _ids(code: int) -> tuple[int, int]:
    return symbol_id(chr(code >> PAIR_BITS)), symbol_id(chr(code & (1 << PAIR_BITS) - 1))


def word_lines(words: DataFrame, rows_each: int = 8_192) -> DataFrame:
    """``words(n, s)`` as rows of many words: symbol strings joined by line ends, and their counts."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(a, rows_each) for a in range(0, batch.num_rows, rows_each)):
                lines = "".join(s + "\n" for s in part.column("s").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([lines]), pa.array([part.column("n").to_pylist()], pa.list_(pa.int64()))], ["s", "n"])

    return words.select("s", F.col("n").cast("long").alias("n")).mapInArrow(run, LINES)


def merged(lines: str, merges: list[tuple[int, int, int]]) -> str:
    for left, right, new in merges:
        lines = lines.replace(symbol_char(left) + symbol_char(right), symbol_char(new))
    return lines


def _symbols(lines: str) -> np.ndarray:
    return np.frombuffer(lines.encode("utf-32-le"), np.uint32).astype(np.int64)


def _pairs(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and weight of each pair of neighbours in a line."""
    ends = symbols == LINE
    inside = ~(ends[:-1] | ends[1:])
    codes = (symbols[:-1] << PAIR_BITS | symbols[1:])[inside]
    return codes, counts[(np.cumsum(ends) - ends)[:-1][inside]]


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(values), np.int64)
    np.add.at(sums, at, weights)
    return values, sums


def _per_task(lines: DataFrame, count) -> DataFrame:
    """``(pair, n)``: ``count(lines, counts)`` summed over all rows, per task before the shuffle."""

    def run(batches):
        codes, weights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            for s, n in zip(batch.column("s").to_pylist(), batch.column("n")):
                found = count(s, n.values.to_numpy())
                codes.append(found[0])
                weights.append(found[1])
            codes, weights = ([x] for x in _summed(np.concatenate(codes), np.concatenate(weights)))
        yield pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(weights[0])], ["pair", "n"])

    return lines.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def line_pair_counts(lines: DataFrame, pending: list[tuple[int, int, int]]) -> DataFrame:
    """Counts of all pairs after ``pending`` merges."""
    return _per_task(lines, lambda s, n: _summed(*_pairs(_symbols(merged(s, pending)), n)))


def pair_changes(lines: DataFrame, taken: list[tuple[int, int, int]], pending: list[tuple[int, int, int]]) -> DataFrame:
    """``(pair, n)``: what merging ``taken`` after ``pending`` does to the pair counts.

    Words without one of the pairs are passed over, and of the others only pairs that share
    an end with a merge count: at most twice the number of symbols for each merge.
    """
    codes = np.array([pair_code(left, right) for left, right, _ in taken])
    lefts, rights, news = (np.array([ord(symbol_char(m[k])) for m in taken]) for k in range(3))
    firsts, seconds = np.concatenate([rights, news]), np.concatenate([lefts, news])

    def near(pairs, weights):
        kept = np.isin(pairs >> PAIR_BITS, firsts) | np.isin(pairs & (1 << PAIR_BITS) - 1, seconds) | np.isin(pairs, codes)
        return pairs[kept], weights[kept]

    def change(s, n):
        symbols = _symbols(merged(s, pending))
        ends = symbols == LINE
        line = np.cumsum(ends) - ends
        hit = np.zeros(len(n), bool)
        hit[line[:-1][np.isin(symbols[:-1] << PAIR_BITS | symbols[1:], codes)]] = True
        before, weights = symbols[hit[line]], n[hit]
        after = _symbols(merged(before.astype("<u4").tobytes().decode("utf-32-le"), taken))
        old, new = near(*_pairs(before, weights)), near(*_pairs(after, weights))
        return _summed(np.concatenate([old[0], new[0]]), np.concatenate([-old[1], new[1]]))

    return _per_task(lines, change).where("n <> 0")


class Candidates:
    """Exact counts of the pairs that rank up to ``bar``; all others rank after it."""

    def __init__(self, most: int, min_frequency: int):
        self.most, self.min_frequency = most, min_frequency
        self.counts: dict[tuple[int, int], int] = {}
        self.bar: tuple[int, tuple[int, int]] | None = None

    def refill(self, counts: DataFrame) -> None:
        best = counts.where(F.col("n") >= self.min_frequency).orderBy(F.desc("n"), "pair").limit(self.most)
        rows = [(_ids(r["pair"]), r["n"]) for r in best.collect()]
        self.counts = dict(rows)
        self.bar = (-rows[-1][1], rows[-1][0]) if len(rows) == self.most else None

    def update(self, changes: list, fresh: set[int]) -> None:
        """Take in changes; a pair with a ``fresh`` symbol had none before."""
        for row in changes:
            pair = _ids(row["pair"])
            if pair in self.counts or not fresh.isdisjoint(pair):
                n = self.counts.pop(pair, 0) + row["n"]
                if n >= self.min_frequency and (self.bar is None or (-n, pair) <= self.bar):
                    self.counts[pair] = n

    def ranked(self, most: int) -> list[tuple[int, int]]:
        """Best pairs, ties to the smaller ids."""
        return heapq.nsmallest(most, self.counts, key=lambda p: (-self.counts[p], p))


def _round_partitions(words: DataFrame, rows_each: int = 10_000) -> int:
    """Partitions of the word table: every core busy, no task too small to pay off."""
    return max(1, min(words.sparkSession.sparkContext.defaultParallelism, words.count() // rows_each))


def train(
    words: DataFrame,
    vocab_size: int = 32_000,
    min_frequency: int = 2,
    specials: tuple[str, ...] = DEFAULT_SPECIALS,
    candidates: int = 20_000,
    rebase: int = 64,
    full_alphabet: bool = False,
    most_merges: int = 32,
) -> Vocabulary:
    """Learn merges from ``words(w, n)`` until ``vocab_size`` or until no pair is frequent.

    One job per round yields up to ``most_merges`` merges. Accepted merges are replayed on
    the last written table; after ``rebase`` of them the words are written anew. The driver holds ``candidates``
    pair counts, and per round those of the pairs that share an end with its merges.
    """
    ship(words.sparkSession)
    words = cut(words, "words")
    if full_alphabet:
        letters = sorted(range(256), key=lambda b: ord(printable_byte(b)))
    else:
        letters = [r["byte"] for r in alphabet(words).orderBy("code").collect()]
    vocab = Vocabulary(tuple(specials), letters)
    raw = vocab.token_bytes
    known = {t: i for i, t in enumerate(raw)}
    symbols = symbol_words(words, letters, len(specials)).where(F.length("s") > 1).select("n", "s")
    current = cut(word_lines(symbols.repartition(_round_partitions(words))), "symbols").persist()
    pending: list[tuple[int, int, int]] = []
    best = Candidates(candidates, min_frequency)
    while len(raw) < vocab_size:
        if len(pending) >= rebase:
            fresh = cut(_replayed(current, pending), "symbols").persist()
            release(current.unpersist())
            current, pending = fresh, []
        if not best.counts:
            best.refill(line_pair_counts(current, pending))
        size = len(raw)
        accepted = _accept(best.ranked(most_merges), vocab, known, raw, vocab_size)
        if not accepted:
            break
        if accepted[-1][2] < size:
            # The last merge made a symbol that was there before: pairs with it may have
            # grown beyond the bar, so all are counted anew.
            best.counts = {}
        elif len(raw) < vocab_size:
            best.update(pair_changes(current, accepted, pending).collect(), set(range(size, len(raw))))
        pending += accepted
    release(current.unpersist())
    release(words)
    return vocab


def _replayed(lines: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Lines after ``merges``; words of a single symbol, which have no pair, end here."""

    def run(batches):
        for batch in batches:
            out = []
            for s, n in zip(batch.column("s").to_pylist(), batch.column("n").to_pylist()):
                rows = [(w, k) for w, k in zip(merged(s, merges).split("\n"), n) if len(w) > 1]
                out.append(("".join(w + "\n" for w, _ in rows), [k for _, k in rows]))
            s, n = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(n, pa.list_(pa.int64()))], ["s", "n"])

    return lines.mapInArrow(run, LINES)


def assemble(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """Vocabulary table from its three parts: specials, alphabet, merges."""
    tokens = vocab.tokens
    n, a = len(vocab.specials), len(vocab.alphabet)
    schema = "id int, token string, is_special boolean"

    def part(lo: int, hi: int, special: bool) -> DataFrame:
        return spark.createDataFrame([(i, tokens[i], special) for i in range(lo, hi)], schema)

    return part(0, n, True).unionByName(part(n, n + a, False)).unionByName(part(n + a, len(tokens), False))
