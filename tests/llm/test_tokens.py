"""BPE and binary records against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import edge_texts, frame, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.functions.ids import id_width
from corpusloom.llm import bpe, piece_cache, records
from corpusloom.session import scratch_path

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = [
    "a", "é", "the", " ", "  ", "\n", "\t", " \n", "'s", "'S", "123", " ", "日本", "\U0001f600", ".", "...", "<|endoftext|>", "<|ENDOFTEXT|>",
    "<|", "́", "İ", "ς", "Σ", "\x1c", "\x85", "\r\n", "don't", "_", "​", "x" * 300, "ab" * 200, "٣", "Ⅷ", "ﬁ", "\x0b", "≠", "ÀÉ", "µ", "ª",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return made + ["", " ", "\n", "a" * 5000, "ab c" * 3000, prose(1, 3000)]


def test_encoders_equal_the_library(texts, monkeypatch):
    monkeypatch.setattr(piece_cache, "MAX_PIECES", 500)  # the store is emptied on the way
    for path, encode in ((BYTES, bpe.Codec(BYTES).encode), (WORDS, lambda part: records.WordEncoder(WORDS).encode([t.encode() for t in part]))):
        library = Tokenizer.from_file(path)
        for a in range(0, len(texts), 750):
            part = texts[a:a + 750]
            want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
            assert [i.tolist() for i in encode(part)] == want


def test_marks_at_word_ends_and_letters_take_the_short_way(monkeypatch):
    library, tool = Tokenizer.from_file(WORDS), records.WordEncoder(WORDS)
    monkeypatch.setattr(records, "LIBRARY_WORDS", 3)
    words = ["Word", "two", "caf\u00e9", "it's", "a1", "\u010a", "x<|endoftext|>", "naïve", "d)"]
    texts = [" ".join(w + m for w in words for m in ("", ".", ",", "?!", "\x1c.")), "end.", "a.\x0b.b:", ".", "é. 1;\nÿ"]
    assert [i.tolist() for i in tool.encode([t.encode() for t in texts])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    one = records.WordEncoder(WORDS)
    one.encode([b"word word. word, word; other."])
    assert set(one.cache.rows) == {b"word", b"other", b".", b",", b";"}  # no entry per word and mark


def test_heap_and_scan_agree():
    tool, rng = bpe.codec(BYTES), random.Random(3)
    for _ in range(300):
        raw = "".join(rng.choice(["ab", "the", "aa", "é", "x", "ing"]) for _ in range(rng.randint(1, 120))).encode()
        parts = [tool.byte_ids[b] for b in raw]
        assert bpe.rank_scan(list(parts), tool.ranks, tool.merged) == bpe.rank_heap(list(parts), tool.ranks, tool.merged)


def test_decode(texts):
    tool, library = bpe.codec(BYTES), Tokenizer.from_file(BYTES)
    rng = random.Random(1)
    for ids in [[rng.randrange(50257) for _ in range(rng.randint(0, 12))] for _ in range(500)]:
        assert tool.decode(ids) == library.decode(ids, skip_special_tokens=False).encode()


def test_round_trip_of_a_table(spark):
    library, cases = Tokenizer.from_file(BYTES), edge_texts()
    got = sorted(map(tuple, bpe.round_trip(frame(spark, cases), BYTES).collect()), key=repr)
    want = []
    for i, t in cases:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(frame(spark, []), BYTES).count() == 0
    coded = bpe.encode_documents(frame(spark, cases), BYTES, keep=("doc_id", "source")).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.source) for r in coded) == sorted((i or 0, n, "a") for i, n, *_ in want)


def test_records(spark):
    library, cases = Tokenizer.from_file(WORDS), edge_texts()
    root = scratch_path(spark, "records")
    records.write(frame(spark, cases), root, WORDS, 2)
    entries = records.starts(records.index(spark, root)).cache()
    got = records.read(entries, root, id_width(records.vocab_size(WORDS))).collect()
    coded = sorted(((i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in cases), key=lambda c: (c[0] is not None, c[0] or 0))
    starts = np.cumsum([0, *(len(ids) for _, ids in coded)])[:-1].tolist()
    want = [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, ids), s in zip(coded, starts)]
    # Rows without an id lie before all others, in either order.
    assert sorted(map(tuple, got), key=lambda r: r[1])[2:] == want[2:]
    assert sorted(r[2:] for r in map(tuple, got)) == sorted(w[2:] for w in want)
    some = entries.where("doc_id in (5, 11)").orderBy(F.desc("offset"))
    assert {r.n_tokens for r in records.read(some, root, 2).collect()} == {n for i, _, n, _ in want if i in (5, 11)}
    empty = scratch_path(spark, "records")
    records.write(frame(spark, []), empty, WORDS, 2)
    assert records.starts(records.index(spark, empty)).count() == 0


def test_damaged_records_are_refused():
    whole = records.frame(b"abcdef")
    assert records.unframe(whole) == b"abcdef" and struct.unpack_from("<Q", whole)[0] == 6
    for i in range(len(whole)):
        broken = bytearray(whole)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
