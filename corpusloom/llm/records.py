"""Length-delimited binary records of token ids, with a separate offset index.

A record is an eight-byte length, its masked checksum, the ids in little-endian order,
and their masked checksum. Documents lie in ascending ``doc_id`` order: a part holds a
range of ids, and parts follow each other. The index is a Parquet table with the part,
offset and length of each record, written by the same tasks, so that only records of
committed tasks are ever found, and any order of reading is a join with the index.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import id_width
from corpusloom.functions.text import printable_byte
from corpusloom.llm.piece_cache import PieceCache, blocks
from corpusloom.llm.text import text_of
from corpusloom.operators.positions import id_bucket, running_totals
from corpusloom.session import ship
from corpusloom.sources.token_store import _filesystem

INDEX = "index.parquet"
INDEX_SCHEMA = "doc_id long, part string, offset long, n_bytes long, n_tokens long"
HEADER = struct.Struct("<QI")
FOOTER = struct.Struct("<I")
# Fixed value: the offset added to a rotated checksum, so that checksums of data that
# holds checksums stay unlike each other.
MASK_DELTA = 0xA282EAD8
#: Words that the library gets at once: its results are many times larger than their ids.
LIBRARY_WORDS = 8_192
#: A mark at a word's end, after a letter or digit.
END_MARK = re.compile(rb"[.,;:!?](?<=[0-9A-Za-z].)(?=[ \t-\r]|\Z)")
#: Letters of ASCII and Latin-1: composed already, with a lower case of their own.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
BYTE_SYMBOLS = {b: printable_byte(b) for b in range(256)}
LINE_END = BYTE_SYMBOLS[10]


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + FOOTER.pack(masked(length)) + payload + FOOTER.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    """Payload of one whole record; raises where a length or a checksum does not hold."""
    length, check = HEADER.unpack_from(record)
    payload = record[HEADER.size:HEADER.size + length]
    if check != masked(record[:8]) or len(record) != HEADER.size + length + FOOTER.size:
        raise ValueError("a record's length is damaged")
    if FOOTER.unpack_from(record, HEADER.size + length)[0] != masked(payload):
        raise ValueError("a record's data are damaged")
    return payload


class WordEncoder:
    """The tokenizers library over the distinct words of texts.

    The file's normalizer and splitter never join anything across ASCII white space, and
    lower-case everything, so a text's ids are its words' ids. A word that ends in one
    mark after a letter or digit is the word and the mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for tool in (self.tokenizer, self.bare):
            tool.no_truncation()
            tool.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Split(LINE_END, "isolated")
        self.line_end, = self.bare.encode(LINE_END, add_special_tokens=False).ids
        self.cache = PieceCache(self._library)

    def _library(self, words: list[bytes]) -> list[list[int]]:
        out, plain, symbols, rest = {}, [], [], []
        for w in words:
            if w.isalpha():  # letters of ASCII are their own symbols
                plain.append(w)
                symbols.append(w.lower().decode())
                continue
            text = w.decode("utf-8", "replace")
            if LETTERS.fullmatch(text):
                # Normalizer and splitter leave such a word whole, in lower case.
                plain.append(w)
                symbols.append(text.lower().encode().decode("latin-1").translate(BYTE_SYMBOLS))
            else:
                rest.append((w, text))
        for at in range(0, len(plain), LIBRARY_WORDS):
            out.update(zip(plain[at:at + LIBRARY_WORDS], self._symbol_ids(symbols[at:at + LIBRARY_WORDS])))
        for at in range(0, len(rest), LIBRARY_WORDS):
            some = rest[at:at + LIBRARY_WORDS]
            found = self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)
            out.update((w, e.ids) for (w, _), e in zip(some, found))
        return [out[w] for w in words]

    def _symbol_ids(self, symbols: list[str]) -> Iterator[list[int]]:
        """Ids of words of letters: one text, in which a line end of its own id parts them."""
        ids = self.bare.encode_batch_fast([LINE_END.join(symbols)], add_special_tokens=False)[0].ids
        ends = np.flatnonzero(np.array(ids, np.int64) == self.line_end).tolist()
        return (ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)]))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        words, bounds = [], [0]
        for t in texts:
            words += END_MARK.sub(rb" \g<0>", t if b"<|" in t else t.lower()).split()
            bounds.append(len(words))
        return self.cache.gather(words, bounds)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def vocab_size(path: str) -> int:
    return word_encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int) -> None:
    """Encode texts, append ``end_id`` to each, and write parts and index under ``root``.

    Null texts are empty and have the end id alone. Rows with equal ids lie next to each
    other; rows without an id come first. An empty table writes an empty index.
    """
    spark = docs.sparkSession
    ship(spark)
    width = id_width(max(vocab_size(tokenizer), end_id + 1))
    kind = "<u4" if width == 4 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, files, out, at, name = word_encoder(tokenizer), None, None, 0, ""
        index: list[tuple] = []
        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("_text").cast(pa.binary()).to_pylist()
            for a, b in blocks([len(t) for t in texts]):
                if out is None:
                    files, folder = _filesystem(root)
                    files.create_dir(folder, recursive=True)
                    name = f"records-{uuid.uuid4().hex}.bin"
                    out = files.open_output_stream(f"{folder}/{name}")
                records = []
                for doc_id, ids in zip(ids_of[a:b], tool.encode(texts[a:b])):
                    records.append(frame(np.append(ids, end_id).astype(kind).tobytes()))
                    index.append((doc_id, name, at, len(records[-1]), len(ids) + 1))
                    at += len(records[-1])
                out.write(b"".join(records))
        if out is not None:
            out.close()  # the index of a part leaves only once its bytes are down
            columns = [pa.array(c, t) for c, t in zip(zip(*index), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "offset", "n_bytes", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long"), text_of().alias("_text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, INDEX_SCHEMA).write.parquet(f"{root}/{INDEX}")


def index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{root}/{INDEX}")


def starts(entries: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all documents before, in order of ``doc_id``."""
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    return running_totals(
        entries, {"start": F.col("n_tokens")}, bucket=id_bucket(order), order=[order, F.col("part"), F.col("offset")],
    )


def read(entries: DataFrame, root: str, width: int) -> DataFrame:
    """Follow index rows to their records: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``,
    checksums verified. Works for any subset of the index in any order."""
    ship(entries.sparkSession)
    kind = "<u4" if width == 4 else "<u2"

    def run(batches):
        files, folder = _filesystem(root)
        name, source = None, None
        for batch in batches:
            sizes, crcs = [], []
            for part, offset, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("part", "offset", "n_bytes"))):
                if part != name:
                    if source is not None:
                        source.close()
                    name, source = part, files.open_input_file(f"{folder}/{part}")
                ids = np.frombuffer(unframe(source.read_at(n_bytes, offset)), dtype=kind)
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )
        if source is not None:
            source.close()

    return entries.select("doc_id", "start", "part", "offset", "n_bytes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
