"""Saved vocabularies: Parquet tables, or one JSON file in the common tokenizer layout."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import printable_byte
from corpusloom.operators.vocabulary import Vocabulary

_BYTE_OF = {printable_byte(b): b for b in range(256)}


def save(spark: SparkSession, vocab: Vocabulary, path: str, force: bool = False) -> bool:
    """Write the ``vocab`` and ``merges`` tables; an existing store stays unless forced."""
    if exists(spark, f"{path}/merges") and not force:
        return False
    vocab.vocab_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    vocab.merge_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    return True


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def load_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges")


def load(spark: SparkSession, path: str) -> Vocabulary:
    vocab, merges = load_tables(spark, path)
    ranked = [(r["left"], r["right"], r["new_id"]) for r in merges.orderBy("rank").collect()]
    made = {m[2] for m in ranked}
    tokens = vocab.orderBy("id").collect()
    specials = tuple(r["token"] for r in tokens if r["is_special"])
    letters = [_BYTE_OF[r["token"]] for r in tokens if not r["is_special"] and r["id"] not in made]
    return Vocabulary(specials, letters, ranked)


def from_json(spark: SparkSession, path: str) -> Vocabulary:
    """Vocabulary from a tokenizer JSON file, whose size the vocabulary bounds."""
    model = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    ids = model["model"]["vocab"]
    specials = tuple(t["content"] for t in sorted(model["added_tokens"], key=lambda t: t["id"]))
    merges = []
    for pair in model["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((ids[left], ids[right], ids[left + right]))
    made = {m[2] for m in merges}
    letters = [_BYTE_OF[t] for t, i in sorted(ids.items(), key=lambda x: x[1]) if t not in specials and i not in made]
    vocab = Vocabulary(specials, letters, merges)
    if any(ids.get(t) != i for i, t in enumerate(vocab.tokens)):
        raise ValueError("ids must run through special tokens, alphabet and merges in this order")
    return vocab


def to_json(spark: SparkSession, vocab: Vocabulary, path: str) -> None:
    """Write one tokenizer JSON file, which ``from_json`` and tokenizer libraries read."""
    tokens, hidden = vocab.tokens, len(vocab.specials)
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    model = {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {t: i for i, t in enumerate(tokens)},
        "merges": [[tokens[left], tokens[right]] for left, right, _ in vocab.merges],
    }
    text = json.dumps({
        "version": "1.0", "truncation": None, "padding": None,
        "added_tokens": [{"id": i, "content": tokens[i], **flags} for i in range(hidden)],
        "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model,
    }, ensure_ascii=False)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def special_ids(vocab: DataFrame) -> DataFrame:
    """Special tokens with their ids, and the vocabulary size."""
    size = vocab.agg(F.count(F.lit(1))).scalar()
    return vocab.where("is_special").select("token", "id", size.alias("vocab_size"))
