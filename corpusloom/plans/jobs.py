"""Whole jobs: learn a vocabulary, tokenize a corpus, lay out the training feed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import DEFAULT_SPECIALS
from corpusloom.operators import batching, budget, encoding, packing, rows
from corpusloom.operators import vocabulary as voc
from corpusloom.session import scratch_path, ship, spread
from corpusloom.sources import corpus, token_store, vocab_store
from corpusloom.streaming import encode as stream_encoding


def learn_vocabulary(
    docs: DataFrame, path: str, vocab_size: int = 32_000, min_frequency: int = 2,
    specials: tuple[str, ...] = DEFAULT_SPECIALS, num_samples: int = 500_000, batch_size: int = 1_000,
    order: str = "doc_id", force: bool = False,
) -> voc.Vocabulary:
    """Vocabulary of the first documents, stored at ``path``; an existing one is loaded."""
    spark = docs.sparkSession
    if vocab_store.exists(spark, f"{path}/merges") and not force:
        return vocab_store.load(spark, path)
    sample = rows.first_n(docs, num_samples, batch_size, order)
    vocab = voc.train(voc.word_counts(spread(sample)), vocab_size, min_frequency, specials)
    vocab_store.save(spark, vocab, path, force=True)
    return vocab


def tokenize_corpus(
    spark: SparkSession, root: str, subset: str, vocab: voc.Vocabulary, path: str,
    max_tokens: int = 0, workers: int = 8, force: bool = False,
) -> DataFrame:
    """Encode the files of a subset under a budget into one store; returns its report."""
    ship(spark)
    if vocab_store.exists(spark, f"{path}/{token_store.MANIFEST}") and not force:
        return token_store.report(spark, path, vocab.size).withColumn("action", F.lit("kept"))
    files = rows.file_workers(corpus.select_files(spark, root, subset), workers)
    encode = lambda part: encoding.encode_docs(part, vocab, eot=True).select("worker", "file_rank", "row", "ids")
    capped = budget.cap_by_worker(budget.encode_in_waves(files, encode, max_tokens, workers), max_tokens, workers)
    return token_store.write(capped, path, vocab.size, force=True)


def tokenize_stream(
    docs: DataFrame, vocab: voc.Vocabulary, path: str, max_tokens: int = 0, order: str = "doc_id", force: bool = False,
    work: str | None = None,
) -> DataFrame:
    """Encode a stream under a budget into one store; returns its report.

    An existing store ends the job before any work. ``work`` keeps encoded batches and the
    stream's checkpoint; a run that names the same folder resumes there.
    """
    spark = docs.sparkSession
    ship(spark)
    if vocab_store.exists(spark, f"{path}/{token_store.MANIFEST}") and not force:
        return token_store.report(spark, path, vocab.size).withColumn("action", F.lit("kept"))
    work = work or scratch_path(spark, "stream-encode")
    stream_encoding.stream_encode(docs, vocab, work, f"{work}/checkpoint", max_tokens)
    return token_store.write(
        packing.stream_positions(stream_encoding.encoded(spark, work), order=order), path, vocab.size, force=force
    )


@dataclass
class Feed:
    """Training windows with ``rank, feed, slot`` and held-out windows with ``batch, slot``."""

    train: DataFrame
    held_out: DataFrame


def training_feed(
    spark: SparkSession, path: str, vocab_size: int, seq_len: int, batch_size: int,
    eval_steps: int = 20, world: int = 1, workers: int = 4, seed: int = 0,
) -> Feed:
    """Split, shard, shuffle and batch a store. Counts come from its manifest."""
    total = token_store.manifest(spark, path).agg(F.sum("n_tokens")).first()[0] or 0
    end = packing.split_point(total, seq_len, batch_size, eval_steps)
    blocks = token_store.read(spark, path, vocab_size)
    shards = world * workers
    n_windows = packing.shard_windows(end, shards, seq_len)
    grid = batching.window_grid(spark, shards, n_windows)
    order = batching.batches(batching.seeded_shuffle(grid, n_windows, seed), batch_size, workers)
    train = packing.contiguous_shards(blocks, seq_len, shards, 0, end).join(
        order.select("shard", "window", "rank", "feed", "slot"), ["shard", "window"]
    )
    tail = packing.contiguous_shards(blocks, seq_len, 1, end, total).withColumn("place", F.col("window"))
    held_out = batching.take_batches(batching.batches(tail, batch_size, 1), eval_steps)
    return Feed(
        packing.shift_targets(train.drop("shard", "window"), seq_len),
        packing.shift_targets(held_out.select("batch", "slot", "tokens"), seq_len),
    )
