"""Whole jobs from files to training windows."""

import random

from pyspark.sql import functions as F

from corpusloom.plans import jobs
from corpusloom.sources import corpus, token_store


def test_from_files_to_feed(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "ba", "c"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = docs.repartitionById(6, F.pmod("doc_id", F.lit(6)).cast("int")).sortWithinPartitions("doc_id")
    files.write.parquet(f"{tmp_path}/corpus/sample/1B")

    vocab = jobs.learn_vocabulary(docs, f"{tmp_path}/vocab", vocab_size=20, num_samples=40, batch_size=10)
    again = jobs.learn_vocabulary(docs, f"{tmp_path}/vocab", vocab_size=99)
    assert again.tokens == vocab.tokens and vocab.size <= 20

    path = f"{tmp_path}/store"
    report = jobs.tokenize_corpus(spark, f"{tmp_path}/corpus", "sample-1B", vocab, path, workers=4).first()
    stream = [t for r in token_store.read(spark, path, vocab.size).orderBy("start").collect() for t in r.ids]
    by_worker = sorted(rows, key=lambda r: (r[0] % 6 % 4, r[0] % 6, r[0]))
    raw = vocab.token_bytes
    texts = b"".join(b"\0" if t == 0 else raw[t] for t in stream).decode().split("\0")
    assert texts == [t for _, t in by_worker] + [""] and report.tokens == len(stream)
    assert jobs.tokenize_corpus(spark, f"{tmp_path}/corpus", "sample-1B", vocab, path).first().action == "kept"

    capped = jobs.tokenize_corpus(spark, f"{tmp_path}/corpus", "sample-1B", vocab, f"{tmp_path}/capped", max_tokens=100, workers=4)
    assert capped.first().tokens == 100
    short = [t for r in token_store.read(spark, f"{tmp_path}/capped", vocab.size).orderBy("start").collect() for t in r.ids]
    assert short == stream[:100]

    seq, batch = 7, 2
    feed = jobs.training_feed(spark, path, vocab.size, seq, batch, eval_steps=3, world=2, workers=2)
    held = feed.held_out.orderBy("batch", "slot").collect()
    end = len(stream) - 3 * batch * (seq + 1)
    assert [(r.x, r.y) for r in held] == [
        (stream[i:i + seq], stream[i + 1:i + seq + 1]) for i in range(end, len(stream), seq + 1)]
    size = end // 4
    want = [stream[s * size + c * 8:s * size + c * 8 + 8] for s in range(4) for c in range(size // 8)]
    train = feed.train.collect()
    assert sorted(r.x + r.y[-1:] for r in train) == sorted(want)
    assert len({(r["rank"], r.feed, r.slot) for r in train}) == len(train)


def test_stream_to_store(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab ab") for i in range(9)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    vocab = jobs.learn_vocabulary(docs, f"{tmp_path}/vocab", vocab_size=20)
    report = jobs.tokenize_stream(corpus.stream(spark, f"{tmp_path}/in", docs.schema), vocab, f"{tmp_path}/store").first()
    blocks = token_store.read(spark, f"{tmp_path}/store", vocab.size).collect()
    assert report.tokens == len(blocks[0].ids) and blocks[0].ids.count(0) == 9
