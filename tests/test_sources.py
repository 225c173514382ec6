"""Scans, file choice, token stores and streams."""

import shutil
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.ids import id_width
from corpusloom.operators import batching, packing, training_log
from corpusloom.operators import rows as row_ops
from corpusloom.operators import vocabulary as voc
from corpusloom.sources import corpus, feed_store, inventory, token_store, token_stream
from corpusloom.streaming import encode, keyed, pack


def positioned(spark, n_docs=50, top=300):
    df = spark.range(n_docs).select(
        F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(0), F.col("id") % 9), lambda i: ((i * 37 + F.col("id")) % top).cast("int")).alias("ids")
    )
    return packing.stream_positions(df)


def flat(df):
    return [t for r in df.orderBy("start").collect() for t in r.ids]


def test_scan_reads_only_the_text(spark):
    plan = corpus.scan(spark, "/root/testdata/sf0.001/documents.parquet")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string>" in plan


def test_file_choice_falls_back_to_every_file(spark, tmp_path):
    for i, folder in enumerate(("a/b", "c")):
        spark.createDataFrame([(i,)], "doc_id int").coalesce(1).write.parquet(f"{tmp_path}/{folder}")
    chosen = corpus.select_files(spark, str(tmp_path), "a-b")
    assert [(r.file_rank, r.doc_id) for r in chosen.collect()] == [(0, 0)]
    everything = corpus.select_files(spark, str(tmp_path), "x-y")
    assert sorted((r.file_rank, r.doc_id) for r in everything.collect()) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("vocab_size,width", [(65_536, 2), (65_537, 4)])
def test_store_round_trip(spark, tmp_path, vocab_size, width):
    assert id_width(vocab_size) == width
    p = positioned(spark, top=vocab_size)
    path = f"{tmp_path}/store"
    report = token_store.write(p, path, vocab_size, part_tokens=40).first()
    want = flat(p)
    assert (report.action, report.tokens, report.bytes, report.bytes_per_token) == ("written", len(want), len(want) * width, width)
    parts = token_store.manifest(spark, path).orderBy("start").collect()
    raw = b"".join(open(f"{path}/{r.part}", "rb").read() for r in parts)
    assert np.frombuffer(raw, f"u{width}").tolist() == want
    assert flat(token_store.read(spark, path, vocab_size, range_tokens=7)) == want


def test_store_is_kept_unless_forced(spark, tmp_path):
    path = f"{tmp_path}/store"
    token_store.write(positioned(spark, 10), path, 300)
    assert token_store.write(positioned(spark, 20), path, 300).first().action == "kept"
    before = len(flat(token_store.read(spark, path, 300)))
    assert token_store.write(positioned(spark, 20), path, 300, force=True).first().action == "written"
    assert len(flat(token_store.read(spark, path, 300))) > before


def test_gap_in_positions_is_refused(spark, tmp_path):
    broken = positioned(spark).where("doc_id <> 7")
    with pytest.raises(Exception, match="does not follow"):
        token_store.write(broken, f"{tmp_path}/store", 300).collect()


def test_flat_file_with_a_trailing_byte(spark, tmp_path):
    file = tmp_path / "tokens.bin"
    file.write_bytes(np.arange(1_000, dtype="uint16").tobytes() + b"\x01")
    assert flat(token_store.read(spark, str(file), 300, range_tokens=33)) == list(range(1_000))


def test_merged_stores_are_one_stream(spark, tmp_path):
    parts = [positioned(spark, n) for n in (12, 5, 20)]
    paths = []
    for i, p in enumerate(parts):
        paths.append(f"{tmp_path}/{i}")
        token_store.write(p, paths[-1], 300, part_tokens=16)
    token_store.merge(spark, paths, f"{tmp_path}/all")
    assert flat(token_store.read(spark, f"{tmp_path}/all", 300)) == sum((flat(p) for p in parts), [])


def test_size_labels(spark):
    k = 1024
    df = spark.createDataFrame([(0,), (512,), (k * k,), (k * k + 1,), (k**3,), (k**3 + k**3 // 2,)], "b long")
    assert [r[0] for r in df.select(inventory.size_label(F.col("b"))).collect()] == [
        "0.0 KB", "0.5 KB", "1024.0 KB", "1.0 MB", "1024.0 MB", "1.5 GB"]


def test_listing_by_prefix(spark, tmp_path):
    (tmp_path / "ckpt").mkdir()
    for name in ("ckpt/a", "ckpt/b", "c"):
        (tmp_path / name).write_bytes(b"x" * 2_048)
    assert inventory.list_files(spark, str(tmp_path)).count() == 3
    got = inventory.list_files(spark, str(tmp_path), "ckpt/").collect()
    assert sorted((r.path[-1], r.length, r["size"]) for r in got) == [("a", 2_048, "2.0 KB"), ("b", 2_048, "2.0 KB")]


def test_blank_means_unicode_blank(spark):
    texts = ["", " \n\t", "  　", "\x1c\x1f", " a ", "​", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in row_ops.drop_blank(df).collect()}
    assert kept == {i for i, t in enumerate(texts) if (t or "").strip()}


def test_sample_rounds_up_to_batches(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    assert [row_ops.first_n(df, n, 10).count() for n in (0, 1, 10, 11, 95, 500)] == [0, 10, 10, 20, 100, 100]


def arrivals(spark, path, rows, schema, per_file):
    for lo in range(0, len(rows), per_file):
        spark.createDataFrame(rows[lo:lo + per_file], schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_budget_overshoots_by_at_most_one_micro_batch(spark, tmp_path):
    rows = [(i, "ab ab") for i in range(40)]
    arrivals(spark, f"{tmp_path}/in", rows, "doc_id long, text string", 10)
    vocab = voc.train(voc.word_counts(spark.createDataFrame(rows, "doc_id long, text string")), 20)
    docs = corpus.stream(spark, f"{tmp_path}/in", "doc_id long, text string", max_files=1)
    per_doc = None
    for cap, batches in ((0, 4), (1, 1), (10**6, 4)):
        out = f"{tmp_path}/out{cap}"
        encode.stream_encode(docs, vocab, out, f"{out}/checkpoint", max_tokens=cap)
        log = encode.progress(spark, out)
        assert log.count() == batches and encode.encoded(spark, out).count() == 10 * batches
        per_doc = per_doc or log.first().tokens // 10
    out = f"{tmp_path}/two"
    encode.stream_encode(docs, vocab, out, f"{out}/checkpoint", max_tokens=per_doc * 15)
    assert encode.encoded(spark, out).count() == 20


def test_stream_pack_resumes_where_it_stopped(spark, tmp_path):
    rows = [(i, "x" * (i % 5)) for i in range(30)]
    schema = "doc_id long, text string"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def to_ids(d):
        letters = F.transform(F.sequence(F.lit(0), F.length("text")), lambda i: (F.col("doc_id") * 10 + i).cast("int"))
        return row_ops.drop_blank(d).withColumn("ids", letters)

    for lo in (0, 20):
        arrivals(spark, source, rows[lo:lo + (20 if lo == 0 else 10)], schema, 10)
        docs = corpus.stream(spark, source, schema, max_files=1)
        pack.stream_pack(docs, to_ids, out, f"{out}/checkpoint", 4, 3)
    table = to_ids(row_ops.row_shards(spark.createDataFrame(rows, schema), 3))
    want = packing.pack_overlapping(table, 4).select("shard", "window", "tokens")
    got = pack.packed(spark, out).select("shard", "window", "tokens")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_stream_interval_after_a_resume(spark, tmp_path):
    rows = [(s, float(s)) for s in range(7, 25)]
    arrivals(spark, f"{tmp_path}/in", rows, "step long, loss double", 4)
    log = corpus.stream(spark, f"{tmp_path}/in", "step long, loss double", max_files=1)
    keyed.stream_interval(log, 5, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r.step: r.loss for r in keyed.intervals(spark, f"{tmp_path}/out").collect()}
    assert got == {10: (7 + 8 + 9) / 5, 15: 12.0, 20: 17.0, 25: 22.0}


def test_stream_interval_closes_over_missing_steps(spark, tmp_path):
    rows = [(s, float(s)) for s in range(23) if s not in (3, 11)]
    arrivals(spark, f"{tmp_path}/in", rows, "step long, loss double", 6)
    log = corpus.stream(spark, f"{tmp_path}/in", "step long, loss double", max_files=1)
    keyed.stream_interval(log, 5, f"{tmp_path}/out", f"{tmp_path}/ck")
    want = training_log.interval_loss(spark.createDataFrame(rows, "step long, loss double"), 5)
    assert sorted(map(tuple, keyed.intervals(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_budget_counts_rows_inside_a_micro_batch_and_leaves_the_rest(spark, tmp_path):
    rows = [(i, "ab ab") for i in range(40)]
    arrivals(spark, f"{tmp_path}/in", rows, "doc_id long, text string", 20)
    vocab = voc.train(voc.word_counts(spark.createDataFrame(rows, "doc_id long, text string")), 20)
    out = f"{tmp_path}/out"
    docs = corpus.stream(spark, f"{tmp_path}/in", "doc_id long, text string", max_files=1)
    encode.stream_encode(docs, vocab, out, f"{out}/ck", max_tokens=1, batch_rows=8)
    assert sorted(r.doc_id for r in encode.encoded(spark, out).collect()) == list(range(8))
    encode.stream_encode(docs, vocab, out, f"{out}/ck", batch_rows=8)  # the second micro-batch was not committed
    assert sorted(r.doc_id for r in encode.encoded(spark, out).collect()) == [*range(8), *range(20, 40)]


def test_ids_beyond_the_width_are_refused(spark, tmp_path):
    p = packing.stream_positions(spark.createDataFrame([(0, [1, 70_000])], "doc_id long, ids array<int>"))
    with pytest.raises(Exception, match="does not fit"):
        token_store.write(p, f"{tmp_path}/store", 400).collect()


def test_a_forced_write_leaves_no_old_parts(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    for n in (30, 12):
        token_store.write(positioned(spark, n), path, 300, part_tokens=16, force=True)
    named = {r.part for r in token_store.manifest(spark, path).collect()}
    assert {f.name for f in (tmp_path / "store").iterdir() if f.name.endswith(".bin")} == named
    for root in (path, f"{tmp_path}/store", f"{tmp_path}//store/", f"file:{tmp_path}/store"):
        assert inventory.list_files(spark, root, "tokens-").count() == len(named)
    with pytest.raises(Exception, match="bytes wide"):
        token_store.read(spark, path, 70_000).collect()


def test_feed_resumes_at_any_step(spark, tmp_path):
    seq, batch, workers, ranks, accum = 3, 2, 2, 2, 3
    given = [5, 0, 4, 3]  # windows of each shard
    rows = [(s, w, [100 * s + 10 * w + i for i in range(seq + 1)]) for s, n in enumerate(given) for w in range(n)]
    windows = spark.createDataFrame(rows, "shard long, window long, tokens array<int>")
    places = spark.createDataFrame([(s, w, n - 1 - w) for s, n in enumerate(given) for w in range(n)], "shard long, window long, place long")
    order = batching.batches(places, batch, workers)
    path = f"{tmp_path}/feed"
    index = feed_store.write(windows, order, path, seq, 1_000, part_tokens=10)
    placed = {(r["rank"], r.feed, r.slot): r.shard * 100 + r.window * 10 for r in order.collect()}
    feeds = {r: 1 + max(f for k, f, _ in placed if k == r) for r in range(ranks)}
    assert {(r["rank"], r.feed): r.n_windows for r in index.collect()} == Counter((r, f) for r, f, _ in placed)
    for first, steps in ((0, 1), (1, 2), (2, 30), (500, 1)):
        want = set()
        for i in range(first * accum, (first + steps) * accum):
            for r in range(ranks):
                for (k, f, s), token in placed.items():
                    if k == r and f == i % feeds[r]:
                        want.add((i // accum, r, i % accum, i // feeds[r], f, s, tuple(range(token, token + seq + 1))))
        got = feed_store.read_steps(spark, path, seq, 1_000, first, steps, accum).collect()
        assert len(got) == len(want) and {(*r[:6], tuple(r.tokens)) for r in got} == want
    # A step's bytes are read, not the store.
    blocks = token_store.read(spark, f"{path}/windows", 1_000, ranges=[[4, 9], [16, 20]]).collect()
    assert sorted(p for b in blocks for p in range(b.start, b.start + len(b.ids))) == [4, 5, 6, 7, 8, 16, 17, 18, 19]
    again = feed_store.write(windows.where("false"), order, path, seq, 1_000)
    assert again.count() == index.count()
    none = feed_store.write(windows.where("false"), order.where("false"), f"{tmp_path}/none", seq, 1_000)
    assert none.count() == 0 and feed_store.read_steps(spark, f"{tmp_path}/none", seq, 1_000, 0, 3).count() == 0


def test_merged_store_moves_with_its_parts(spark, tmp_path):
    for w in range(2):
        rows = spark.createDataFrame([(i * 3, [w, i, 7]) for i in range(4)], "start long, ids array<int>")
        token_store.write(rows, f"{tmp_path}/a/{w}", 100, part_tokens=6)
    token_store.merge(spark, [f"{tmp_path}/a/{w}" for w in range(2)], f"{tmp_path}/a/merged")
    shutil.copytree(f"{tmp_path}/a", f"{tmp_path}/b/c")
    stream = lambda path: [t for r in token_store.read(spark, path, 100).orderBy("start").collect() for t in r.ids]
    assert stream(f"{tmp_path}/b/c/merged") == stream(f"{tmp_path}/a/merged") == [x for w in range(2) for i in range(4) for x in (w, i, 7)]
    assert not [r.part for r in token_store.manifest(spark, f"{tmp_path}/b/c/merged").collect() if str(tmp_path) in r.part]


def token_arrivals(spark, path, counts):
    """One file per micro-batch; row ``i`` has ``i % 5`` tokens, all of them ``i``."""
    at = 0
    for k, n in enumerate(counts):
        rows = [(i, [i] * (i % 5)) for i in range(at, at + n)]
        spark.createDataFrame(rows, "i long, ids array<int>").coalesce(1).sortWithinPartitions("i").write.mode("append").parquet(path)
        at += n
        time.sleep(1.1)  # files arrive in order of their time


def test_stream_to_store_and_back(spark, tmp_path):
    store, ck = f"{tmp_path}/store", f"{tmp_path}/ck"
    stream = lambda most=1: corpus.stream(spark, f"{tmp_path}/in", "i long, ids array<int>", max_files=most)
    want = [i for i in range(17) for _ in range(i % 5)]
    token_arrivals(spark, f"{tmp_path}/in", [7, 0, 5])
    token_stream.write_stream(stream(), store, ck, 300)
    held = flat(token_store.read(spark, store, 300))
    assert held == want[:len(held)] and len(held) == sum(i % 5 for i in range(12))

    drained, rck = f"{tmp_path}/drained", f"{tmp_path}/rck"
    corpus.drain(token_stream.read_stream(spark, store, 300, range_tokens=3), drained, rck)
    assert flat(spark.read.parquet(drained)) == held
    # More input: the sink goes on, and so does the source from its checkpoint.
    spark.createDataFrame([(i, [i] * (i % 5)) for i in range(12, 17)], "i long, ids array<int>").coalesce(1).sortWithinPartitions("i").write.mode("append").parquet(f"{tmp_path}/in")
    token_stream.write_stream(stream(), store, ck, 300)
    assert flat(token_store.read(spark, store, 300)) == want
    corpus.drain(token_stream.read_stream(spark, store, 300), drained, rck)
    assert flat(spark.read.parquet(drained)) == want


def test_a_micro_batch_is_in_the_store_once(tmp_path):
    sink = token_stream.StreamSink(f"{tmp_path}/s", 2, 0, 4)
    batch = lambda *rows: pa.RecordBatch.from_pydict({"ids": pa.array(rows, pa.list_(pa.int32()))})
    read = lambda: [(r["part"], r["start"], r["n_tokens"]) for r in token_stream._committed(*token_stream._filesystem(f"{tmp_path}/s"))]
    sink.commit([sink.write(iter([batch([1, 2], [3])])), None, sink.write(iter([batch(None, [4])]))], 0)
    first = read()
    assert [r[1:] for r in first] == [(0, 3), (3, 1)]
    sink.commit([sink.write(iter([batch([1, 2], [3])]))], 0)  # the same micro-batch again, after a failure
    lost = sink.write(iter([batch([9])]))
    sink.abort([lost, None], 1)
    sink.commit([sink.write(iter([batch([5])]))], 1)
    assert read()[:2] == first and read()[2][1:] == (4, 1)
    assert len([f for f in (tmp_path / "s").iterdir() if f.is_file()]) == 3
    with pytest.raises(ValueError):
        sink.write(iter([batch([1 << 16])]))


@pytest.mark.parametrize("cap, rows", [(0, 20), (1, 4), (7, 4), (8, 4), (9, 8), (21, 12), (24, 12), (99, 20)])
def test_budget_of_the_sink(tmp_path, cap, rows):
    """Rows of two tokens, looked at every four, in parts of three, over two micro-batches."""
    sink = token_stream.StreamSink(f"{tmp_path}/s", 2, cap, 4)
    part = lambda: sink.write(iter([pa.RecordBatch.from_pydict({"ids": pa.array([[1, 2]] * 2, pa.list_(pa.int32()))})]))
    sink.commit([part() for _ in range(5)], 0)
    sink.commit([part() for _ in range(5)], 1)
    assert token_stream.stored_tokens(f"{tmp_path}/s") == 2 * rows
