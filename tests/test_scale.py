"""Tables in several files, long rows, large stores and many keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from corpusloom.functions.ids import byte_ids
from corpusloom.operators import batching, packing
from corpusloom.plans import queries
from corpusloom.session import ship
from corpusloom.sources import feed_store, token_store, token_stream
from corpusloom.streaming import keyed

DOCS = "doc_id long, text string"


def in_files(spark, path, rows, schema, names):
    """One Parquet file for each entry of ``names``, rows dealt in turn, so files share the range of ids."""
    for i in range(len(names)):
        spark.createDataFrame(rows[i::len(names)], schema).coalesce(1).write.mode("append").parquet(path)


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(60)]
    in_files(spark, f"{tmp_path}/documents.parquet", rows, DOCS, range(4))
    assert sorted(map(tuple, queries.corpus_stream(spark, str(tmp_path)).collect())) == rows
    assert queries.stream_encode(spark, str(tmp_path)).count() == 60
    assert 0 < queries.stream_encode_capped(spark, str(tmp_path)).count() <= 60


def test_stream_sink_keeps_the_order_of_ids_over_files(spark, tmp_path):
    rows = [(i, f"{i}," * (i % 50 + 20)) for i in range(60)]
    in_files(spark, f"{tmp_path}/documents.parquet", rows, DOCS, range(4))
    got = {r.window: r.tokens for r in queries.stream_sink(spark, str(tmp_path)).collect()}
    flat = [t for _, text in rows for t in [*(b + 3 for b in text.encode()), 0]]
    assert got == {w: " ".join(map(str, flat[w * 65:w * 65 + 65])) for w in range(len(flat) // 65)}


def test_sorted_sink_stops_at_its_budget(spark, tmp_path):
    in_files(spark, f"{tmp_path}/in", [(i, [i] * 2) for i in range(40)], "i long, ids array<int>", range(2))
    for cap, n in ((7, 4), (0, 40)):
        docs = spark.readStream.schema("i long, ids array<int>").parquet(f"{tmp_path}/in")
        token_stream.write_stream(docs, f"{tmp_path}/s{cap}", f"{tmp_path}/ck{cap}", 300, max_tokens=cap, batch_rows=4, order="i")
        blocks = token_store.read(spark, f"{tmp_path}/s{cap}", 300).orderBy("start").collect()
        assert [t for b in blocks for t in b.ids] == [i for i in range(n) for _ in range(2)]


def test_python_gets_batches_of_bounded_bytes(spark):
    ship(spark)

    @arrow_udf("long")
    def size(batch: pa.Array) -> pa.Array:
        return pa.array([batch.nbytes] * len(batch), pa.int64())

    long_texts = spark.range(600, numPartitions=1).select(F.repeat(F.lit("0123456789"), 5_000).alias("t"))
    assert long_texts.select(size("t").alias("n")).agg(F.max("n")).first()[0] < 8 << 20


def test_store_writer_and_reader_hold_bounded_batches(spark, monkeypatch, tmp_path):
    class Watched(token_store.StoreWriter):
        def write(self, iterator):
            def seen():
                for batch in iterator:
                    with open(f"{tmp_path}/seen", "a") as f:
                        f.write(f"{batch.nbytes}\n")
                    yield batch

            return super().write(seen())

    class Store(token_store.TokenStore):
        def writer(self, schema, overwrite):
            return Watched(self.options["path"], 2, int(self.options["part_tokens"]))

    monkeypatch.setattr(token_store, "TokenStore", Store)
    n = 50_000
    rows = spark.range(200).select((F.col("id") * n).alias("start"), F.sequence(F.lit(1), F.lit(n)).alias("ids"))
    token_store.write(rows, f"{tmp_path}/store", 300, part_tokens=200 * n)
    seen = [int(x) for x in open(f"{tmp_path}/seen")]
    assert sum(seen) > 200 * n * 4 and max(seen) < 8 << 20
    reader = token_store.StoreReader(f"{tmp_path}/store", 2, token_store.PART_TOKENS)
    blocks = [b["ids"].nbytes for t in reader.partitions() for b in reader.read(t)]
    assert sum(blocks) >= 200 * n * 4 and max(blocks) < 1 << 20


def test_byte_ids_of_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(0, "aé"), (1, None), (2, ""), (3, "b")], DOCS).coalesce(1)
    assert [r[0] for r in df.orderBy("doc_id").select(byte_ids(F.col("text"))).collect()] == [[100, 198, 172], [], [], [101]]


def test_read_tasks_follow_tokens_not_parts(tmp_path):
    writer = token_store.StoreWriter(f"{tmp_path}/s", 2, 100)
    rows = pa.RecordBatch.from_pydict({"start": pa.array(range(0, 50_000, 100), pa.int64()), "ids": pa.array([[i % 300] * 100 for i in range(500)], pa.list_(pa.int32()))})
    writer.commit([writer.write(iter([rows]))])
    reader = token_store.StoreReader(f"{tmp_path}/s", 2, 50)
    tasks = reader.partitions()
    assert len(tasks) == 1 and len(tasks[0].ranges) == 1_000
    blocks = sorted((b["start"][0].as_py(), b["ids"][0].as_py()) for t in tasks for b in reader.read(t))
    assert [t for _, ids in blocks for t in ids] == [i % 300 for i in range(500) for _ in range(100)]


def test_only_pieces_of_spanning_windows_are_shuffled(spark):
    """A window inside a row is a slice of it: nothing but the pieces at borders is grouped."""
    rows = spark.createDataFrame([(i * 1_000, list(range(1_000))) for i in range(8)], "start long, ids array<int>")
    windows = packing.cut_windows(rows, 4, 5)
    assert windows.count() == 1_600
    text = windows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("collect_list") == 1 and "_bucket" not in text
    positioned = packing.stream_positions(spark.createDataFrame([(i, [i] * (i % 9)) for i in range(300)], "doc_id long, ids array<int>"))
    assert "_bucket" not in positioned.columns
    flat = [i for i in range(300) for _ in range(i % 9)]
    got = {r.window: r.tokens for r in packing.cut_windows(positioned, 4, 5).collect()}
    assert got == {w: flat[w * 5:w * 5 + 5] for w in range(len(flat) // 5)}


def test_places_of_known_shards_need_no_count_and_no_join(spark, tmp_path):
    shards, n, batch, workers, seq = 4, 11, 4, 2, 3
    grid = batching.seeded_shuffle(batching.window_grid(spark, shards, n), n, 5)
    counted = batching.batches(grid, batch, workers)
    known = batching.batches(grid, batch, workers, batching.equal_shards(spark, shards, n))
    columns = ["shard", "window", "rank", "worker", "batch", "slot", "feed", "rank_batches"]
    assert sorted(map(tuple, known.select(columns).collect())) == sorted(map(tuple, counted.select(columns).collect()))
    by_feed = sorted(known.collect(), key=lambda r: (r["rank"], r.feed, r.slot))
    assert [r.spot for r in by_feed] == list(range(shards * n))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(seq)), lambda i: (F.col("shard") * 100 + F.col("window") + i).cast("int"))
    paths = []
    for name, windows in (("a", grid), ("b", known)):
        feed_store.write(windows.withColumn("tokens", tokens), counted, f"{tmp_path}/{name}", seq, 1_000)
        paths.append(token_store.read(spark, f"{tmp_path}/{name}/windows", 1_000).orderBy("start").collect())
    assert [t for r in paths[0] for t in r.ids] == [t for r in paths[1] for t in r.ids] != []


def test_decayed_state_of_many_keys_in_few_groups(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(None if k == 3 else k, i * 40 + k, -0.5, float(rng.random()), 1.0) for i in range(9) for k in range(40)]
    schema = "k long, at long, log_a double, u double, q double"
    source = f"{tmp_path}/in"
    for lo in range(0, 9, 3):
        spark.createDataFrame(rows[lo * 40:(lo + 3) * 40], schema).coalesce(1).write.mode("append").parquet(source)
    want, h = {}, {}
    for k, at, log_a, u, _ in rows:
        h[k] = h.get(k, 0.0) * np.exp(log_a) + u
        want[(k, at)] = round(h[k], 9)
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = keyed.stream_decayed_state(docs, "k", ["at"], groups=3)
    assert out.columns == ["k", "at", "log_a", "u", "q", "h", "readout"]
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    assert {(r.k, r.at): round(r.h, 9) for r in got} == want and len(got) == len(rows)
