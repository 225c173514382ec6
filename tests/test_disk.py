"""What a store needs of the disk while it is written, and packed ids."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.ids import pack_ids, unpack_ids
from corpusloom.operators import batching, packing
from corpusloom.session import scratch_root, ship
from corpusloom.sources import feed_store, token_store


def rows_of(spark, n, size=50, shift=0):
    ids = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: ((i * 7 + F.col("id") + shift) % 300).cast("int"))
    return spark.range(n, numPartitions=3).select((F.col("id") * size).alias("start"), ids.alias("ids"))


def flat(df):
    return [t for r in df.orderBy("start").collect() for t in r.ids]


def shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (held.apply(i) for i in range(held.size())) if f.getName().startswith("shuffle_")}


def pieces(spark):
    top = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    return {x for x in os.listdir(top) if x.startswith("pieces-")} if os.path.isdir(top) else set()


def left_behind(spark, files, held):
    """Shuffle files and pieces there are now and were not; files go a moment after the job."""
    for _ in range(40):
        if not (shuffle_files(spark) - files):
            break
        time.sleep(0.25)
    return (shuffle_files(spark) - files) | (pieces(spark) - held)


def test_a_forced_write_frees_the_old_store_before_the_new_one(spark, monkeypatch, tmp_path):
    path = f"{tmp_path}/store"

    class Watched(token_store.StoreWriter):
        def write(self, iterator):
            with open(f"{tmp_path}/seen", "a") as f:
                f.write(f"{sum(n.endswith('.bin') for n in os.listdir(path))}\n")
            return super().write(iterator)

    class Store(token_store.TokenStore):
        def writer(self, schema, overwrite):
            return Watched(self.options["path"], 2, int(self.options["part_tokens"]))

    token_store.write(rows_of(spark, 40), path, 300, part_tokens=4_000)
    monkeypatch.setattr(token_store, "TokenStore", Store)
    report = token_store.write(rows_of(spark, 30, shift=5), path, 300, part_tokens=4_000, force=True).first()
    assert (report.action, report.tokens) == ("written", 1_500)
    assert {int(x) for x in open(f"{tmp_path}/seen")} == {0}


@pytest.mark.parametrize("wave_bytes", [0, 1 << 30])
def test_a_store_in_waves_is_the_same_store(spark, monkeypatch, tmp_path, wave_bytes):
    monkeypatch.setattr(token_store, "WAVE_BYTES", wave_bytes)
    path = f"{tmp_path}/store"
    for n in (60, 41):
        rows = rows_of(spark, n).repartition(4)
        assert token_store.write(rows, path, 300, part_tokens=150, force=True).first().tokens == n * 50
        assert flat(token_store.read(spark, path, 300)) == flat(rows_of(spark, n))
        parts = token_store.manifest(spark, path).orderBy("start").collect()
        assert [p.start for p in parts] == list(range(0, n * 50, 150))
        assert {p.part for p in parts} | {token_store.MANIFEST} == {f for f in os.listdir(path) if not f.startswith(".")}


def test_a_write_in_waves_drops_its_shuffles(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_store, "WAVE_BYTES", 0)
    files, held = shuffle_files(spark), pieces(spark)
    token_store.write(rows_of(spark, 60).repartition(4), f"{tmp_path}/store", 300, part_tokens=150)
    assert not left_behind(spark, files, held)


def test_a_store_rewritten_from_itself_or_broken_off(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_store, "WAVE_BYTES", 0)
    path = f"{tmp_path}/store"
    token_store.write(rows_of(spark, 60), path, 300, part_tokens=150)
    token_store.write(token_store.read(spark, path, 300), path, 300, part_tokens=150, force=True)
    assert flat(token_store.read(spark, path, 300)) == flat(rows_of(spark, 60))
    for broken, says in ((rows_of(spark, 60).where("start <> 1500"), "does not follow"), (rows_of(spark, 60).withColumn("ids", F.array(F.lit(-1))), "does not fit")):
        with pytest.raises(Exception, match=says):
            token_store.write(broken, f"{tmp_path}/broken", 300, part_tokens=150)
        assert not [f for f in os.listdir(f"{tmp_path}/broken") if not f.startswith(".") and not f.endswith(".bin")]


def test_a_feed_in_waves_leaves_no_shuffles(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_store, "WAVE_BYTES", 0)
    shards, n, seq = 4, 30, 3
    sizes = batching.equal_shards(spark, shards, n)
    docs = spark.createDataFrame([(i, [i % 250] * 8) for i in range(60)], "doc_id long, ids array<int>")
    placed = packing.contiguous_shards(packing.stream_positions(docs), seq, shards, 0, 480)
    windows = batching.batches(batching.seeded_shuffle(placed, n, 1), 4, 2, sizes)
    order = batching.batches(batching.seeded_shuffle(batching.window_grid(spark, shards, n), n, 1), 4, 2, sizes)
    want = {r.spot: r.tokens for r in windows.collect()}
    assert sorted(want) == list(range(shards * n))
    held, write, seen = pieces(spark), token_store.write, []

    def watched(*args, **options):
        before = shuffle_files(spark)
        out = write(*args, **options)
        seen.append(left_behind(spark, before, held))
        return out

    monkeypatch.setattr(token_store, "write", watched)
    feed_store.write(windows, order, f"{tmp_path}/feed", seq, 300, part_tokens=40)
    assert flat(token_store.read(spark, f"{tmp_path}/feed/windows", 300)) == [t for k in sorted(want) for t in want[k]]
    assert seen == [set()]


def test_positions_move_packed_ids_and_windows_leave_their_row(spark):
    docs = spark.createDataFrame([(i, [i] * 9) for i in range(50)], "doc_id long, ids array<int>")
    plan = packing.contiguous_shards(packing.stream_positions(docs), 4, 2, 0, 400)._jdf.queryExecution().executedPlan().toString()
    # Unpacked above the join with the totals, whatever looks at lengths further up.
    assert plan.count("unpack(") and plan.index("unpack(") < plan.index("ShuffledHashJoin") < plan.index("pack(ids", plan.index("ShuffledHashJoin"))
    assert "Generate explode(sequence(_first" not in plan


def test_packed_ids_come_back(spark):
    ship(spark)
    rows = [(0, [1, 2, 3]), (1, None), (2, []), (3, [300]), (4, [70_000, -5]), (5, [None, 7]), (6, [255] * 5)]
    for given in (rows, rows[:1], rows[1:2], rows[1:3], rows[5:6]):
        for n in (1, 7):
            df = spark.createDataFrame(given, "i long, ids array<int>").repartition(n).withColumn("ids", pack_ids(F.col("ids")))
            back = df.repartition(1).withColumn("ids", unpack_ids(F.col("ids"))).orderBy("i").collect()
            assert [tuple(r) for r in back] == given


def test_places_of_nothing_are_nothing(spark):
    df = spark.createDataFrame([(0, 7), (None, 7), (3, None), (9, 8)], "i long, seed long").coalesce(1)
    there = df.select("i", "seed", batching.permuted(F.col("i"), F.col("seed"), 10).alias("p"))
    got = there.select("i", "p", batching.permuted(F.col("p"), F.col("seed"), 10, inverse=True).alias("back")).collect()
    assert [r.back for r in got] == [r.i for r in got] == [0, None, 3, 9]
    assert all(r.p is None if r.i is None else 0 <= r.p < 10 for r in got)
