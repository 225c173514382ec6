"""Positions, windows, budgets and batches against plain Python on small inputs."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import batching, budget, packing, positions
from corpusloom.operators.positions import id_bucket, order_value_at, row_ranks, running_totals


def docs_of(spark, sizes, ids=None):
    ids = ids or range(len(sizes))
    rows, at = [], 0
    for i, n in zip(ids, sizes):
        rows.append((i, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3), at


def overlapping(n, s):
    out, buf = [], list(range(n))
    while len(buf) >= s + 1:
        out.append(buf[: s + 1])
        buf = buf[s:]
    return out


@pytest.mark.parametrize("ids", [
    [5, 1, 9, 2_000, 3_000, 1 << 20, (1 << 40) + 7, (1 << 62)],
    [-3_000, -2, -1, 0, 1, 1_023, 1_024, 1_025],
])
@pytest.mark.parametrize("window_bits", [0, 2, positions.WINDOW_BITS])
def test_running_totals_over_sparse_ids(spark, monkeypatch, ids, window_bits):
    monkeypatch.setattr(positions, "WINDOW_BITS", window_bits)
    rows = [(g, i, k + 1) for g in "ab" for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = running_totals(df, {"before": F.col("v")}, bucket=id_bucket("i"), order=["i"], by=["g"])
    for g in "ab":
        total = 0
        for r in got.where(F.col("g") == g).orderBy("i").collect():
            assert r.before == total
            total += r.v


def test_totals_do_not_depend_on_partitions(spark):
    df = spark.range(5_000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    seen = set()
    for n in (1, 3, 8):
        out = running_totals(df.repartition(n), {"t": F.col("v")}, bucket=id_bucket("id"), order=["id"])
        seen.add(out.agg(F.bit_xor(F.xxhash64("id", "t"))).first()[0])
    assert len(seen) == 1


def test_one_hot_group(spark):
    df = spark.range(6_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = row_ranks(df, bucket=id_bucket("id"), order=["id"], by=["k"])
    hot = [r["rank"] for r in got.where("k = 'hot'").orderBy("id").collect()]
    assert hot == list(range(4_000)) and got.where("k <> 'hot' and rank > 0").count() == 0


def test_order_value(spark):
    df = spark.createDataFrame([(i * 70_001,) for i in range(10)], "doc_id long")
    assert [order_value_at(df, "doc_id", n) for n in (0, 1, 4, 10, 99)] == [None, 0, 210_003, 630_009, 630_009]


S = 4


@pytest.mark.parametrize("n", [0, 1, S, S + 1, 2 * S, 2 * S + 1, 2 * S + 2, 5 * S + 1])
def test_window_counts(spark, n):
    one, _ = docs_of(spark, [n])
    packed = packing.pack_overlapping(one.withColumn("shard", F.lit(0)), S).orderBy("window").collect()
    assert [r.tokens for r in packed] == overlapping(n, S)
    fixed = packing.chunk_fixed(one, S).orderBy("window").collect()
    assert [r.tokens for r in fixed] == [list(range(i, i + S + 1)) for i in range(0, n - S, S + 1)]


@pytest.mark.parametrize("sizes", [[3, 0, 1, 9, 2, 2, 17, 1, 1, 1, 30], [1] * 40, [100], [0, 0]])
def test_windows_across_documents_and_buckets(spark, sizes):
    """Ids far apart put every document in a bucket of its own."""
    for step in (1, 1_024):
        df, n = docs_of(spark, sizes, [i * step for i in range(len(sizes))])
        got = packing.pack_overlapping(df.withColumn("shard", F.lit(0)), S).orderBy("window").collect()
        assert [r.tokens for r in got] == overlapping(n, S)
        fixed = packing.shift_targets(packing.chunk_fixed(df, S), S).orderBy("window").collect()
        assert [(r.x, r.y) for r in fixed] == [
            (list(range(i, i + S)), list(range(i + 1, i + S + 1))) for i in range(0, n - S, S + 1)]


@pytest.mark.parametrize("shards,start,end", [(1, 0, 57), (3, 0, 57), (3, 7, 50), (8, 0, 57), (60, 0, 57), (2, 10, 10)])
def test_contiguous_shards(spark, shards, start, end):
    df, _ = docs_of(spark, [5, 20, 1, 1, 30], [0, 900, 2_000, 2_001, 9_000])
    got = packing.contiguous_shards(packing.stream_positions(df), S, shards, start, end)
    size = (end - start) // shards
    want = [(s, c, list(range(start + s * size + c * 5, start + s * size + c * 5 + 5))) for s in range(shards) for c in range(size // 5)]
    assert sorted((r.shard, r.window, r.tokens) for r in got.collect()) == want


def test_tail_split(spark):
    df, n = docs_of(spark, [5, 6, 7])
    end = packing.split_point(n, seq_len=S, batch_size=2, eval_steps=1)
    rows = packing.tail_split(packing.stream_positions(df), end).orderBy("start").collect()
    assert [(r.split, r.ids) for r in rows] == [
        ("train", [0, 1, 2, 3, 4]), ("train", [5, 6, 7]), ("eval", [8, 9, 10]), ("eval", list(range(11, 18)))]
    with pytest.raises(ValueError):
        packing.split_point(n, S, 2, 2)


def batch_budget(files, max_tokens, workers, batch):
    """files[f] = sizes; returns the kept (file, row, n) in merged order."""
    cap, out = int(max_tokens * 1.2 / workers) if max_tokens else 0, []
    for w in range(workers):
        seen, done = 0, False
        for f in range(w, len(files), workers):
            for b in range(0, len(files[f]), batch):
                part = files[f][b:b + batch]
                out += [(f, b + i, n) for i, n in enumerate(part)]
                seen += sum(part)
                if cap and seen >= cap:
                    done = True
                    break
            if done:
                break
    kept, at = [], 0
    for f, r, n in out:
        take = min(n, max_tokens - at) if max_tokens else n
        if take > 0:
            kept.append((f, r, at, take))
        at += n
    return kept


@pytest.mark.parametrize("max_tokens", [0, 1, 10, 33, 60, 100, 10_000])
def test_budget_by_worker(spark, max_tokens):
    files = [[3, 4, 5, 6], [9, 1], [2] * 7, [20], [1, 1, 1]]
    rows = [(f, r, f % 2, list(range(n))) for f, sizes in enumerate(files) for r, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "file_rank int, row long, worker int, ids array<int>")
    got = budget.cap_by_worker(df, max_tokens, 2, batch_rows=2).orderBy("start").collect()
    assert [(r.file_rank, r.row, r.start, len(r.ids)) for r in got] == batch_budget(files, max_tokens, 2, 2)


def test_waves_encode_little_more_than_the_budget(spark, tmp_path):
    rng = random.Random(5)
    sizes = [140, 1, 460, 33, 0, 510]
    seen = spark.sparkContext.accumulator(0)
    for k, n in enumerate(sizes):
        part = spark.createDataFrame([(f"{k}:{i}", rng.randint(0, 30)) for i in range(n)], "name string, n int").coalesce(1)
        part.write.parquet(f"{tmp_path}/f{k:02d}")
    files = None
    for k in range(len(sizes)):
        rows = spark.read.parquet(f"{tmp_path}/f{k:02d}").select("name", "n", F.col("_metadata.row_index").alias("row"), F.lit(k).alias("file_rank"))
        files = rows if files is None else files.unionByName(rows)
    files = files.withColumns({"worker": F.pmod("file_rank", F.lit(3)).cast("int"), "file_path": F.format_string("f%02d", "file_rank")})

    def encode(part):
        @F.udf("array<int>")
        def ids(n):
            seen.add(1)
            return list(range(n))

        return part.select("worker", "file_rank", "row", "name", ids("n").alias("ids"))

    whole = [tuple(r) for r in encode(files).collect()]
    total = sum(len(r[-1]) for r in whole)
    for cap in (total // 100, total // 2, 0):
        seen.value = 0
        coded = budget.encode_in_waves(files, encode, cap, 3, batch_rows=5)
        encoded = seen.value
        assert encoded == coded.count()
        got = budget.cap_by_worker(coded, cap, 3, batch_rows=5).select("name", "start", "ids").orderBy("start", "name").collect()
        want = budget.cap_by_worker(spark.createDataFrame(whole, coded.schema), cap, 3, batch_rows=5).select("name", "start", "ids").orderBy("start", "name").collect()
        assert got == want
        if cap == total // 100:
            assert encoded <= 0.05 * len(whole)
    assert budget.encode_in_waves(files.where("false"), encode, 10, 3).count() == 0


@pytest.mark.parametrize("cap,kept", [(0, 6), (1, 2), (7, 2), (8, 4), (21, 6), (99, 6)])
def test_budget_by_stream(spark, cap, kept):
    df = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate([3, 4, 5, 6, 1, 2])], "row long, ids array<int>")
    assert sorted(r.row for r in budget.cap_by_stream(df, cap, batch_rows=2).collect()) == list(range(kept))


def test_shuffle_is_a_seeded_permutation(spark):
    orders = {}
    for n in (1, 2, 3, 5, 16, 17, 97, 100, 1_030):
        grid = batching.window_grid(spark, 3, n)
        for seed in (0, 1):
            placed = batching.seeded_shuffle(grid, n, seed)
            assert "Exchange" not in placed._jdf.queryExecution().toString()
            back = batching.window_at(placed.select("shard", "place", F.col("window").alias("was")), n, seed)
            rows = back.orderBy("shard", "place").collect()
            assert all(r.window == r.was for r in rows)
            for shard in range(3):
                orders[n, seed, shard] = [r.window for r in rows if r.shard == shard]
                assert [r.place for r in rows if r.shard == shard] == list(range(n)) and sorted(orders[n, seed, shard]) == list(range(n))
    assert orders[100, 1, 0] == orders[100, 0, 1] != orders[100, 0, 0]
    moved = [abs(w - p) for p, w in enumerate(orders[1_030, 0, 0])]
    assert 250 < sum(moved) / 1_030 < 440  # a third of n for random orders
    together = sum(abs(a - b) == 1 for a, b in zip(orders[1_030, 0, 0], orders[1_030, 0, 0][1:]))
    assert together < 15


def test_shuffle_by_hand(spark):
    """The permutation of ten windows, worked out step by step."""
    a, b, n, seed = 4, 3, 10, 7
    shift = lambda k, fixed: int(hashlib.md5(f"{seed}:{k}:{fixed}".encode()).hexdigest()[:13], 16)
    assert batching._sides(n) == (a, b)
    out = []
    for x in range(n):
        while True:
            left, right = divmod(x, b)
            for k in range(batching.ROUNDS):
                if k % 2:
                    right = (right + shift(k, left)) % b
                else:
                    left = (left + shift(k, right)) % a
            x = left * b + right
            if x < n:
                break
        out.append(x)
    got = spark.range(n).select(batching.permuted(F.col("id"), F.lit(seed), n)).orderBy("id").collect()
    assert [r[0] for r in got] == out and sorted(out) == list(range(n))


def test_uneven_workers_take_turns(spark):
    given = {0: 5, 1: 0, 2: 2, 3: 9}
    rows = [(w, i, i) for w, n in given.items() for i in range(n)]
    df = batching.batches(spark.createDataFrame(rows, "shard int, window long, place long"), 2, 4)
    turns = []
    left = {w: -(-n // 2) for w, n in given.items()}
    for b in range(5):
        turns += [(w, b) for w in given if b < left[w]]
    got = {r.feed: (r.worker, r.batch) for r in df.collect()}
    assert [got[i] for i in range(len(turns))] == turns
    assert batching.take_batches(df, 2).select("feed").distinct().count() == 2
    steps = batching.epoch_schedule(spark, df, steps=7, grad_accum=3, world=1).orderBy("step", "micro").collect()
    assert [(r.worker, r.batch) for r in steps] == [turns[i % len(turns)] for i in range(21)]
    assert [r.epoch for r in steps] == [i // len(turns) for i in range(21)]


def test_budget_report_scales_steps(spark):
    one = spark.createDataFrame([(1_000,)], "tokens long")
    r = batching.budget_report(one, 8, 2, 4, 64, 3).first()
    assert (r.step_tokens, r.steps, r.training_tokens) == (4_096, 1, 4_096)


def test_windows_stay_small_for_hashed_keys(spark, monkeypatch):
    seen = []
    inner = positions._accumulate

    def counted(totals, by, names, levels):
        if levels <= 1:
            seen.append(totals.count())
        else:
            up = F.shiftright(positions.BUCKET, positions.FANOUT_BITS)
            seen.append(totals.groupBy(*by, up.alias("u")).count().agg(F.max("count")).first()[0])
        return inner(totals, by, names, levels)

    monkeypatch.setattr(positions, "_accumulate", counted)
    monkeypatch.setattr(positions, "WINDOW_BITS", 8)
    n = 70_000
    rows = spark.range(n).select(F.xxhash64("id").alias("key"))
    got = positions.row_ranks(rows, bucket=positions.id_bucket("key"), order=["key"])
    assert len(seen) == 4 and max(seen) <= 1 << positions.FANOUT_BITS and seen[-1] <= 256
    seen.clear()
    dense = positions.row_ranks(spark.range(n), bucket=positions.id_bucket("id"), order=["id"])
    assert len(seen) == 1 and dense.where("rank <> id").isEmpty()
    w = Window.orderBy("key")
    wrong = got.withColumn("want", F.row_number().over(w) - 1).where("rank <> want").count()
    assert wrong == 0 and got.count() == n
