"""Training-log, routing, scoring and recurrence operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.schedule import cosine_lr
from corpusloom.operators import recurrence, routing, scoring, training_log


def test_intervals_and_resume(spark):
    rows = [(s, float(s)) for s in range(7, 23)]
    got = training_log.interval_loss(spark.createDataFrame(rows, "step long, loss double"), 5).orderBy("step").collect()
    assert [(r.step, r.loss) for r in got] == [(10, (7 + 8 + 9) / 5), (15, 12.0), (20, 17.0)]


def test_throughput_counts_steps_before_a_resume(spark):
    log = spark.createDataFrame([(s, 100 + s) for s in range(10, 20)], "step long, t long").select("step", F.timestamp_seconds("t").alias("ts"))
    r = training_log.throughput(log, 8, 10, start_step=10).first()
    assert (r.step, r.tokens_seen, r.tok_per_sec) == (20, 160, pytest.approx(160 / 9))


def test_latency_across_bucket_borders(spark):
    base = (1 << 16) - 3
    log = spark.createDataFrame([(base + i, i * i) for i in range(6)], "step long, t long").select("step", F.timestamp_seconds("t").alias("ts"))
    got = training_log.step_latency(log).orderBy("step").collect()
    assert [r.step_ms for r in got] == [None, 1_000.0, 3_000.0, 5_000.0, 7_000.0, 9_000.0]


def test_learning_rate(spark):
    def rate(s):
        if s < 10:
            return 1.0 * (s + 1) / 10
        if s >= 50:
            return 0.1
        return 0.1 + 0.5 * 0.9 * (1 + math.cos(math.pi * (s - 10) / 40))

    got = spark.range(70).select("id", cosine_lr(F.col("id"), 1.0, 0.1, 10, 50).alias("lr")).orderBy("id").collect()
    assert [r.lr for r in got] == pytest.approx([rate(s) for s in range(70)])
    assert spark.range(1).select(cosine_lr(F.col("id"), 1.0, 0.1, 0, 50)).first()[0] == pytest.approx(1.0)


def test_eval_mean_is_zero_without_batches(spark):
    losses = spark.createDataFrame([(1, 2.0), (1, 4.0)], "step long, loss double")
    got = training_log.eval_mean(losses, spark.range(1, 3).withColumnRenamed("id", "step")).orderBy("step").collect()
    assert [r.eval_loss for r in got] == [3.0, 0.0]


def test_load_fills_zeros_and_skips_idle_layers(spark):
    df = spark.createDataFrame([(0, "a")] * 3 + [(0, "b")], "layer int, expert string")
    got = routing.expert_load(df, 2, ["a", "b", "c"]).orderBy("expert").collect()
    shares = np.array([0.75, 0.25, 0.0])
    assert [r.n for r in got] == [3, 1, 0]
    assert got[0].utilization_std == pytest.approx(shares.std(ddof=1)) and got[0].max_load_ratio == pytest.approx(3 / (4 / 3))


def test_bias_follows_the_load(spark):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, size=(30, 3))
    rows = [(s, 0, "abc"[e], int(n)) for s, row in enumerate(counts) for e, n in enumerate(row) if n]
    got = routing.load_bias(spark.createDataFrame(rows, "step long, layer int, expert string, n long"), 1, list("abc"), 0.01)
    bias = np.zeros(3)
    want = {}
    for s, row in enumerate(counts):
        if not row.sum():
            continue  # nothing routed, nothing moves
        bias = bias - 0.01 * np.sign(row - row.sum() / 3)
        want.update({(s, "abc"[e]): bias[e] for e in range(3)})
    assert {(r.step, r.expert): r.bias for r in got.collect()} == pytest.approx(want)


def test_routing_bias_steers_but_does_not_weigh(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<float>")
    gate = np.eye(2).repeat(2, axis=0)[:3]  # groups 0 and 1 tie, group 2 is the other axis
    plain = routing.topk_routing(vecs, [0, 1, 2], gate, [0.0, 0.0, 0.0], 2).orderBy("vec_id", "place").collect()
    assert [(r.vec_id, r.grp) for r in plain] == [(0, 0), (0, 1), (1, 2), (1, 0)]
    assert [r.weight for r in plain][:2] == pytest.approx([0.5, 0.5])
    pushed = routing.topk_routing(vecs, [0, 1, 2], gate, [0.0, 0.0, 9.0], 2).where("vec_id = 0").orderBy("place").collect()
    s = 1 / math.sqrt(0.5 + 1e-6)
    assert [r.grp for r in pushed] == [2, 0] and pushed[0].weight == pytest.approx(1 / (1 + math.exp(s)))


def test_groups_are_scored_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    gate, bias = rng.normal(size=(23, 4)), [0.1 * (g % 3) for g in range(23)]
    gate[7] = gate[3]
    vecs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "vec_id int, embedding array<double>").coalesce(1)
    rows = lambda: sorted(map(tuple, routing.topk_routing(vecs, list(range(23)), gate, bias, 3).collect()))
    whole = rows()
    monkeypatch.setattr(routing, "BLOCK_CELLS", 40)
    assert [r[:3] for r in rows()] == [r[:3] for r in whole] and np.allclose([r[3] for r in rows()], [r[3] for r in whole])


def test_sampling_keeps_ties_and_weakens_seen(spark):
    scores = spark.createDataFrame([("u", i, s) for i, s in zip("abcde", (5.0, 4.0, 4.0, 1.0, -2.0))], "u string, i string, score double")
    seen = spark.createDataFrame([("u", "a"), ("u", "e")], "u string, i string")
    got = {r.i: (r.logit, r.p) for r in scoring.next_distribution(scores, seen, "u", "i", top_k=2, temperature=0.5, penalty=2.0).collect()}
    assert {k: v[0] for k, v in got.items()} == {"b": 8.0, "c": 8.0} and sum(v[1] for v in got.values()) == pytest.approx(1)
    full = {r.i: r.logit for r in scoring.next_distribution(scores, seen, "u", "i", top_k=0, temperature=1.0, penalty=2.0).collect()}
    assert full == {"a": 2.5, "b": 4.0, "c": 4.0, "d": 1.0, "e": -4.0}


def test_draws_follow_the_distribution(spark):
    d = spark.range(20_000).select(F.col("id").alias("u"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in (("a", 0.7), ("b", 0.3))])).alias("x")).select("u", "x.*")
    shares = {r.i: r["count"] / 20_000 for r in scoring.draw(d, "u", "i", 3).groupBy("i").count().collect()}
    assert shares["a"] == pytest.approx(0.7, abs=0.02)
    assert scoring.draw(d, "u", "i", 3).exceptAll(scoring.draw(d.repartition(5), "u", "i", 3)).count() == 0


def test_cross_entropy_ignores_marked_targets(spark):
    train = spark.createDataFrame([([1, 2], [2, 1])], "x array<int>, y array<int>")
    held = spark.createDataFrame([([1, 1, 2], [2, -1, 2])], "x array<int>, y array<int>")
    r = scoring.heldout_ce(train, held, 3).first()
    assert (r.targets, r.loss) == (2, pytest.approx(-(math.log(2 / 4) + math.log(1 / 4)) / 2))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_decayed_state_with_a_hot_key(spark, parts):
    rng = np.random.default_rng(1)
    users = np.where(rng.random(3_000) < 0.6, 7, rng.integers(0, 40, 3_000))
    z, u = rng.normal(size=3_000), rng.normal(size=3_000)
    rows = [(int(k), i, float(a), float(b), 2.0) for i, (k, a, b) in enumerate(zip(users, z, u))]
    df = spark.createDataFrame(rows, "user long, t long, z double, u double, q double").withColumn("log_a", recurrence.log_decay(F.col("z")))
    h, want = {}, {}
    for k, t, a, b, _ in rows:
        h[k] = h.get(k, 0.0) * math.exp(-math.log1p(math.exp(a))) + b
        want[t] = h[k]
    got = recurrence.decayed_state(df, "user", ["t"], partitions=parts).collect()
    assert {r.t: r.h for r in got} == pytest.approx(want)
    assert all(r.readout == 2 * r.h for r in got)


def test_a_gate_in_blocks_equals_the_whole_gate(spark):
    rng = np.random.default_rng(7)
    gate, bias = rng.normal(size=(60, 4)), [0.1 * (g % 3) for g in range(60)]
    gate[40] = gate[3]
    gate[41] = gate[3]
    rows = [(i, "x", rng.normal(size=4).tolist()) for i in range(300)] + [(900, "x", [0.0] * 4)]
    vecs = spark.createDataFrame(rows, "vec_id long, grp string, embedding array<float>")
    table = spark.createDataFrame([(g, gate[g].tolist(), bias[g]) for g in range(60)], "grp int, centroid array<double>, bias double")
    want = routing.topk_routing(vecs.drop("grp"), list(range(60)), gate, bias, 3).orderBy("vec_id", "place").collect()
    for block in (7, 1 << 15):
        got = routing.topk_routing_blocks(vecs.drop("grp"), table, 3, block_groups=block).orderBy("vec_id", "place").collect()
        assert [(r.vec_id, r.place, r.grp) for r in got] == [(r.vec_id, r.place, r.grp) for r in want]
        assert np.allclose([r.weight for r in got], [r.weight for r in want])
    assert routing.topk_routing_blocks(vecs.drop("grp"), table.where("false")).count() == 0
