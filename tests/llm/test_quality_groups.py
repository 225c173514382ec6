"""Small sources and rare languages are judged, and milder outliers go."""

import numpy as np
from helpers import SCHEMA, prose, rows
from pyspark.sql import functions as F

from corpusloom.llm import quality


def judged(spark, table):
    return {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(table, SCHEMA)).collect()}


def marked(seed, mark="$$$"):
    return " ".join(w + mark for w in prose(seed, 100).split())


def test_small_sources_and_languages_are_judged(spark):
    table = rows([(i, prose(i, 80 + i % 90)) for i in range(100)], source="big")
    table += rows([(200, prose(200, 100)), (201, marked(201))], source="few")
    table += rows([(300 + i, prose(300 + i, 90 + i)) for i in range(5)] + [(310, marked(310))], lang="fi", source="x")
    table += rows([(400, prose(400, 100)), (401, marked(401))], lang=None, source=None)
    got = judged(spark, table)
    assert all(r.distance2 is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {201, 310, 401}


def test_a_small_table_is_judged(spark):
    got = judged(spark, rows([(i, prose(i, 80 + 2 * i)) for i in range(30)] + [(99, marked(99))]))
    assert {i for i, r in got.items() if not r.kept} == {99}


def test_cutoff_follows_the_distances(spark):
    texts = [(i, prose(i, 80 + i % 90)) for i in range(200)]
    mild = [(900 + i, " ".join(w + "$" * (k % 9 == 0) for k, w in enumerate(prose(i, 120).split()))) for i in range(5)]
    got = judged(spark, rows(texts + mild))
    assert all(50 < got[i].distance2 < 400 for i, _ in mild)
    assert {i for i, r in got.items() if not r.kept} == {i for i, _ in mild}


def plain_determinant(x, floors, support, starts, seed):
    """Smallest determinant of a covariance over ``support`` of the rows, from many random starts."""
    rng, best = np.random.default_rng(seed), np.inf
    keep = int(np.ceil(support * len(x)))
    for _ in range(starts):
        near = x[rng.choice(len(x), 6, replace=False)]
        last = np.inf
        while True:
            centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(np.square(floors))
            det = np.linalg.det(cov)
            if len(near) == keep:  # the few rows of a start are no candidate themselves
                if det >= last * (1 - 1e-9):
                    break
                last = det
            off = x - centre
            near = x[np.argsort((off @ np.linalg.inv(cov) * off).sum(axis=1), kind="stable")[:keep]]
        best = min(best, last)
    return best


def test_estimates_reach_the_minimum_determinant(spark):
    rng = np.random.default_rng(3)
    cloud = rng.multivariate_normal([5, 1.6, 0, 0.1, 0.2], np.diag([1, 0.01, 0.02, 0.005, 0.01]) + 0.004, 800)
    far = rng.multivariate_normal([9, 3.0, 2, 0.9, 0.8], np.diag([0.1] * 5), 180)
    x = np.concatenate([cloud, far])
    members = spark.createDataFrame([("c", *map(float, r)) for r in x], ["_cell", *quality.FEATURES])
    fit = quality._estimate(members).first()
    want = plain_determinant(x, quality.FLOORS, quality.SUPPORT, 40, 5)
    assert fit.det < 1.03 * want
    w = np.zeros((5, 5))
    for k, (i, j) in enumerate(quality.PLACES):
        w[i, j] = fit.w[k]
    d2 = (((x - np.array(fit.m)) @ w.T) ** 2).sum(axis=1)
    assert abs(np.linalg.det(w) ** -2 / fit.det - 1) < 1e-9
    # The cutoff is the fence of these distances, and only the far cloud lies beyond it.
    q = np.quantile(d2, [0.5, 0.75])
    scale = max(q[0] / quality.CHI2_MEDIAN, 1)
    spread = max(q[1] / (scale * quality.CHI2_MEDIAN), quality.CHI2_SPREAD)
    fence = quality.CHI2_MEDIAN * ((1 + quality.FENCE) * np.sqrt(spread) - quality.FENCE) ** 2
    assert abs(fit.scale / scale - 1) < 0.05 and abs(fit.cutoff / fence - 1) < 0.3
    assert ((d2 / fit.scale > fit.cutoff) == (np.arange(len(x)) >= 800)).all()


def test_triangles(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    cov = a @ a.T + np.eye(5)
    flat = [float(cov[i, j]) for i, j in quality.PLACES]
    got = spark.createDataFrame([(flat,)], "c array<double>").select(quality._cholesky(F.col("c")).alias("l")).select("l", quality._inverse(F.col("l")).alias("w")).first()
    low = np.linalg.cholesky(cov)
    assert np.allclose(got.l, [low[i, j] for i, j in quality.PLACES]) and np.allclose(got.w, [np.linalg.inv(low)[i, j] for i, j in quality.PLACES])
