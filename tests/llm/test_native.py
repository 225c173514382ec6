"""Mixing, quality rules and secret scans against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, WORD, edge_texts, frame, prose, rows

from corpusloom.llm import mixing, quality, queries, secret_scan


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality_counts_and_edges(spark):
    extra = [(20, "same line\nsame line\n \nother # line\nsame line " + prose(4, 60)), (21, "a b c a b c a b c d"), (22, "#*$%&|<> " * 60)]
    texts = edge_texts() + extra
    got = quality.quality_rules(frame(spark, texts)).collect()
    want = Counter((i, *base_counts(t)) for i, t in texts)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed)  # too few documents to estimate from
    assert quality.quality_rules(frame(spark, [])).count() == 0


def mcd(x, floors, support, steps):
    """The same concentration steps in plain numpy."""
    m = np.median(x, axis=0)
    s = 1.4826 * np.median(np.abs(x - m), axis=0)
    cov = np.diag(s**2 + floors**2)
    for _ in range(steps):
        d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
        near = x[d2 <= np.sort(d2)[math.ceil(support * len(x)) - 1]]
        m, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floors**2)
    d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    return d2 / max(np.sort(d2)[math.ceil(0.5 * len(x)) - 1] / quality.CHI2_MEDIAN, 0.25)


def test_outliers_go_and_clean_documents_stay(spark):
    texts = [(i, prose(i, 80 + i % 90)) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in prose(i, 100).split())) for i in range(10)]
    got = {r.doc_id: r for r in quality.quality_rules(frame(spark, texts + junk)).collect()}
    assert all(got[i].kept for i, _ in texts)
    assert not any(got[i].kept for i, _ in junk)
    measured = quality.measured(frame(spark, texts + junk)).toPandas()
    d2 = mcd(measured[list(quality.FEATURES)].to_numpy(), np.array(quality.FLOORS), quality.SUPPORT, quality.STEPS)
    for i, want in zip(measured["doc_id"], d2):
        assert got[i].distance2 == pytest.approx(want, rel=0.2, abs=0.2)


ASSIGN = re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


HEXES = [hashlib.sha256(bytes([i])).hexdigest() for i in range(40)]


def test_secret_spans(spark):
    texts = edge_texts() + [
        (30, f"\U0001f600 token = \"{HEXES[0]}\" and {HEXES[1]}"), (31, "AKIA" + "A1" * 8 + " AKIAB AKIA" + "Z" * 13),
        (32, "password: short secret=also-short token=token=abcdefghijkl"), (33, "deadbeef" * 4 + "g" + "0" * 15 + " API_KEY = 'aaaaaaaaaaaa' apikey:abcdefghijklm"),
        (34, "PASSWD=\"" + "a" * 40), (35, ""), (36, "key" + HEXES[2] + "AKIA" + "Q" * 20 + "token:" + HEXES[3]),
    ]
    got = secret_scan.secret_spans(frame(spark, texts)).collect()
    want = Counter((i, tuple(base_spans(t))) for i, t in texts)
    assert Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in got) == want
    for r in got:
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert secret_scan.secret_spans(frame(spark, [])).count() == 0


def test_randomness_tells_strings_apart(spark):
    rng = np.random.default_rng(7)
    letters = np.array(list(secret_scan.ALPHABETS["base64"]))
    random_tokens = ["A1" + "".join(rng.choice(letters, 38)) for _ in range(200)]
    structured = [f"aaaa{i % 10}aaaaaaaaaabbbbbbbbbbbbbbbbZZZZZZZZ" for i in range(200)]
    got = secret_scan.secret_spans(frame(spark, list(enumerate(random_tokens + structured)))).collect()
    hits = {r.doc_id: [s.kind for s in r.spans] for r in got}
    assert sum(hits[i] == [3] for i in range(200)) >= 190
    assert sum(3 in hits[i] for i in range(200, 400)) == 0


def test_redaction(spark):
    texts = [(1, f"start token = {HEXES[0]} end"), (2, None), (3, "nothing"), (4, HEXES[1]), (4, HEXES[1]), (None, HEXES[2] + " x")]
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in secret_scan.without_secrets(frame(spark, texts)).collect() if r.text is not None)
    assert [(i, t) for i, t, _ in got] == [(0, "[SECRET] x"), (1, "start [SECRET] end"), (3, "nothing"), (4, "[SECRET]"), (4, "[SECRET]")]
    assert all(n == len(t) for _, t, n in got)


def plain_targets(sizes, weights=(3, 1, 2)):
    """Excess is dealt out again by weight until no target is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        level = {s: 2.0 * sizes[s] if s in full else weight[s] * rest / total for s in order}
        over = {s for s in order if s not in full and level[s] > 2 * sizes[s]}
        if not over:
            return level
        full |= over


def test_mixing(spark):
    texts = []
    for s, n, w in (("a", 30, 10), ("b", 5, 3), ("é", 60, 40), (None, 20, 7), ("c", 3, 0), ("B", 40, 25)):
        texts += [(100 * len(texts) + i, " ".join(["w"] * w), s) for i in range(n)]
    table = spark.createDataFrame([r[0] for r in (rows([(i, t)], source=s) for i, t, s in texts)], SCHEMA)
    taken = mixing.with_copies(mixing.measure(table)).collect()
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += len(t.split())
    want = plain_targets(dict(sizes))
    for r in taken:
        source = r["source"]
        assert r["__source_size"] == sizes[source] and r["__target"] == pytest.approx(want[source])
        assert 0 <= r["__copies"] <= 2
    again = mixing.with_copies(mixing.measure(table.repartition(3))).collect()
    key = lambda rs: sorted((r["doc_id"], r["__copies"]) for r in rs)
    assert key(taken) == key(again)
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r["__copies"] for r in taken)
    assert mixing.with_copies(mixing.measure(frame(spark, []))).count() == 0
    assert mixing.with_copies(mixing.measure(frame(spark, edge_texts()))).count() == len(edge_texts())


def test_registered_without_limits():
    assert set(queries.QUERIES) == {
        "op1_mtree_search", "op2_license_scan", "op3_binary_records", "op4_secret_randomness", "op5_minhash_bbit", "op6_suffix_dedup",
        "op7_template_extraction", "op8_robust_quality", "op9_bpe_rank_array", "op10_source_mixing",
    }
