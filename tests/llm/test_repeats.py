"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import WORD, edge_texts, frame, prose
from pyspark.sql import functions as F

from corpusloom.llm import graph, neardup, queries, shingles, suffixes
from corpusloom.llm.text import row_key


def sets_of(text):
    w = [x.encode().lower() for x in WORD.findall(text or "")]  # bytes: only ASCII letters change
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    """Smallest id by text and id; rows with an id are nodes of their own."""
    named = [(i, t, sets_of(t)) for i, t in sorted({(i, t or "") for i, t in texts if i is not None})]
    parent = list(range(len(named)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, _, a) in enumerate(named):
        for j, (_, _, b) in enumerate(named[:k]):
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                lo, hi = sorted((find(k), find(j)))
                parent[hi] = lo
    return {(i, t): named[find(k)][0] for k, (i, t, _) in enumerate(named)}


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    """A group of copies at all distances from their origin, exact ones, a chain, and others."""
    rng = random.Random(9)
    base, texts = prose(50, 150).split(), []
    texts += [(1000 + k, edited(base, rng, rng.randint(0, 9))) for k in range(140)]
    texts += [(3000 + k, prose(60, 90)) for k in range(30)]
    chain = prose(70, 120).split()
    for k in range(12):
        texts.append((5000 + k, " ".join(chain)))
        chain = edited(chain, rng, 2).split()
    return texts + [(7000 + k, prose(100 + k, 60)) for k in range(60)] + [(i, t) for i, t in edge_texts() if t is not None]


def found_components(spark, texts):
    docs = frame(spark, texts)
    keyed = docs.select("doc_id", row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    text_at = {(r.doc_id, r["row"]): r.text for r in keyed.collect()}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.n_shingles == len(sets_of(text_at[r.doc_id, r["row"]])) and r.kept == (r.component_id == r.doc_id)
    return {(r.doc_id, text_at[r.doc_id, r["row"]]): r.component_id for r in got if r.doc_id is not None}


def test_near_duplicates(spark, copies):
    assert found_components(spark, copies) == brute_components(copies)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert [r.n_shingles for r in neardup.near_duplicates(frame(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_outsiders_meet_members_in_blocks(spark, copies, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    assert found_components(spark, copies) == brute_components(copies)


def test_rows_of_one_id_have_links_of_their_own(spark):
    rng = random.Random(5)
    a, b, c = (prose(600 + k, 90).split() for k in range(3))
    texts = [(1, " ".join(a)), (1, " ".join(b)), (2, edited(a, rng, 1)), (0, edited(b, rng, 1)), (3, edited(c, rng, 2)), (1, " ".join(c)), (3, " ".join(c))]
    texts += [(None, " ".join(a)), (None, prose(1, 70)), (4, "x y"), (4, "x y"), (4, None)]
    got = found_components(spark, texts)
    assert got == brute_components(texts)
    assert got[2, texts[2][1]] == 1 and got[1, texts[1][1]] == 0 and got[3, texts[4][1]] == 1


def test_estimates_come_near(spark):
    rng = random.Random(2)
    base = prose(8, 300).split()
    texts = [" ".join(base).encode(), *(edited(base, rng, n).encode() for n in (1, 5, 10, 20, 60))]
    sets = shingles.shingle_sets(texts)
    sig = neardup.signatures(neardup.minima(sets)).view(np.int64)
    rows = spark.createDataFrame([(k, sig[0].tolist(), s.tolist()) for k, s in enumerate(sig)], "k int, a array<long>, b array<long>")
    for r in rows.select("k", neardup.estimate(rows.a, rows.b).alias("e")).collect():
        true = len(np.intersect1d(sets[0], sets[r.k])) / len(np.union1d(sets[0], sets[r.k]))
        assert abs(r.e - true) < 0.23


def test_shingles_of_long_texts_do_not_depend_on_slices(monkeypatch):
    texts = [prose(3, 3000).encode(), b"", b" \n", "É é ABC x".encode(), b"y" * 5000]
    whole = shingles.shingle_sets(texts)
    monkeypatch.setattr(shingles, "SLICE_BYTES", 1000)
    for a, b, t in zip(whole, shingles.shingle_sets(texts), texts):
        assert np.array_equal(a, b) and len(a) == len(sets_of(t.decode()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 300), (300, 250)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 300: 200, 250: 200}


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(150):
        text = np.array([rng.randint(1, rng.choice([1, 2, 3, 250])) for _ in range(rng.randint(1, 60))], np.int64)
        assert suffixes.suffix_order(text, 1, 10**9).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def brute_removal(spark, texts):
    """Rows in order of id, then of their row key; rows alike are one document."""
    keyed = frame(spark, texts).select("doc_id", row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = sorted(((-1 << 63) if r.doc_id is None else r.doc_id, r["row"], r.text.encode()) for r in keyed.collect())
    first = {}
    for d, k, t in rows:
        for i in range(len(t) - 99):
            first[t[i:i + 100]] = min(first.get(t[i:i + 100], (d, k, i)), (d, k, i))
    out = Counter()
    for d, k, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 99):
            if first[t[i:i + 100]] < (d, k, i):
                gone[i:i + 100] = True
        runs = int((np.diff(np.concatenate([[False], gone])[:-1].astype(int)) == 1).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[(None if d == -1 << 63 else d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("group, size", [(suffixes.GROUP, suffixes.SCAN_BYTES), (3, 2000)])
def test_repeated_passages(spark, monkeypatch, group, size):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "SCAN_BYTES", size)
    rng = random.Random(11)
    source = prose(40, 200)
    texts = []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 900)
            parts += [source[a:a + rng.randint(50, 400)], "".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40)))]
        texts.append((rng.choice([d, 3 * d + 1000]), "".join(parts)))
    texts += [(None, source[200:900]), (None, prose(41, 60)), (None, source[100:160] + source[700:900]), texts[3], texts[3]]  # ids repeat with other texts
    texts += [(900, "ab" * 400), (901, "a" * 350), (902, source + source), (903, None), (904, ""), (None, source[50:400])]
    documents = frame(spark, texts)
    monkeypatch.setattr(queries, "documents", lambda s, d: documents)
    got = queries.op6_suffix_dedup(spark, "").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removal(spark, texts)


def test_no_documents(spark):
    assert suffixes.without_repeats(frame(spark, [])).count() == 0
    twice = suffixes.without_repeats(frame(spark, [(1, prose(1, 50)), (1, prose(1, 50))])).collect()
    assert [r.spans for r in twice] == [[], []]
