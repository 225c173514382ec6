"""Line dedup, vector codes and source divergence against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import edge_texts, frame, prose, rows, SCHEMA

from corpusloom.llm import codebooks, line_dedup, queries, skew, source_divergence

ASCII_SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(ASCII_SPACE).translate(LOWER)


def plain_dedup(texts, least, chars=1):
    found = Counter(k for _, t in texts for k in {key_of(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = Counter()
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < chars or found[key_of(x)] < least]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def lined_texts():
    rng = random.Random(4)
    common = [prose(k, 3) for k in range(12)] + ["É", "x", "naïve  line"]
    texts = list(edge_texts())
    for i in range(120):
        lines = [rng.choice([" ", "", "\t"]) + rng.choice([str, str.upper])(rng.choice(common)) + rng.choice(["\r", "  ", ""]) for _ in range(rng.randint(0, 4))]
        lines += [prose(1000 + i, 4), "in every line", ""] + [" ", "one more"] * (i % 3 == 0)
        rng.shuffle(lines)
        texts.append((100 + i, "\n".join(lines)))
    return texts + [(300, "twice\ntwice")] * 9 + [(None, "in every line\nx"), (None, "twice"), (7, "a second text of an id\nin every line")]


@pytest.mark.parametrize("least, chars, most_bytes", [(10, 1, line_dedup.FILTER_BYTES), (2, 1, line_dedup.FILTER_BYTES), (10, 1, 0), (3, 2, 0)])
def test_repeated_lines(spark, monkeypatch, least, chars, most_bytes):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    monkeypatch.setattr(line_dedup, "SHARD_BITS", 1024)
    monkeypatch.setattr(skew, "HOT_KEYS", 4)
    texts = lined_texts()
    cleaned = line_dedup.without_repeated_lines(frame(spark, texts), least_documents=least, least_chars=chars, filter_bytes=most_bytes)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in cleaned.collect()) == plain_dedup(texts, least, chars)


def test_first_lines_can_stay(spark):
    texts = [(3, "b\nA"), (1, "x\na\na"), (2, " a "), (None, "lone"), (4, None)]
    got = line_dedup.without_repeated_lines(frame(spark, texts), least_documents=2, keep_first=True).collect()
    assert {r.doc_id: r.kept for r in got} == {3: "b", 1: "x\na", 2: "", None: "lone", 4: ""}
    assert line_dedup.without_repeated_lines(frame(spark, [])).count() == 0


def test_filters_miss_no_repeat_and_suspect_few():
    rng = np.random.default_rng(1)
    once, twice = rng.integers(0, 1 << 63, 40_000, np.uint64) * np.uint64(2), rng.integers(0, 1 << 63, 2_000, np.uint64) * np.uint64(2) + np.uint64(1)
    shard = line_dedup.ShardFilter(0)
    stream = np.concatenate([once, twice, twice])
    rng.shuffle(stream)
    for part in np.array_split(stream, 30):
        values, n = np.unique(part, return_counts=True)
        shard.add(values, n)
    bits = shard.folded()
    probe = line_dedup.Probe([{"shard": 0, "bits": bits}], 0)
    assert probe(twice).all() and probe(once).mean() < 0.02
    assert len(bits) < line_dedup.SHARD_BITS // 8 // 16


def test_line_query_by_hand(spark, monkeypatch):
    texts = [(i, f"Menu\nbody {i}") for i in range(10)] + [(50, None)]
    table = frame(spark, texts)
    monkeypatch.setattr(queries, "documents", lambda s, d: table)
    got = {r.doc_id: r for r in queries.op13_line_dedup(spark, "").collect()}
    assert (got[4].n_lines, got[4].n_dropped, got[4].kept_sha256) == (2, 1, hashlib.sha256(b"body 4").hexdigest())
    assert (got[50].n_lines, got[50].n_dropped, got[50].kept_sha256) == (1, 0, hashlib.sha256(b"").hexdigest())


def plain_codes(vectors, parts, entries, rounds):
    """Integers of Python, one distance after the other."""
    length = -(-max(map(len, vectors), default=0) // parts) * parts
    q = [list(v) + [0] * (length - len(v)) for v in vectors]
    width = length // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for v in q[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((gap(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in q:
            for p in range(parts):
                groups[p, best(v, p)[1]].append(cut(v, p))
        for (p, k), members in groups.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = [[best(v, p) for p in range(parts)] for v in q]
    return [bytes(k for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("dims, entries", [(12, 8), (4, 3), (20, 256)])
def test_codes(spark, dims, entries):
    rng = np.random.default_rng(dims)
    data = [(i, rng.normal(size=dims).round(1).tolist(), int(rng.integers(0, 3)), "x", "y") for i in range(90)]
    data += [(200 + i, [0.5] * dims, None, "x", "y") for i in range(20)] + [(5, [0.25] * dims, 1, "x", "y"), (None, [-1.5] * dims, 2, "x", "y"), data[7]]
    data += [(300, None, 1, "", ""), (301, [1.0] * (dims - 1) + [None], 1, "", ""), (302, [float("nan")] * dims, 1, "", ""), (303, [float("-inf")] * dims, 1, "", "")]
    data += [(400, [0.125] * (dims - 3), 1, "", "")]  # a shorter vector: zeros follow
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, code string, error string")
    sound = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v], lab) for i, v, lab, *_ in data if v is not None and None not in v and np.isfinite(v).all()]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, errors, books = plain_codes([v for _, v, _ in sound], 4, entries, 3)
    fitted = codebooks.fit_codes(table, entries=entries, rounds=3)
    assert fitted.codebooks == books
    by_label = Counter()
    for (_, _, lab), e in zip(sound, errors):
        by_label[lab] += e
    got = codebooks.with_label_errors(fitted.rows).collect()
    assert Counter((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in got) == Counter(
        (i, lab, c, e, by_label[lab]) for (i, _, lab), c, e in zip(sound, codes, errors)
    )


def test_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for data in ([], [(1, None, 1)]):
        fitted = codebooks.fit_codes(spark.createDataFrame(data, schema))
        assert codebooks.with_label_errors(fitted.rows).count() == 0 and codebooks.codebooks_text(fitted.codebooks) == ""
    lone = codebooks.fit_codes(spark.createDataFrame([(1, [], None), (2, [], 3)], schema)).rows.collect()
    assert {(r.vec_id, bytes(r.code), r.error) for r in lone} == {(1, bytes(4), 0), (2, bytes(4), 0)}
    with pytest.raises(ValueError):
        codebooks.fit_codes(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1)], schema))


def test_transform_keeps_distances_and_ends_early():
    rng = np.random.default_rng(3)
    for length in (1, 2, 5, 16, 24, 100):
        a, b = rng.integers(-9000, 9000, (2, 40, length))
        ta, tb = codebooks.transform(a), codebooks.transform(b)
        assert ((ta - tb) ** 2).sum(axis=1).tolist() == (ta.shape[1] * ((a - b) ** 2).sum(axis=1)).tolist()
    order = codebooks.sequency_order(16)
    signs = np.array([[1 - 2 * (bin(i & j).count("1") & 1) for j in range(16)] for i in order])
    assert [(r[1:] != r[:-1]).sum() for r in signs] == list(range(16))
    # Smooth vectors have their energy in the first coefficients.
    walk = np.cumsum(np.cumsum(rng.integers(-50, 50, (500, 16)), axis=1), axis=1)
    stats = {}
    best, error = codebooks.nearest(codebooks.transform(walk), codebooks.transform(walk[:64]), stats)
    gaps = ((walk[:, None] - walk[None, :64]) ** 2).sum(axis=2)
    assert (best == gaps.argmin(axis=1)).all() and (error == gaps.min(axis=1)).all()
    assert stats["terms"] < 0.5 * 500 * 64 * 16


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(docs, least, top):
    docs = [(t or "", lang or "", source or "") for t, lang, source in docs]
    counts, seen, found = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for t, lang, source in docs:
        words = [w.translate(LOWER) for w in TERM.findall(t)]
        seen[lang].add(source)
        counts[lang, source].update(words)
        found[lang].update(set(words))
    out = set()
    for lang, sources in seen.items():
        kept = [t for t, n in found[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = sum(total.values())
        share = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + len(kept))
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), whole) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pair), ("term", term)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked) if part == "pair" or k < top}
    return out


@pytest.mark.parametrize("block_terms, block_groups, columns", [(source_divergence.BLOCK_TERMS, source_divergence.BLOCK_GROUPS, 1024), (5, 3, 4)])
def test_divergence(spark, monkeypatch, block_terms, block_groups, columns):
    monkeypatch.setattr(source_divergence, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(source_divergence, "BLOCK_GROUPS", block_groups)
    monkeypatch.setattr(source_divergence, "PRODUCT_COLUMNS", columns)
    monkeypatch.setattr(source_divergence, "TASK_ENTRIES", 20)
    rng = random.Random(8)
    names = ["the", "The", "of", "and", "é", "É", "日本", "w x"] + [prose(k, 1) for k in range(40)]
    table = []
    for i in range(150):
        lang, source = rng.choice([("en", f"s{min(int(rng.expovariate(0.5)), 6)}"), ("fi", rng.choice("ab")), ("en", None), (None, "s1")])
        words = [rng.choice(names[:1 + int(rng.expovariate(0.1)) % len(names)]) for _ in range(rng.randint(0, 40))]
        table += rows([(i, rng.choice([" ", "-", "1", "\x7f"]).join(words))], lang, source)
    table += rows([(900, None), (901, "")], "en", "silent") + rows([(902, "x 1 y")], "alone", "z") + rows([(903, "a"), (903, "a"), (None, "a")], "rep", "u") + rows([(904, None)], "rep", "v")
    got = source_divergence.divergence(spark.createDataFrame(table, SCHEMA), top_terms=9)
    want = plain_divergence([(r[1], r[2], r[3]) for r in table], 3, 9)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert source_divergence.divergence(frame(spark, [])).count() == 0


def test_shares_are_exact_at_any_size(spark):
    big = spark.range(1).selectExpr("9000000000000000000L AS n", "9000000000000000001L AS total", "77L AS kinds")
    got = big.select(source_divergence.share(*[big[c] for c in ("n", "total", "kinds")])).first()[0]
    assert got == 1 + 10**9 * (9 * 10**18 + 1) // (9 * 10**18 + 78)
