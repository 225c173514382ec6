"""Vector search, license scans, page extraction, and the pipeline."""

import html
import random
import re

import numpy as np
import pytest
from compare import check, connect
from helpers import edge_texts, frame, prose

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import licenses, metric_tree, page_template, queries
from corpusloom.session import cut

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    note, same = check(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert same, note


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_input(spark, name):
    table = "pages" if name.startswith("op7") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def brute_top(vectors, ask, k):
    out = {}
    for q, a in vectors:
        if q in ask:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize("rows, cells", [(metric_tree.SHARD_ROWS, metric_tree.CELLS), (40, 3)])
def test_tree_search(spark, monkeypatch, rows, cells):
    monkeypatch.setattr(metric_tree, "SHARD_ROWS", rows)
    monkeypatch.setattr(metric_tree, "CELLS", cells)
    monkeypatch.setattr(metric_tree, "PAGE", 8)
    monkeypatch.setattr(metric_tree, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    common = [0.5, -0.25, 0.125, 0.0]
    data = [(i, rng.normal(size=4).round(2).tolist(), "x") for i in range(200)] + [(1000 + i, common, "x") for i in range(90)]
    data += [(2000, None, "x"), (2001, [1.0, None, 2.0, 3.0], "x"), (2002, [1.0, float("nan"), 0.0, 0.0], "x"), (2003, [float("inf")] * 4, "x"), (2004, [], "x"), (None, common, "x")]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank string")
    vectors = cut(metric_tree.quantized(table))
    sound = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v, _ in data
             if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    ask = {i for i, _ in sound if i % 50 == 0}
    found: dict[int, list] = {}
    for r in metric_tree.top_k(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == brute_top(sound, ask, 5)
    one = vectors.where("vec_id = 50")
    assert metric_tree.top_k(one, one).count() == 0
    none = vectors.where("false")
    assert metric_tree.top_k(none, none).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (20, 8))
    rows = np.unique(np.concatenate([c + rng.integers(-3, 4, (100, 8)) for c in centres]), axis=0)
    longest = float((rows.astype(float) ** 2).sum(axis=1).max())
    tree = metric_tree.build(rows, [[i] for i in range(len(rows))], longest)
    seen = 0

    class Counted(np.ndarray):
        def __getitem__(self, key):
            nonlocal seen
            seen += np.size(key) if isinstance(key, np.ndarray) else 0
            return np.asarray(super().__getitem__(key))

    tree.vectors = tree.vectors.view(Counted)
    for q in rows[::100]:
        want = sorted((-int(s), i) for i, s in enumerate(rows @ q))[:5]
        assert metric_tree.search(tree, q, 5, longest) == [(-s, i) for s, i in want]
    assert seen < 0.8 * len(rows) * len(rows[::100])


def test_patience_keeps_order():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    words = [f"w{i}" for i in range(30)]
    assert licenses.patience(words, words) == [(i, i) for i in range(30)]


LINES = {
    "Released under the BSD License.": {"BSD-line"}, "Educational Community License, Version 2.0": set(), "Licensed under the Educational Community License, Version 2.0.": {"ECL-2.0-line"},
    "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0-line"}, "This work is licensed under the GNU Lesser General Public License, version 3.": {"LGPL-3.0-line"},
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": {"LGPL-2.1-line"}, "This work is licensed under the GNU General Public License, version 2.0.": {"GPL-2.0-line"},
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0-line"}, "This work is licensed under the GNU Affero General Public License, version 3": {"AGPL-3.0-line"},
    "Licensed under CC BY-ND 4.0.": {"CC-BY-ND-4.0-line"}, "Licensed under CC BY 4.0.": {"CC-BY-4.0-line"}, "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0-line"},
    "Licensed under CC BY-NC-SA 3.0": {"CC-BY-NC-SA-3.0-line"}, "Licensed under CC BY-NC-SA 2.0": set(), "Released under the MIT License.": {"MIT-line"}, "Released under the Foo License.": set(),
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": {"CC-BY-ND-4.0-notice"}, "Licensed under the Apache License, Version 1.1.": set(),
}


def test_lines_name_their_license_and_no_other():
    tools = [licenses.Template(n, t) for n, t in licenses.TEMPLATES.items()]
    for line, want in LINES.items():
        for text in (line, f"{prose(1, 30)}\n{line}\n{prose(2, 30)}", line.upper()):
            assert {f[0] for f in licenses.scan(text, tools)} == want, line
    for name, template in licenses.TEMPLATES.items():  # every template finds itself
        plain = template.replace("[[", "").replace("]]", "")
        assert (name, 1.0) in {(f[0], f[4]) for f in licenses.scan(f"{prose(3, 20)} {plain} {prose(4, 20)}", tools)}, name


def test_scan_equals_alignment_everywhere():
    """Worn copies: what alignment at every place of a text finds, windows find too."""
    rng = random.Random(12)
    names = ["MIT", "ISC", "GPL-3.0-notice", "MPL-2.0-notice", "Apache-2.0-line", "CC-BY-4.0-line", "Zlib"]
    tools = [licenses.Template(n, licenses.TEMPLATES[n]) for n in names]
    found = missed = 0
    for k in range(60):
        name = rng.choice(names)
        words = re.findall(r"[^\W_]+", licenses.TEMPLATES[name].lower())
        wear = rng.choice([0, 0.05, 0.1, 0.15, 0.25, 0.4])
        worn = [w for w in words if rng.random() > wear / 2]
        worn = [x for w in worn for x in ([w] if rng.random() > wear / 2 else [w, "extra"])]
        words_of = (prose(k, 15).split() + worn + prose(k + 99, 15).split())
        got = {f[0] for f in licenses.scan(" ".join(words_of), tools)}
        want = set()
        for t in tools:
            n = len(t.words)
            for start in range(-n, len(words_of)):
                for slack in (3 + n // 4, 3 + n):
                    if t.find(words_of[max(0, start - slack):max(0, start + n + slack)], licenses.LEAST_COVERAGE):
                        want.add(t.name)
        assert got <= want
        found, missed = found + len(want), missed + len(want - got)
    assert found > 30 and missed == 0
    assert {f[0] for f in licenses.scan(licenses.TEMPLATES["MIT"].replace("copyright", ""), tools)} == {"MIT"}


def test_licenses(spark):
    plain = {n: t.replace("[[", "").replace("]]", "") for n, t in licenses.TEMPLATES.items()}
    mit, apache = plain["MIT"], plain["Apache-2.0-notice"]
    worn = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    texts = edge_texts() + [
        (40, f"{prose(5, 300)}\n{mit}\n{prose(6, 40)}"), (41, prose(7, 30) + " " + worn), (42, apache.upper() + " " + prose(1, 10) + " " + apache),
        (43, "the license of the software is a license"), (44, "İ " + plain["GPL-3.0-line"]), (45, " ".join(mit.split()[:40])), (46, "license " * 3000),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert (got[40].license, got[40].coverage) == ("MIT", 1.0)
    hit = next(f for f in got[40].finds if f["name"] == "MIT")
    assert texts[[i for i, _ in texts].index(40)][1][hit["start"]:hit["end"]].startswith("Permission is hereby")
    assert got[41].license == "MIT" and 0.8 <= got[41].coverage < 1
    assert sum(f["name"] == "Apache-2.0-notice" for f in got[42].finds) == 2
    assert got[44].license == "GPL-3.0-line" and got[44].finds[0]["start"] == 2
    assert all(got[i].license is None and got[i].coverage == 0 for i in (1, 2, 3, 4, 5, 43, 45, 46))
    assert licenses.license_scan(frame(spark, [])).count() == 0


def page(i, host, body, menu="Home About Contact", tail="</body></html>"):
    html_text = (
        f"<!DOCTYPE html><html><head><title>t{i}</title><script>var a='</p><p>no';</script></head><body><nav><ul><li><a href='/{i}'>{menu}</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies {i}</div><article><h1>Title &amp; {i}</h1>{body}<div>Read more on this site</div></article>"
        f"<section id=comments><p>first! {i}</p></section><form><p>Name</p></form><footer>&copy; {host} {i}</footer>{tail}"
    )
    return i, f"https://{host}/p/{i}", html_text, "x"


def test_pages(spark):
    pages = [page(i, "a.example", f"<p>Words   of\npage {i}<p><b>Next{i} &eacute;&#33;<br>line {i}</b> <em>here {i}</em></p>") for i in range(30)]
    pages += [page(100, "b.example", "<p>Alone", tail=""), (200, None, None, "x"), (201, "nonsense", "", "x"), (202, "https://d.example/x", "<p>no article, <b>only", "x")]
    pages += [(203, "https://c.example/", "plain < text & <!-- gone --> more", "x"), (204, "https://c.example/", "<article><p>cut <b", "x"), pages[0]]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = page_template.extract(table).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    for i in range(30):  # what every page of the host says is template, the rest is text
        assert text[i] == f"Title & {i}\nWords of page {i}\nNext{i} é! line {i} here {i}"
    assert text[100] == "Title & 100\nAlone\nRead more on this site"
    assert (text[200], text[201], text[202]) == ("", "", "no article, only")
    assert (text[203], text[204]) == ("plain < text & more", "cut")
    assert all(r.n_chars == len(r.text) for r in got)
    assert page_template.extract(table.where("false")).count() == 0


def test_pages_of_the_tables(spark):
    for r in page_template.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        parts = [" ".join(html.unescape(p).split()) for p in re.split("</?(?:p|h1|b|br)>", article)]
        assert r.text == "\n".join(p for p in parts if p)


def test_pipeline(spark):
    docs = frame(spark, edge_texts() + [(60 + k, prose(20 + k, 100) + f" token = {'0123456789abcdef' * 3}") for k in range(6)] + [(80, prose(20, 100) + " token = x")])
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, SF), name)
        if name != "encoding":
            assert after.columns == docs.columns
        seen[name], docs = after, after
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    assert {1, 2, 3, 4, 12}.isdisjoint(ids("quality")) and 5 in ids("quality")
    assert {6, 7, 80}.isdisjoint(ids("near_duplicates")) and {5, 60, 61} <= ids("near_duplicates")
    assert not any("0123456789abcdef0123" in (r.text or "") for r in seen["secrets"].collect())
    assert seen["encoding"].count() == seen["mixing"].count() > 0
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "encoding"]


def test_pipeline_judges_rows_not_ids(spark):
    good, other, bad = prose(5, 200), prose(6, 150), "spam " * 80
    sound = [(100 + k, prose(200 + k, 90 + k % 40)) for k in range(70)]
    texts = sound + [(7, good), (7, bad), (None, bad), (None, other), (8, other + " end"), (7, None), (9, good), (9, prose(8, 120))]
    docs = frame(spark, texts)
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.doc_id is not None, r.doc_id, r.text) for r in df.collect())
    kept = cut(stages["quality"](spark, docs, SF), "quality")
    assert rows(kept) == sorted((i is not None, i, t) for i, t in texts if t not in (None, bad))
    unique = cut(stages["near_duplicates"](spark, kept, SF), "unique")
    # The repeat of good under id 9 goes, the other text of id 9 stays; rows without an id are in no group.
    assert rows(unique) == sorted((i is not None, i, t) for i, t in texts if t not in (None, bad) and (i, t) != (9, good))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, frame(spark, []), SF)
        assert empty.count() == 0
