"""Searches, URL filter and license scan against brute force and SQL."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from colloquy.llm import ann_collision as ann
from colloquy.llm import license_scan as ls
from colloquy.llm import topk_fagin as tk
from colloquy.llm import url_filter as uf

VEC = "vec_id bigint, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)], VEC)


def exact(vectors, every, k, score):
    out = {}
    for q in range(0, len(vectors), every):
        s = sorted((-score(vectors[q], vectors[c]), c) for c in range(len(vectors)) if c != q)[:k]
        out[q] = [(c, -x) for x, c in s]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_fagin_equals_brute_force(spark):
    r = np.random.default_rng(0)
    v = r.normal(0, 0.1, (400, 8)).astype(np.float32)
    v[40:80] = v[0]
    v[100] = 0
    q = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    want = exact(list(range(400)), 20, 10, lambda a, b: int(q[a] @ q[b]))
    got = found(tk.exact_top_k(table(spark, v), every=20, k=10, block=64))
    assert got == want


def test_search_of_hard_tables(spark):
    v = [[1, 2], [1, 2], None, [], [1, None], [float("nan"), 1], [float("inf"), 1], [3], [0, 0], [2, 1]]
    got = found(tk.exact_top_k(table(spark, v), every=1, k=10))
    assert set(got) == {0, 1, 8, 9} and [c for c, _ in got[0]] == [1, 9, 8]
    assert found(tk.exact_top_k(table(spark, []), every=1)) == {}
    near = found(ann.nearest(table(spark, v), every=1, k=10))
    assert set(near) == {0, 1, 9} and near[9] == [(0, 4.0), (1, 4.0)]
    assert found(ann.nearest(table(spark, []), every=1)) == {}
    same = tk.exact_top_k(table(spark, [[1, 0], [1, 0], [0, 1]], [0, 0, None]), every=1).collect()
    assert [(r.query_id, r.vec_id) for r in same] == [(0, 0), (0, 0)]


def test_quantised_is_exact_for_large_values():
    v = np.array([[1e12, -3e12], [2e12, 5e12]])
    a, b, s = tk.Lists(v, np.array([0, 1]), np.array([0, 1]), 1)(v, np.array([0, 1]))
    want = int(1024 * 1e12) * int(1024 * 2e12) - int(1024 * 3e12) * int(1024 * 5e12)
    assert s.tolist() == [max(-(2**63), want)] * 2


def test_collisions_prune(spark):
    """Hardly structured vectors: few are verified, and nine in ten of the nearest are found."""
    r = np.random.default_rng(5)
    v = r.normal(0, 1, (8000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = np.arange(8000)
    block = ann.Collisions(v, rows, rows, 20, 1.0)
    q, at, score = block(v[:60], rows[:60])
    hits = 0
    for i in range(60):
        s = v @ v[i]
        s[i] = -9
        hits += len(set(np.argsort(-s)[:20]) & set(at[q == i]))
    assert block.searched == 60 and hits / 1200 >= 0.9 and block.verified / (60 * 8000) < 0.2
    assert np.allclose(score, [v[i] @ v[j] for i, j in zip(q, at, strict=True)])
    empty = ann.Collisions(v[:0], rows[:0], rows[:0], 20, 1.0)(v[:3], rows[:3])
    assert [len(x) for x in empty] == [0, 0, 0] and len(tk.Lists(v[:0], rows[:0], rows[:0], 3)(v[:3], rows[:3])[0]) == 0


@pytest.mark.parametrize("block", [5000, 700])
def test_ann_recall(spark, block):
    r = np.random.default_rng(2)
    centres = r.normal(0, 1, (30, 32))
    v = (centres[r.integers(0, 30, 4000)] + r.normal(0, 0.7, (4000, 32))) * r.uniform(0.5, 2, (4000, 1))
    v = v.astype(np.float32)
    d = v.astype(np.float64)
    got = found(ann.nearest(table(spark, v), every=100, k=20, block=block))
    hit = total = 0
    for q in range(0, 4000, 100):
        s = d @ d[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        hit += len(best & {c for c, _ in got[q]})
        total += 20
        assert all(abs(x - s[c]) < 1e-9 for c, x in got[q])
        assert [x for _, x in got[q]] == sorted((x for _, x in got[q]), reverse=True)
    assert hit / total >= 0.9


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_filter(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x", "http://example.com/en/70", "http://notexample.com/en/7", "https://x.net/de/8#f", "https://example.net/de/8", "http://org/es/", "http://a.org/es", "ftp://é.org/es/É", "http://com", "http://b.com:80/en/", "http://q.com?/en/", "http://z.com/a\nb/en/", "x://y://z.com/en/"] + [f"http://h{i}.example.com/p/{i}" for i in range(300)]
    rules = [*uf.RULES, ("h7.example.com", "/p/7", "block"), ("EXAMPLE.com", "", "allow"), (None, "/x", "block"), ("", "", "block"), ("h9.example.com", None, "block")]
    pages = spark.createDataFrame([(i % 50, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in uf.url_verdicts(pages, listed).collect())
    clean = [(h.lower(), p or "", v) for h, p, v in rules if h]
    want = sorted((i % 50, *[x or "" for x in plain_verdict(u, clean)]) for i, u in enumerate(urls))
    assert got == want
    assert uf.url_verdicts(pages, listed.limit(0)).where("verdict = 'block'").count() == 0
    assert uf.url_verdicts(pages.limit(0), listed).count() == 0
    monkeypatch.setattr(uf, "LONGS", 0)  # a filter that is too large for the plan
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in uf.url_verdicts(pages, listed).collect()) == want


def test_bloom_never_misses(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) as key")
    blocks = 2000 * 16 // 512
    f = uf.bloom(keys, "key", blocks)
    F = uf.F
    probe = spark.range(4000).selectExpr("concat('k', id) as key")
    joined = probe.withColumn("block", uf.block_of(F.col("key"), blocks)).join(f, "block").where(uf.inside([F.col(f"w{i}") for i in range(uf.WORDS)], F.col("key")))
    longs = uf.literal(f, blocks)
    first = uf.block_of(F.col("key"), blocks).cast("int") * uf.WORDS
    constant = probe.where(uf.inside([F.element_at(longs, first + i + 1) for i in range(uf.WORDS)], F.col("key")))
    names = {r.key for r in constant.collect()}
    assert {r.key for r in joined.collect()} == names and {f"k{i}" for i in range(2000)} <= names and len(names) < 2000 + 60


def test_license_scan(spark, docs):
    from hard_cases import HARD

    apache, gpl, bsd = ls.TEMPLATES[0][1], ls.TEMPLATES[2][1], ls.TEMPLATES[7][1]
    filler = "lorem ipsum dolor sit amet " * 20
    cut = " ".join(bsd.split()[:-3])
    texts = [apache, filler + gpl.upper() + filler + apache, filler + cut, " ".join(bsd.split()[:12]), "all. rights; reserved", *HARD]
    t = spark.createDataFrame([*ls.TEMPLATES, ("short", "two words"), ("none", None)], "license string, text string")
    got = ls.license_scan(docs(texts).withColumn("license", ls.F.lit("x")), t).collect()
    assert {(r.doc_id, r.license) for r in got} == {(0, "Apache-2.0"), (1, "GPL-3.0"), (1, "Apache-2.0"), (2, "BSD"), (4, "proprietary")}
    by = {(r.doc_id, r.license): r for r in got}
    assert by[0, "Apache-2.0"].containment == 1.0 and by[0, "Apache-2.0"].first_word == 0 and by[1, "GPL-3.0"].first_word == 100
    assert 0.8 <= by[2, "BSD"].containment < 1
    assert ls.license_scan(docs([]), t).count() == 0 and ls.license_scan(docs(texts), t.limit(0)).count() == 0


def shingled(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]


def contained(text, wording):
    """The share of a wording's shingles in the best window, and the first word there, by looking at every window."""
    at, want = shingled(text), set(shingled(wording))
    size = 1
    while size < len(want):
        size *= 2
    best = (0.0, 0)
    for w in range(-1, len(at) // size + 1):
        held = [(p, s) for p, s in enumerate(at[max(0, w * size) : max(0, (w + 2) * size)], max(0, w * size)) if s in want]
        if held:
            best = max(best, (len({s for _, s in held}) / len(want), -held[0][0]))
    return best[0], -best[1]


@pytest.mark.parametrize("sizes", [(200, 260, 500), (1000, 2047, 3000), (3, 8, 33)])
def test_licenses_of_all_sizes_equal_brute_force(spark, docs, sizes):
    r = random.Random(sum(sizes))
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    templates = [(f"l{n}", " ".join(r.choice(vocabulary) for _ in range(n + 2))) for n in sizes]
    texts = []
    for _, wording in templates:
        w = wording.split()
        for _ in range(8):
            part = w[: int(len(w) * r.uniform(0.7, 1))] if r.random() < 0.7 else list(w)
            for _ in range(int(len(part) * r.uniform(0, 0.08))):
                part[r.randrange(len(part))] = "changed"
            before, after = ([r.choice(vocabulary) for _ in range(r.randrange(4 * len(w)))] for _ in range(2))
            texts.append(" ".join(before + part + after))
    got = {(x.doc_id, x.license): (x.containment, x.first_word) for x in ls.license_scan(docs(texts), spark.createDataFrame(templates, "license string, text string")).collect()}
    want = {(i, name): contained(t, wording) for i, t in enumerate(texts) for name, wording in templates}
    want = {k: v for k, v in want.items() if v[0] >= 0.8}
    assert 5 < len(want) < len(texts) and got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(v[0]), v[1]) for k, v in want.items())


def test_whole_license_texts(spark, docs):
    texts = [f"Copyright someone\n\n{t}\n\nand then code" for _, t in ls.TEMPLATES]
    got = {(r.doc_id, r.license): r.containment for r in ls.license_scan(docs(texts), spark.createDataFrame(list(ls.TEMPLATES), "license string, text string")).collect()}
    assert all(got[i, name] == 1.0 for i, (name, _) in enumerate(ls.TEMPLATES))
    two, three = (next(i for i, (n, _) in enumerate(ls.TEMPLATES) if n == f"BSD-{k}-Clause") for k in (2, 3))
    assert (three, "BSD-2-Clause") in got and got.get((two, "BSD-3-Clause"), 0.8) < 1
