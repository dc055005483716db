"""Fingerprints, Golay keys, links and line templates against brute force."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from plain_lines import plain_dedup

from colloquy.llm import line_templates as lt
from colloquy.llm import near_copies as nc
from colloquy.llm import simhash_golay as sg
from colloquy.llm.common import F


def brute(fps, radius=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprint_is_the_majority():
    import xxhash

    text = "The Quick  brown\tfox\x0bÉté the quick brown"
    words = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert sg.fingerprint(text) == want
    assert sg.fingerprint(None) == sg.fingerprint(" \n") == 0
    assert sg.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert sg.fingerprint("a\u00a0b c") == xxhash.xxh64_intdigest("a\u00a0b c".encode(), 42)


def test_code_is_perfect_and_near_segments_share_a_key():
    assert (sg.decoder() != 0xFFFF).all()
    r = np.random.default_rng(0)
    v = r.integers(0, 1 << 22, 2000)
    w = v ^ (1 << r.integers(0, 22, 2000))
    a, b = sg.segment_keys(v, 22), sg.segment_keys(w, 22)
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b, strict=True))


def clustered(n, seed=1):
    r = np.random.default_rng(seed)
    out = {0, 2**64 - 1}
    for base in r.integers(0, 2**63, 12).tolist():
        for _ in range(n):
            f = base
            for b in r.choice(64, r.integers(0, 6), replace=False).tolist():
                f ^= 1 << b
            out.add(f)
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_links_join_what_brute_force_joins(spark, block):
    from pyspark.sql import functions as F

    from colloquy.operators.components import components

    fps = clustered(40)
    assert len(fps) > 300
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = components(sg.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), block=block))
    roots = {r.node: r.root for r in got.select(F.col("node"), F.col("root")).collect()}
    want = brute(fps)
    groups, expected = defaultdict(set), defaultdict(set)
    for f, s in zip(fps, signed, strict=True):
        groups[roots.get(s, s)].add(f)
        expected[want[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_of_hard_texts(spark, docs):
    from hard_cases import HARD

    base = " ".join(f"w{i}" for i in range(400))
    all_ = HARD + [base, base + " end", base, None]
    got = {r.doc_id: r for r in sg.near_duplicates(docs(all_)).collect()}
    fps = [sg.fingerprint(t) for t in all_]
    want = brute(set(fps))
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(want[f], i)
    assert [got[i].component_id for i in range(len(all_))] == [first[want[f]] for f in fps]
    assert got[0].component_id == got[1].component_id == got[len(all_) - 1].component_id == 0
    assert sg.near_duplicates(docs([])).count() == 0
    nulls = sg.near_duplicates(docs(["q", "q", "r"], [None, 5, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in nulls) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_one_of_each_stays(spark, docs):
    base = " ".join(f"w{i}" for i in range(300))
    kept = nc.first_of_each(docs([base, base, "other text here", None, "", base], [4, 2, 7, 8, 9, None]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8]
    assert nc.first_of_each(docs(["same", "same"], [1, 1])).count() == 1
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_lines_against_plain_version(spark, docs):
    from hard_cases import HARD

    r = random.Random(1)
    words = "the of and to in is on with was at by from".split()
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    log = lambda: f"host {r.choice('abcdef')} connected to the main server on port {r.randrange(9999)} after a long wait by {r.choice(words)}"
    post = lambda: f"posted by {r.choice('ghijkl')} in news"
    texts = ["\n".join([prose(30), "All rights reserved.", log(), prose(12), post(), prose(5)]) for _ in range(30)] + [prose(60)] * 3 + HARD
    ids = [i % 34 for i in range(len(texts))]  # some ids stand for several documents
    got = {row.n_chars: row for row in lt.dedup_lines(docs(texts, ids).withColumn("n_chars", F.monotonically_increasing_id())).collect()}
    want = plain_dedup(list(zip(ids, texts, strict=True)))
    assert [got[k].text for k in sorted(got)] == want
    assert sum(row.n_dropped for row in got.values()) > 80 and got[min(got)].n_dropped == 0
    assert lt.dedup_lines(docs([])).count() == 0


def test_lines_of_repeated_rows_and_passages(spark, docs):
    passage = " ".join(f"p{i}x" for i in range(60))
    d = docs([passage + "\nown one", "own two\n" + passage, passage + "\nown one"], [1, 2, 1])
    got = sorted((r.doc_id, r.text) for r in lt.dedup_lines(d.withColumn("k_id", d.n_chars)).collect())
    assert got == [(1, passage + "\nown one"), (1, passage + "\nown one"), (2, "own two")]
    none = sorted((r.doc_id is None, r.text) for r in lt.dedup_lines(docs(["same line here now", "same line here now\nx", "same line here now\ny"], [None, None, 3])).collect())
    assert none == [(False, "same line here now\ny"), (True, ""), (True, "x")]


def lines_kept(spark, docs, *lines):
    """Which of lines stay, each in a document of its own with a line of its own."""
    unlike = "qwertyuiop"
    got = lt.dedup_lines(docs([f"{unlike[i % 10] * (i + 1)}\n{x}" for i, x in enumerate(lines)])).orderBy("doc_id").collect()
    return [r.n_dropped == 0 for r in got]


def test_templates_generalise_fields(spark, docs):
    assert lt.masked("job 17 done") == lt.masked("job 99 done") and lt.masked("  ") == []
    assert lines_kept(spark, docs, "posted by alice in news", "posted by bob in news", "posted by carol in news") == [True, False, False]
    passage = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}word" for i in range(60)]
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(passage))
    assert lines_kept(spark, docs, " ".join(passage), changed(30)) == [True, False]
    assert lines_kept(spark, docs, " ".join(passage), changed(1), changed(2, 58)) == [True, False, False]
    # alike in a leaf only, or in too little
    assert lines_kept(spark, docs, "posted by alice in news", "posted by two old friends", "sold by alice on monday") == [True] * 3
    assert lines_kept(spark, docs, "is that so", "is that all", "is that it") == [True] * 3


def jaccard(a, b, n=5):
    cut = lambda t: {tuple(w[i : i + n]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - n + 1))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_near_copies_by_similarity(spark, docs):
    from hard_cases import HARD

    r = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    texts, base = [], []
    for _ in range(60):
        t = [r.choice(words) for _ in range(r.randrange(60, 900))]
        base.append(len(texts))
        texts.append(" ".join(t))
        for _ in range(r.randrange(3)):
            u = list(t)
            for _ in range(r.randrange(1, max(2, len(u) // 100))):
                u[r.randrange(len(u))] = "changed"
            texts.append(" ".join(u))
    hot = [r.choice(words) for _ in range(120)]
    for i in range(150):
        u = list(hot)
        u[r.randrange(120)] = f"n{i}"
        texts.append(" ".join(u))
    got = {row.doc_id: row.component_id for row in nc.near_copies(docs(texts + HARD + HARD)).collect()}
    pairs = [(i, j, jaccard(texts[i], texts[j])) for i in range(len(texts)) for j in range(i)]
    near = [(i, j) for i, j, s in pairs if s >= 0.82]
    assert len(near) > 1000 and sum(got[i] == got[j] for i, j in near) >= 0.98 * len(near)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j, s in pairs:
        if s >= 0.74:
            parent[find(i)] = find(j)
    assert all(find(i) == find(got[i]) for i in range(len(texts)))
    n = len(texts)
    assert got[n] == got[n + 1] == got[n + 2] == n and all(got[n + len(HARD) + k] == got[n + k] for k in range(len(HARD)))
    assert nc.near_copies(docs([])).count() == 0


def test_one_of_each_with_clashing_names_and_repeats(spark, docs):
    d = docs(["a b c d e f g", "a b c d e f g", None, "", "other words are in this one"], [5, 5, None, 7, None])
    for c in ("w_id", "w_hash", "key", "hash", "row", "id", "group", "node"):
        d = d.withColumn(c, F.lit("x"))
    got = nc.first_of_each(d)
    assert got.columns == d.columns and sorted((r.doc_id is None, r.text or "") for r in got.collect()) == [(False, ""), (False, "a b c d e f g"), (True, "other words are in this one")]


def test_twins_in_large_families_meet(spark, docs):
    r = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    texts, twins = [], []
    for _ in range(3):
        shared = [r.choice(words) for _ in range(60)] * 20  # repeats bring fingerprints near, whatever the sets
        for _ in range(30):
            t = shared + [r.choice(words) for _ in range(90)]
            twins.append((len(texts), len(texts) + 1))
            texts += [" ".join(t), " ".join([*t[:-2], "another", "end"])]
    assert all(jaccard(texts[i], texts[j]) > 0.94 for i, j in twins) and jaccard(texts[0], texts[2]) < 0.75
    got = {row.doc_id: row.component_id for row in nc.near_copies(docs(texts)).collect()}
    assert [got[j] for _, j in twins] == [i for i, _ in twins] == [got[i] for i, _ in twins]


def test_no_link_is_lost_in_large_buckets(spark, docs):
    """Families whose members are about 0.8 alike, in buckets of over SMALL: what shares a key and is alike is joined."""
    r = random.Random(23)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(6):
        base = [r.choice(words) for _ in range(200)]
        for _ in range(30):
            u = list(base)
            for _ in range(r.randrange(1, 4)):
                u[r.randrange(200)] = r.choice(words)
            texts.append(" ".join(u))
    h = [nc.shingle_hashes(t, 5) for t in texts]
    fps = np.array([[nc.majority(x), nc.majority(nc.mixed(x))] for x in h], np.int64)
    buckets = defaultdict(set)
    for i, k in zip(*nc.wide_keys(fps), strict=True):
        buckets[int(k)].add(int(i))
    assert sum(len(b) > sg.SMALL for b in buckets.values()) > 20
    alike = {(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8}
    sharing = {p for b in buckets.values() for p in combinations(sorted(b), 2) if p in alike and sg.distance(fps[p[0]], fps[p[1]]) <= nc.RADIUS}
    assert 300 < len(sharing) and 0.1 < len(alike) / (6 * 30 * 29 / 2) < 0.9
    got = {row.doc_id: row.component_id for row in nc.near_copies(docs(texts)).collect()}
    assert all(got[i] == got[j] for i, j in sharing)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in sorted(alike):
        parent[max(find(i), find(j))] = min(find(i), find(j))
    assert all(find(i) == find(got[i]) for i in got)


def test_equal_fingerprints_are_compared(spark, docs):
    same = "again " * 300
    texts = [same + " ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    assert len({nc.majority(nc.shingle_hashes(t, 5)) for t in texts}) == 1 and jaccard(texts[0], texts[1]) < 0.1
    got = {row.doc_id: row.component_id for row in nc.near_copies(docs([*texts, texts[1]])).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("n", [120, 1200])
def test_nothing_below_the_similarity_is_linked(spark, docs, n):
    base, texts = [f"w{i}" for i in range(n)], []
    for k, share in enumerate((0.777, 0.785, 0.79, 0.795, 0.805)):  # each beside a text that it shares so much with
        own = [f"{k}{w}" for w in base]
        both = next(m for m in range(n, 0, -1) if (m - 4) / (2 * n - m - 4) < share)
        texts += [" ".join(own), " ".join(own[:both] + [f"{k}z{i}" for i in range(n - both)])]
    js = [jaccard(texts[2 * k], texts[2 * k + 1]) for k in range(5)]
    got = {row.doc_id: row.component_id for row in nc.near_copies(docs(texts)).collect()}
    assert all(0.76 < j < 0.8 for j in js[:4]) and all(got[2 * k + 1] == 2 * k + 1 for k in range(5) if js[k] < 0.8)


@pytest.mark.parametrize("block", [1 << 19, 1000])
def test_groups_in_blocks_equal_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(nc, "BLOCK", block)
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        u = list(base)
        for k in range(r.randrange(1, 5)):
            u[r.randrange(150)] = f"n{i}x{k}"
        texts.append(" ".join(u))
    got = {row.doc_id: row.component_id for row in nc.near_copies(docs(texts), similarity=0.9).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, i in combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.9:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))] and len(set(got.values())) > 5


def test_copies_lose_what_their_original_loses(spark, docs):
    """Near copies of one earlier document keep its lines; a passage goes from short documents that are little else."""
    passage = "one quite long passage of some words that stands in many a document of this kind and is all that they share"
    own = [f"line {'abcdefghijklmnop'[i]}{'qrstuvwxyzabcdef'[i]} {'ghijklmnopqrstuv'[i] * 3} stands only in one document {'fedcbafedcbafedc'[i] * 4}" for i in range(12)]
    a = "\n".join([*own, passage])
    tail = lambda x: " ".join(f"{x}{c}{c}" for c in "abcdefghijk")
    texts = [f"{tail('m')}\n" + passage, a, a.replace("stands only in one document ffff", "stands only in another document gggg"), a + "\nx", f"{tail('n')}\n" + passage, passage + f"\n{tail('o')}", "\n".join(own[:4]) + f"\n{tail('p')}"]
    got = [r.text for r in lt.dedup_lines(docs(texts), copies=0.8).orderBy("doc_id").collect()]
    without = lambda t: t.replace("\n" + passage, "")
    assert got[0] == texts[0] and got[1] == without(a) and got[2] == without(texts[2]) and got[3] == without(texts[3])
    assert got[4:] == [tail("n"), tail("o"), tail("p")]
    plain = [r.text for r in lt.dedup_lines(docs(texts)).orderBy("doc_id").collect()]
    assert plain[3] == "x" and plain[4] == tail("n")
