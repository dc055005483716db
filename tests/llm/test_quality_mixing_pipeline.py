"""Quality classifier, mixing and the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from hard_cases import DATA
from plain_lines import plain_dedup

import corpus_pipeline
from colloquy.llm import common, mixing, quality, queries


def corpus(n, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randrange(30, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text[r.randrange(len(text))] = r.choice(["vileword", "nastyword", "awful!!!"])
        rows.append((i, " ".join(text), "en" if i % 3 else "de", f"src{i % 7}", 0))
        labels.append((i, int(bad)))
    return rows, labels


def test_quality_on_held_out(spark):
    rows, labels = corpus(1500)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    known = spark.createDataFrame(labels[:1000], "id bigint, bad int")
    got = {r.id: r.keep for r in quality.decisions(docs, known).collect()}
    wrong = [i for i, bad in labels[1000:] if got[i] == bool(bad)]
    assert len(wrong) <= 5


def test_quality_of_hard_tables(spark, docs):
    from hard_cases import HARD

    d = docs(HARD).withColumn("host", common.F.lit(None)).withColumn("evidence", common.F.lit(1)).withColumn("k1", common.F.lit("x"))
    none = spark.createDataFrame([], "id bigint, bad int")
    assert quality.decisions(d, none).where("keep").count() == len(HARD)
    assert quality.accepted(d, none).columns == d.columns
    one = spark.createDataFrame([(0, 1), (0, 0), (3, 0), (None, 1), (4, None)], "id bigint, bad int")
    assert quality.decisions(d, one).count() == len(HARD)
    assert quality.decisions(d.limit(0), one).count() == 0 and quality.accepted(d.limit(0), one).count() == 0
    assert quality.accepted(d, one).count() == quality.decisions(d, one).where("keep").count()


def test_null_sites_are_not_empty_ones(spark):
    rows = [(i, "fine words here" if i % 2 else "bad words", s, "en", 0) for i in range(20) for s in (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(20)], "id bigint, bad int")
    assert quality.decisions(docs, labels).count() == 40
    one = docs.select(quality.site(common.F.col("source")).alias("s")).distinct().count()
    assert one == 2


def plain_quality(rows, labels):
    """Evidence, site rate and p_bad of each row by loops, from the same definitions."""
    import math

    import numpy as np

    fold = lambda i: folds[i]
    known = {i: bad for i, bad in labels}
    folds = FOLD_OF
    counts, totals = defaultdict(lambda: [[0, 0] for _ in range(quality.FOLDS)]), [[0, 0] for _ in range(quality.FOLDS)]
    for i, text, *_ in rows:
        if i in known:
            totals[fold(i)][known[i]] += 1
            for f in quality.features(text):
                counts[f][fold(i)][known[i]] += 1

    def best(out):
        use = [k for k in range(quality.FOLDS) if k != out]
        good, bad = sum(totals[k][0] for k in use), sum(totals[k][1] for k in use)
        rate, found = bad / (good + bad), {}
        for f, c in counts.items():
            g, b = sum(c[k][0] for k in use), sum(c[k][1] for k in use)
            odds = math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1))
            term = lambda x, e: x * math.log(x / e) if x > 0 else 0.0
            if odds >= quality.ODDS and 2 * (term(b, (g + b) * rate) + term(g, (g + b) * (1 - rate))) >= quality.SURE:
                found[f] = odds
        return found

    def evidence(text, weights):
        return min(quality.MOST, sum(sorted(weights[f] for f in weights.keys() & quality.features(text))))

    seen = defaultdict(int)
    for i, text, *_ in rows:
        if i in known:
            seen[round(evidence(text, best(fold(i))), 1), known[i]] += 1
    x, y, n = (np.array(v, float) for v in zip(*((e, bad, c) for (e, bad), c in seen.items()), strict=True))
    a, b = quality.curve(x, y, n)
    weights = best(None)
    ev = [evidence(text, weights) for _, text, *_ in rows]
    p = [1 / (1 + math.exp(-(a + b * e))) for e in ev]
    sites, hosts = defaultdict(list), defaultdict(list)
    for (_, _, lang, source, _), q in zip(rows, p, strict=True):
        sites[source, lang].append(q)
        hosts[source].append(q)
    mean = sum(p) / len(p)
    chance = mean * (1 - mean)
    beyond = sum(len(v) * ((sum(v) / len(v) - mean) ** 2 - chance / len(v)) for v in hosts.values()) / len(p)
    k = quality.strength(beyond, chance)
    host = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    beyond = sum(len(v) * ((sum(v) / len(v) - host[h]) ** 2 - chance / len(v)) for (h, _), v in sites.items()) / len(p)
    k = quality.strength(beyond, chance)
    logit = lambda z: math.log(min(max(z, 1e-6), 1 - 1e-6) / (1 - min(max(z, 1e-6), 1 - 1e-6)))
    out = {}
    for (i, _, lang, source, _), e, q in zip(rows, ev, p, strict=True):
        v = sites[source, lang]
        rate = (max(0.0, sum(v) - q) + k * host[source]) / (len(v) - 1 + k)
        out[i] = (e, rate, 1 / (1 + math.exp(-(logit(q) + logit(rate) - logit(mean)))))
    return out


FOLD_OF: dict[int, int] = {}


def test_quality_equals_plain_version(spark):
    rows, labels = corpus(700, 11)
    rows = [(i, t + " vileword" * (i % 7 == 3 and i % 5 == 0), lang, source, n) for i, t, lang, source, n in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    F = common.F
    FOLD_OF.update({r.i: r.f for r in docs.select(F.col("doc_id").alias("i"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(quality.FOLDS)).alias("f")).collect()})
    got = {r.id: (r.evidence, r.site_rate, r.p_bad) for r in quality.decisions(docs, spark.createDataFrame(labels[:500], "id bigint, bad int")).collect()}
    want = plain_quality(rows, labels[:500])
    assert got.keys() == want.keys() and sum(v[2] > 0.5 for v in want.values()) > 100
    for i, v in want.items():
        assert got[i] == pytest.approx(v, rel=1e-6, abs=1e-9)


def test_no_text_is_shuffled_for_sites(spark, monkeypatch, capsys):
    monkeypatch.setattr(quality, "few", lambda df, *a, **k: df)
    rows, labels = corpus(200, 4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        quality.decisions(docs, spark.createDataFrame(labels, "id bigint, bad int")).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "text" not in plan


def test_sparse_sites_shrink(spark):
    sites = spark.createDataFrame([("a", "x", 1000, 900.0), ("a", "y", 1, 0.0), ("b", "x", 1000, 100.0), ("c", "z", 1, 1.0)], "host string, path string, n bigint, s double")
    both, mean, k = quality.site_posteriors(sites)
    rate = {(r.host, r.path): (r.s + k * r.host_rate) / (r.n + k) for r in both.collect()}
    host = {r.host: r.host_rate for r in both.collect()}
    assert 0.45 < mean < 0.55 and host["a"] > 0.8 and host["b"] < 0.2
    assert mean < host["c"] < 1 and rate["a", "y"] < rate["a", "x"]


def plain_share(children, budget):
    """Water filling, step by step: children are name -> (capacity, weight)."""
    given = dict.fromkeys(children, 0.0)
    open_ = {c for c, (cap, w) in children.items() if w > 0}
    left = budget
    while open_:
        total = sum(children[c][1] for c in open_)
        full = {c for c in open_ if children[c][0] <= left * children[c][1] / total + 1e-9}
        if not full:
            for c in open_:
                given[c] = left * children[c][1] / total
            break
        for c in full:
            given[c] = children[c][0]
        left -= sum(children[c][0] for c in full)
        open_ -= full
    return given


def plain_mix(rows, weights, share, epochs, seed):
    weight = {k[:3]: max(0.0, k[3]) for k in weights}
    leaf = defaultdict(int)
    docs = []
    for i, text, lang, source, _ in rows:
        digits = "".join(c for c in source if c.isdigit())
        key = (f"d{int(digits or 0) % 4}", lang, source)
        n = len(text.split())
        leaf[key] += n
        docs.append((i, key, n))
    cap = {k: v * epochs for k, v in leaf.items()}

    def level(keys, depth, budget):
        groups = defaultdict(list)
        for k in keys:
            groups[k[: depth + 1]].append(k)
        children = {g: (sum(cap[k] for k in ks), weight.get(g + (None,) * (2 - depth), 1.0)) for g, ks in groups.items()}
        given = plain_share(children, budget)
        if depth == 2:
            return given
        out = {}
        for g, ks in groups.items():
            out |= level(ks, depth + 1, given[g])
        return out

    out = []
    for key, b in level(list(cap), 0, share * sum(leaf.values())).items():
        b = int(b + 1e-6)
        whole = b // leaf[key] if leaf[key] else 0
        mine = [(i, n) for i, k, n in docs if k == key]
        out += [(i, e) for e in range(whole) for i, _ in mine]
        rest = b - whole * leaf[key]
        for i, n in sorted(mine, key=lambda x: hashlib.md5(f"{seed}|{whole}|{x[0]}".encode()).hexdigest()):
            rest -= n
            if rest < 0:
                break
            out.append((i, whole))
    return sorted(out)


@pytest.mark.parametrize(("share", "epochs"), [(0.4, 1), (0.9, 3), (2.5, 3)])
def test_mixing_equals_plain_version(spark, monkeypatch, share, epochs):
    rows, _ = corpus(400, 3)
    monkeypatch.setattr(mixing, "SPREAD", 10)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    w = spark.createDataFrame(list(mixing.WEIGHTS), "domain string, lang string, source string, weight double")
    got = sorted((r.doc_id, r.epoch) for r in mixing.mix(docs, w, share=share, epochs=epochs).select("row.doc_id", "epoch").collect())
    want = plain_mix(rows, mixing.WEIGHTS, share, epochs, mixing.SEED)
    assert got == want and want
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)  # as with very many leaves
    assert sorted((r.doc_id, r.epoch) for r in mixing.mix(docs, w, share=share, epochs=epochs).select("row.doc_id", "epoch").collect()) == want


def test_what_weighs_nothing_is_no_capacity(spark):
    leaves = [("d0", "en", "a", 300), ("d1", "en", "a", 200), ("d1", "fr", "a", 100), ("d2", "en", "a", 150), ("d2", "en", "b", 150), ("d3", "es", "a", 100)]
    weights = [("d0", None, None, 4.0), ("d1", None, None, 3.0), ("d2", None, None, 2.0), ("d3", None, None, 1.0), ("d3", "es", None, 0.0), ("d1", "fr", None, 0.0), ("d2", "en", "b", 0.0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    w = spark.createDataFrame(weights, "domain string, lang string, source string, weight double")
    given = lambda total: {(r.domain, r.lang, r.source): r.given for r in mixing.budgets(df, w, total, 1).collect()}
    none = {("d1", "fr", "a"): 0, ("d2", "en", "b"): 0, ("d3", "es", "a"): 0}
    assert given(540) == {("d0", "en", "a"): 240, ("d1", "en", "a"): 180, ("d2", "en", "a"): 120, **none}
    assert given(630) == {("d0", "en", "a"): 286, ("d1", "en", "a"): 200, ("d2", "en", "a"): 143, **none}
    assert given(2000) == {("d0", "en", "a"): 300, ("d1", "en", "a"): 200, ("d2", "en", "a"): 150, **none}


def test_mixing_of_hard_tables(spark, docs):
    from hard_cases import HARD

    w = spark.createDataFrame([("d0", None, None, None), ("d1", None, None, -2.0)], "domain string, lang string, source string, weight double")
    d = docs(HARD, [None if i < 3 else 1 for i in range(len(HARD))]).withColumn("lang", common.F.lit(None).cast("string")).withColumn("epoch", common.F.lit(1))
    assert mixing.mix(d, w).count() == 0
    assert mixing.mix(d.withColumn("source", common.F.lit(None).cast("string")), w, share=5.0, epochs=2).count() >= len(HARD)
    assert mixing.mix(d.limit(0), w).count() == 0


ORACLES = sorted(queries.ORACLE)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a = queries.QUERIES[name](spark, str(DATA)).toPandas()
    b = c.execute(queries.ORACLE[name]).df()[list(a.columns)]
    key = lambda f: sorted(repr([None if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r]) for r in f.astype(object).itertuples(index=False, name=None))
    assert key(a) == key(b) and len(a)


def test_sql_of_repeated_rows(spark, docs):
    from colloquy.llm import line_templates, topk_fagin

    d = docs(["same line in both here\nown one", "same line in both here\nown one", "same line in both here\nown two", "", "x"], [1, 1, 2, 3, 3])
    c = duckdb.connect()
    c.register("documents", d.toPandas())
    got = line_templates.dedup_lines(d.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", common.F.md5("text").alias("text_md5"))
    assert sorted(map(tuple, got.collect())) == sorted(c.execute("SELECT doc_id, n_lines, n_dropped, text_md5 FROM (" + line_templates.OP7_SQL + ")").fetchall())
    v = spark.createDataFrame([(0, [0.5, 0.25], 0), (0, [0.5, 0.25], 0), (100, [0.25, -1.0], 0), (7, [1.0, 1.0], 0)], "vec_id bigint, embedding array<float>, label int")
    c.register("embeddings", v.toPandas())
    assert sorted(map(tuple, topk_fagin.exact_top_k(v).collect())) == sorted(c.execute(topk_fagin.OP3_SQL).fetchall())


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_pipeline_against_plain_stages(spark, tmp_path):
    d, docs, rows = str(DATA), common.table(spark, str(DATA), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = sorted(docs.collect(), key=lambda r: r.doc_id)
    ids = {name: [r.doc_id for r in kept] for name, kept in rows.items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == ids["sentencepiece_encoding"]

    labels = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in common.table(spark, d, "labels").collect()}
    kept = set(ids["quality_classifier"])
    assert not [i for i, bad in labels.items() if not bad and i not in kept]

    want = plain_dedup([(r.doc_id, r.text) for r in rows["quality_classifier"]], copies=corpus_pipeline.COPIES)
    assert [(r.doc_id, r.text, r.n_chars) for r in rows["line_dedup"]] == [(r.doc_id, t, len(t)) for r, t in zip(rows["quality_classifier"], want, strict=True)]

    texts = {r.doc_id: shingled(r.text) for r in rows["line_dedup"]}
    likeness = lambda a, b: len(texts[a] & texts[b]) / len(texts[a] | texts[b])
    left = ids["simhash_near_dedup"]
    assert not [(a, b) for a in left for b in left if a < b and likeness(a, b) >= 0.85]
    for i in set(texts) - set(left):
        assert any(j != i and likeness(i, j) >= 0.74 for j in texts)

    want = plain_mix([(r.doc_id, r.text, r.lang, r.source, 0) for r in rows["simhash_near_dedup"]], mixing.WEIGHTS, corpus_pipeline.MIX_SHARE, 1, mixing.SEED)
    assert [i for i, _ in want] == ids["source_mixing"] == ids["sentencepiece_encoding"]
    assert all(r.exact for r in rows["sentencepiece_encoding"])
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_hard_tables(spark, docs, tmp_path, empty):
    from hard_cases import HARD

    d = docs([] if empty else [*HARD, *HARD, "a text of its own"], [None if i < 2 else i // 2 for i in range(2 * len(HARD))] + [99])
    for c in ("w_id", "w_hash", "k1", "row", "evidence", "epoch", "leaf", "whole", "node"):
        d = d.withColumn(c, common.F.lit("x"))
    columns, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, str(DATA)).write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        assert d.count() <= n
        n = d.count()
        if name != "sentencepiece_encoding":
            assert d.columns == columns
    assert (n == 0) == empty and d.where("not exact").count() <= 1
