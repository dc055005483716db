"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document. A document has the features of its words (lower-cased, without punctuation at their ends),
the words' first four and five letters, the marks at words' ends, and its shape (capitals, marks, echoes and
repeated words). Labelled
documents give each feature's counts among good and bad ones, by a grouped aggregation. A feature is kept if bad
documents have it far more often (log-odds of at least ``odds``) and the likelihood ratio test leaves little doubt
(at least ``sure``). A document's evidence is the sum of its kept features' log-odds, up to ``most``; a logistic curve
turns it into a probability p of being bad. It is fitted on the labelled documents in folds, each with the evidence
that the counts of the other folds give.

Posteriors of sites. The mean of p over a host's documents is shrunk towards the global mean, that over a path's
(host and path together) towards its host's posterior: (sum + k prior) / (n + k). The strengths k come from the data
(method of moments: the smaller the spread among hosts, or among paths of a host, beyond what chance gives, the
larger k), so sparse sites take the rate of what they belong to. The sums are grouped aggregations that combine on
the map side.

A document's posterior log-odds are logit(p) + logit(its path's posterior without the document itself) - logit(global).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import few, kept, table, text_batches

#: Bounds: labelled documents used for fitting, and features kept.
SAMPLE, FEATURES = 16_000, 20_000
ODDS, SURE, MOST, REJECT = 3.0, 14.0, 16.0, 0.5
#: Keys of rejected rows (two longs each) that are broadcast at most.
REJECTED = 200_000
#: Parts of the labelled documents; each part's evidence comes from the counts of the others.
FOLDS = 3
MARKS = ".,;:!?\"'()[]{}<>|*#%&$+-=/\\_~^`@"


def features(text: str | None) -> set[str]:
    words = (text or "").split()
    if not words:
        return {"#empty"}
    different = set(words)
    out = set()
    upper = marked = 0
    for w in different:
        core = w.strip(MARKS)
        if not core:
            out.add("|" + w[:4])
            continue
        tail = w[len(w.rstrip(MARKS)) :]
        if len(tail) > 1:
            marked += 1
            out.add("!" + tail[-3:])
        if len(core) > 1 and core.isupper():
            upper += 1
        core = core.lower()
        out.add(core)
        if len(core) > 5:
            out.add("^" + core[:5])
        if len(core) > 4:
            out.add("^" + core[:4])
    n = len(different)
    out.add(f"#upper{5 * upper // n}")
    out.add(f"#marked{5 * marked // n}")
    out.add(f"#echo{math.ceil(5 * sum(map(eq, words, words[1:])) / len(words))}")
    if len(words) >= 20:
        out.add(f"#repeat{min(9, int(10 * n / len(words)))}.{min(3, len(words) // 100)}")
    return out


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(text, bad, fold): the documents of at most ``sample`` labelled ids, chosen by hash. Copies
    of a text count once, as else all words of a bad text with many copies would tell against others."""
    chosen = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id").select("text", "bad", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")).dropDuplicates(["text", "bad"])


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, fold, good, bad) from (text, bad, fold); the feature '' counts the documents themselves."""
    seen: dict[tuple[int, int], Counter] = defaultdict(Counter)
    for batch in batches:
        for text, bad, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            c = seen[fold, int(bool(bad))]
            c.update(features(text.as_py()))
            c[""] += 1
        if sum(map(len, seen.values())) > 500_000:
            yield counted(seen)
            seen.clear()
    yield counted(seen)


def counted(seen: dict[tuple[int, int], Counter]) -> pa.RecordBatch:
    rows = [(f, fold, 0 if bad else n, n if bad else 0) for (fold, bad), c in seen.items() for f, n in c.items()]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["feature", "fold", "good", "bad"])


def term(x: Column, e: Column) -> Column:
    return F.when(x > 0, x * F.log(x / e)).otherwise(0.0)


def best_features(counts: DataFrame, left_out: int | None) -> dict[str, float]:
    """Kept features' log-odds from the counts (feature, good_k, bad_k), without a fold; none without both kinds."""
    folds = [k for k in range(FOLDS) if k != left_out]
    g, b = (sum((F.col(f"{kind}_{k}") for k in folds[1:]), F.col(f"{kind}_{folds[0]}")).cast("double") for kind in ("good", "bad"))
    summed = counts.select("feature", g.alias("g"), b.alias("b"))
    total = summed.where("feature = ''").first()
    if not total or not total["g"] or not total["b"]:
        return {}
    n_good, n_bad, g, b = total["g"], total["b"], F.col("g"), F.col("b")
    rate = n_bad / (n_good + n_bad)
    odds = F.log((b + 0.5) / (n_bad + 1)) - F.log((g + 0.5) / (n_good + 1))
    test = 2 * (term(b, (g + b) * rate) + term(g, (g + b) * (1 - rate)))
    best = summed.where("feature <> ''").select("feature", odds.alias("odds"), test.alias("test")).where((F.col("odds") >= ODDS) & (F.col("test") >= SURE)).orderBy(F.desc("test"), "feature").limit(FEATURES)
    return {r["feature"]: r["odds"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> tuple[dict[str, float], tuple[float, float]] | None:
    """Kept features' log-odds, and the curve's intercept and slope; None without both good and bad documents."""
    chosen = kept(sampled(docs, labels, id_col, text_col, sample))
    counts = chosen.select("text", "bad", "fold").mapInArrow(count_features, "feature string, fold int, good bigint, bad bigint")
    counts = kept(counts.groupBy("feature").agg(*(F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(kind))), F.lit(0)).alias(f"{kind}_{k}") for k in range(FOLDS) for kind in ("good", "bad"))))
    weights = best_features(counts, None)
    kinds = chosen.agg(F.count_if(F.col("bad") == 0), F.count_if(F.col("bad") == 1)).first()
    if not kinds[0] or not kinds[1]:
        return None
    seen = [r for k in range(FOLDS) for r in scored(chosen.where(F.col("fold") == k).select("text", "bad"), "text", best_features(counts, k)).groupBy(F.round("evidence", 1).alias("e"), "bad").count().collect()]
    x, y, n = (np.array([float(r[c]) for r in seen]) for c in ("e", "bad", "count"))
    return weights, curve(x, y, n)


def curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve with a little weight decay, by Newton steps."""
    if not len(x):
        return 0.0, 1.0
    a = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + np.eye(2) * 0.1, a.T @ (n * (y - p)) - 0.1 * w)
        w += step.clip(-2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, text_col: str, weights: dict[str, float]) -> DataFrame:
    """The columns of ``docs`` without the text, and ``evidence``: texts go to Python once and don't come back."""
    text_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col) + ", evidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for batch in batches:
            evidence = [min(MOST, sum(sorted(weights[f] for f in known & features(t.as_py())))) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(evidence, pa.float64())], [*names, "evidence"])

    return docs.select(*names, text_col).mapInArrow(run, schema)


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def strength(spread: float, chance: float) -> float:
    """Prior documents for a group: p(1-p) over the variance among groups beyond chance; large if there is none."""
    return min(1e6, max(1.0, chance / spread - 1)) if spread > 1e-9 else 1e6


def site_posteriors(sites: DataFrame) -> tuple[DataFrame, float, float]:
    """From (host, path, n, s): (host, path, n, s, host_rate), the global mean, and the paths' strength.

    The variance among groups beyond chance is the mean of ((mean - prior)^2 - p(1-p)/n), weighted by documents.
    """
    hosts = sites.groupBy("host").agg(F.sum("n").alias("h_n"), F.sum("s").alias("h_s"))
    total = hosts.agg(F.sum("h_s"), F.sum("h_n")).first()
    mean = total[0] / total[1] if total[1] else 0.0
    chance = mean * (1 - mean)
    beyond = hosts.agg(F.sum(F.col("h_n") * (F.pow(F.col("h_s") / F.col("h_n") - mean, 2) - chance / F.col("h_n"))) / F.sum("h_n")).first()[0] or 0.0
    k = strength(beyond, chance)
    hosts = hosts.withColumn("host_rate", (F.col("h_s") + k * mean) / (F.col("h_n") + k))
    both = kept(sites.join(hosts.select("host", "host_rate"), "host"))
    beyond = both.agg(F.sum(F.col("n") * (F.pow(F.col("s") / F.col("n") - F.col("host_rate"), 2) - chance / F.col("n"))) / F.sum("n")).first()[0] or 0.0
    return both, mean, strength(beyond, chance)


def site(name: Column) -> Column:
    """A site's key; a null name is a site of its own, apart from the empty name."""
    return F.when(name.isNull(), "-").otherwise(F.concat(F.lit("+"), name.cast("string")))


def keys(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> list[Column]:
    """128 bits that stand for a row's id, text and site, which decide what becomes of it."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    parts = (id_.cast("string"), text, site(host), site(path))
    none = F.concat(*(F.when(x.isNull(), "0").otherwise("1") for x in parts[:2]))  # hashes pass over nulls
    return [F.xxhash64(none, *parts).alias("k1"), F.xxhash64(*reversed(parts), none).alias("k2")]


def decisions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """A narrow row for each row of ``docs``: id, evidence, site_rate, p_bad, keep, and the keys k1 and k2.

    ``labels`` has id and bad (0 or 1); a document labelled twice is bad if one label says so. Fitting takes at most
    ``sample`` labelled documents; everything else covers all rows. A labelled document's own label is part of what is
    known, and so of its evidence. Null hosts and paths are sites of their
    own, apart from empty ones. A null text counts as empty, and being empty is a feature like others. Ids may be null or repeated,
    each row is judged by itself. Without labels of both kinds nothing is known against any document: p_bad is 0 and
    all are kept. An empty table gives an empty result.

    Texts are read by the tasks that scan them and go no further: what is joined with the sites is a few numbers a row.
    """
    host = host if host is not None else F.col("source")
    path = path if path is not None else F.col("lang")
    model = fit(docs, labels, id_col, text_col, sample)
    narrow = [F.col(f"`{id_col}`").alias("id"), *keys(docs, id_col, text_col, host, path)]
    if model is None:
        return docs.select(*narrow, F.lit(0.0).alias("evidence"), F.lit(0.0).alias("site_rate"), F.lit(0.0).alias("p_bad"), F.lit(True).alias("keep"))
    weights, (a, b) = model
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence"))))
    each = kept(scored(docs.select(*narrow, site(host).alias("host"), site(path).alias("path"), F.col(f"`{text_col}`").alias("text")), "text", weights).withColumn("p", p))
    sums = kept(each.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    posteriors, mean, k = site_posteriors(sums)
    rate = (F.greatest(F.lit(0.0), F.col("s") - F.col("p")) + F.lit(k) * F.col("host_rate")) / (F.col("n") - 1 + F.lit(k))
    out = each.join(few(posteriors), ["host", "path"]).withColumn("site_rate", rate).withColumn("p_bad", 1 / (1 + F.exp(-(logit(F.col("p")) + logit(F.col("site_rate")) - logit(F.lit(mean))))))
    return out.select("id", "k1", "k2", "evidence", "site_rate", "p_bad", (F.col("p_bad") < reject).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, sample: int = SAMPLE, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that decisions() keeps. The keys of the others are broadcast up to a
    counted number of pairs of longs; beyond, rows meet them by a shuffled join."""
    host = host if host is not None else F.col("source")
    path = path if path is not None else F.col("lang")
    rejected = kept(decisions(docs, labels, id_col, text_col, host, path, sample, reject).where(~F.col("keep")).select(F.col("k1").alias("r1"), F.col("k2").alias("r2")).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *keys(docs, id_col, text_col, host, path))
    return rows.join(few(rejected, limit=REJECTED), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left_anti").select("row.*")


def bad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table: bad is low quality or toxic."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decisions(table(spark, sf_dir, "documents"), bad_labels(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.round("evidence", 6).alias("evidence"), F.round("site_rate", 6).alias("site_rate"), F.round("p_bad", 6).alias("p_bad"), "keep")
