"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). The budget goes down the tree: a node's children share it by their weights,
but none gets more than its subtree can take (its tokens times ``epochs``, without what weighs nothing); what a child can't use is shared again
among its siblings, by weight, until it is used or all are full. As a child is full only when its whole subtree
is, a shortage is made up among siblings before it reaches the level above.

Sharing is in closed form. With children in the order of capacity / weight, those are full whose ratio times the
weights from there on, plus the capacities before, is within the budget; the others share the rest by weight.

A leaf's documents are put in a seeded order, anew for each epoch. A leaf takes whole epochs while its budget lasts
and of the next the longest prefix of documents whose tokens fit. The order is a hash, so a prefix is all hashes
up to one: token sums by the hash's first digits find the digits in which the budget ends, and only there
documents are summed one by one. So no leaf is sorted as a whole, and texts are neither shuffled nor sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.common import BROADCAST_ROWS, few, kept, table

LEVELS = ("domain", "lang", "source")
SEED, SHARE, EPOCHS = 17, 0.7, 2
#: Documents that should meet where a leaf's budget ends.
SPREAD = 2_000

#: The target weights of op8: domain, language or null, source or null, weight. What isn't listed weighs 1.
WEIGHTS = (("d0", None, None, 4.0), ("d1", None, None, 3.0), ("d2", None, None, 2.0), ("d3", None, None, 1.0), ("d0", "en", None, 2.0), ("d1", "de", None, 3.0), ("d2", "fr", None, 0.5), ("d3", "es", None, 0.0), ("d1", "en", "src1", 5.0))


def text_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def source_domain(source: Column) -> Column:
    """d0 to d3: the source's number modulo four; d0 without a number."""
    return F.concat(F.lit("d"), (F.coalesce(F.regexp_extract(source, r"(\d{1,9})", 1).try_cast("bigint"), F.lit(0)) % 4).cast("string"))


def shared(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``given`` to rows (parent columns, node, capacity, weight, budget): each child's part of its parent's budget."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight"))
    order = Window.partitionBy(*parent).orderBy(F.asc_nulls_last("ratio"), "node")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    sized = children.withColumn("ratio", ratio).withColumn("before", before).withColumn("left", left)
    full = sized.withColumn("full", F.col("ratio").isNotNull() & (F.col("before") + F.col("ratio") * F.col("left") <= F.col("budget")))
    # the first child that isn't full sets the level for all behind it
    first = F.first(F.when(~F.col("full") & F.col("ratio").isNotNull(), (F.col("budget") - F.col("before")) / F.col("left")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    given = F.when(F.col("ratio").isNull(), 0.0).when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * F.col("level"))
    return full.withColumn("level", first).withColumn("given", given).drop("ratio", "before", "left", "full", "level")


def budgets(leaves: DataFrame, weights: DataFrame, total: float, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, given): each leaf's whole tokens to take."""
    listed = weights.groupBy(*LEVELS).agg(F.max("weight").alias("weight"))
    d, la, s = LEVELS
    def weighed(df: DataFrame, *named: str) -> DataFrame:
        right = listed
        for level in LEVELS:
            right = right.where(F.col(level).isNotNull() if level in named else F.col(level).isNull())
        return df.join(right.select(*named, "weight"), list(named), "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))

    def able() -> Column:
        """What weighs nothing takes nothing, so it adds nothing to what its parent can take."""
        return F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0).alias("capacity")

    low = weighed(leaves.select(*LEVELS, "tokens", (F.col("tokens") * epochs).cast("double").alias("capacity")), d, la, s).select(*LEVELS, "tokens", "weight", able())
    mid = weighed(low.groupBy(d, la).agg(F.sum("capacity").alias("capacity")), d, la).select(d, la, "weight", able())
    high = weighed(mid.groupBy(d).agg(F.sum("capacity").alias("capacity")), d).select(d, "weight", able())
    top = shared(high.withColumn("budget", F.lit(float(total))).withColumn("root", F.lit(0)).withColumn("node", F.col(d)), ["root"])
    middle = shared(mid.join(top.select(d, F.col("given").alias("budget")), d).withColumn("node", F.col(la)), [d])
    bottom = shared(low.join(middle.select(d, la, F.col("given").alias("budget")), [d, la]).withColumn("node", F.col(s)), [d, la])
    return bottom.select(*LEVELS, "tokens", F.floor(F.col("given") + 1e-6).cast("bigint").alias("given"))


def place(epoch: Column, id_: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("null"))))


def decisions(docs: DataFrame, weights: DataFrame, id_: Column, levels: dict[str, Column], tokens: Column, share: float, epochs: int, seed: int) -> tuple[DataFrame, int]:
    """(domain, lang, source, given, whole, last): whole epochs to take, and the last hash to take of the next
    (null for none); and the number of leaves."""
    rows = kept(docs.select(id_.alias("id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()), tokens.alias("n")))
    leaves = kept(rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")))
    total, most, n = leaves.agg(F.sum("tokens"), F.max("rows"), F.count("*")).first()
    given = kept(budgets(leaves, weights, share * (total or 0), epochs).withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(0).cast("int")))
    rest = given.withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens")).where("rest > 0").select(*LEVELS, "whole", "rest")
    digits = max(1, math.ceil(math.log(max(1, (most or 1) / SPREAD), 16)))
    placed = rows.join(few(rest, n), list(LEVELS)).withColumn("hash", place(F.col("whole"), F.col("id"), seed)).withColumn("part", F.substring("hash", 1, digits))
    parts = placed.groupBy(*LEVELS, "rest", "part").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*LEVELS).orderBy("part")
    ends = parts.withColumn("upto", F.sum("n").over(along)).withColumn("before", F.col("upto") - F.col("n"))
    inside = ends.where(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("part").alias("part")).select(*LEVELS, F.concat("part", F.lit("g")).alias("last"))
    broken = kept(ends.where((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest"))).select(*LEVELS, "part", "before"))
    there = placed.join(few(broken, n), [*LEVELS, "part"]).groupBy(*LEVELS, "part", "before", "rest", "hash").agg(F.sum("n").alias("n"))
    sums = there.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS, "part").orderBy("hash")))
    exact = sums.where(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("hash").alias("last"))
    last = inside.union(exact).groupBy(*LEVELS).agg(F.max("last").alias("last"))
    return kept(given.join(last, list(LEVELS), "left").select(*LEVELS, "given", "whole", "last")), n


def mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", domain: Column | None = None, lang: Column | None = None, source: Column | None = None, tokens: Column | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` to take, as often as epochs take them, with all their columns in a struct ``row``, and
    domain_, lang_, source_, epoch, n_tokens.

    ``share`` of all tokens is the budget; ``weights`` has domain, lang, source, weight, with nulls below
    the level that a row is about; what isn't listed or has a null weight weighs 1, a weight of zero or less takes nothing. Null levels
    count as empty names, null texts as no tokens. Rows of a leaf with the same id stand at the same place and are
    taken together or not at all; null ids are one id. Documents of no tokens go with the prefix that they stand
    in. An empty table gives an empty result. Each leaf takes at most its budget, and the next document in order
    would not have fitted.
    """
    id_ = F.col(f"`{id_col}`")
    levels = dict(zip(LEVELS, (domain if domain is not None else source_domain(F.col("source")), lang if lang is not None else F.col("lang"), source if source is not None else F.col("source")), strict=True))
    tokens = tokens if tokens is not None else text_tokens(F.col("text"))
    weights = weights.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)))
    taken, n = decisions(docs, weights, id_, levels, tokens, share, epochs, seed)
    named = [id_.alias("id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items())]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), tokens.alias("n_tokens"), *named)
    in_part = F.coalesce(place(F.col("whole"), F.col("id"), seed) <= F.col("last"), F.lit(False))
    count = (F.col("whole") + in_part.cast("int")).alias("times")
    if n <= BROADCAST_ROWS:
        counted = row.join(F.broadcast(taken), list(LEVELS)).select("*", count)
    else:  # leaves meet ids first, as rows with their texts would gather by leaf; what is taken of a leaf comes by keys of its own
        keys = [F.xxhash64("id", *LEVELS).alias("k1"), F.xxhash64(*LEVELS, "id", F.lit(1)).alias("k2")]
        times = docs.select(*named).join(taken, list(LEVELS)).select(*keys, count).where("times > 0").distinct()
        counted = row.select("*", *keys).join(times, ["k1", "k2"])
    out = counted.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return out.select("row", *(F.col(k).alias(f"{k}_") for k in LEVELS), "epoch", "n_tokens")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame(list(WEIGHTS), "domain string, lang string, source string, weight double")
    out = mix(table(spark, sf_dir, "documents"), weights)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("domain_").alias("domain"), F.col("lang_").alias("lang"), F.col("source_").alias("source"), "epoch", "n_tokens")


def share_sql(name: str, parent: str, node: str, rows: str) -> str:
    """The closed form in SQL: ``rows`` gives parent columns, node, capacity, weight, budget."""
    order = f"PARTITION BY {parent} ORDER BY ratio NULLS LAST, {node}"
    return f"""
{name}_r AS (SELECT *, CASE WHEN weight > 0 THEN capacity / weight END AS ratio FROM ({rows})),
{name}_s AS (SELECT *, coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM {name}_r),
{name}_f AS (SELECT *, ratio IS NOT NULL AND before + ratio * rest_w <= budget AS is_full FROM {name}_s),
{name}_l AS (SELECT *, first_value(CASE WHEN NOT is_full AND ratio IS NOT NULL THEN (budget - before) / rest_w END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM {name}_f),
{name} AS (SELECT *, CASE WHEN ratio IS NULL THEN 0 WHEN is_full THEN capacity ELSE weight * level END AS given FROM {name}_l)"""


def mixing_sql(documents: str = "documents", share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in w) + ")" for w in WEIGHTS)
    return (
        f"""
WITH w(domain, lang, source, weight) AS (VALUES {values}),
docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})', 1) AS BIGINT), 0) % 4) AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens FROM {documents}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE * {epochs} AS capacity FROM docs GROUP BY ALL),"""
        + share_sql("top", "root", "domain", f"SELECT 0 AS root, l.domain, l.capacity, coalesce(w.weight, 1) AS weight, (SELECT sum(tokens) FROM leaf) * {share} AS budget FROM (SELECT domain, sum(capacity) AS capacity FROM leaf GROUP BY ALL) l LEFT JOIN w ON w.domain = l.domain AND w.lang IS NULL")
        + ","
        + share_sql("mid", "domain", "lang", "SELECT l.*, coalesce(w.weight, 1) AS weight, top.given AS budget FROM (SELECT domain, lang, sum(capacity) AS capacity FROM leaf GROUP BY ALL) l JOIN top ON top.domain = l.domain LEFT JOIN w ON w.domain = l.domain AND w.lang = l.lang AND w.source IS NULL")
        + ","
        + share_sql("low", "domain, lang", "source", "SELECT l.*, coalesce(w.weight, 1) AS weight, mid.given AS budget FROM leaf l JOIN mid ON mid.domain = l.domain AND mid.lang = l.lang LEFT JOIN w ON w.domain = l.domain AND w.lang = l.lang AND w.source = l.source")
        + f""",
cut AS (SELECT domain, lang, source, tokens, floor(given + 1e-6) AS given, CASE WHEN tokens > 0 THEN CAST(floor(floor(given + 1e-6) / tokens) AS INTEGER) ELSE 0 END AS whole FROM low),
placed AS (SELECT d.*, c.whole, c.given - c.whole * c.tokens AS rest, md5('{seed}|' || c.whole || '|' || d.doc_id) AS h FROM docs d JOIN cut c ON d.domain = c.domain AND d.lang = c.lang AND d.source = c.source),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM placed),
times AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, domain, lang, source, CAST(unnest(range(0, times)) AS INTEGER) AS epoch, n_tokens FROM times
"""
    )


OP8_SQL = mixing_sql()
