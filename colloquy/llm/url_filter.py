"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join. DataFrame operations only.

A listed URL is a host with a path prefix. What of a page's URL could be listed is: one of its host's suffixes,
joined to one of its path's prefixes with a length that occurs in the list. These candidates are looked up in the
filter by the tasks that read the pages; only possible hits go on to the exact join on the whole string, which removes what the filter let
through by mistake. The filter never misses a listed URL, so the result is exact.

A block has 512 bits in eight longs, and a key sets one bit in each of them, from one 64-bit hash. With
``bits`` = 16 bits for each key, about one unlisted candidate in 500 passes. A filter of up to ``LONGS`` longs is part of the
plan, so that pages don't move for it; a larger one stays a table that candidates meet by block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import few, kept, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: Longs of a filter that goes into the plan (half a megabyte, some 260,000 listed URLs).
LONGS = 65_536

#: The listed rules of op2: host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The canonical host and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bit(key: Column, i: int) -> Column:
    """A long with the one bit that a key sets in the i-th long of its block: six bits of a hash choose it."""
    at = F.shiftrightunsigned(F.xxhash64(key, F.lit("bloom")), 6 * i).bitwiseAND(F.lit(63))
    return F.element_at(F.array(*(F.lit(1 << j if j < 63 else -(2**63)) for j in range(64))), at.cast("int") + 1)


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter's blocks that have any bit; its size is bounded by ``blocks``."""
    return listed.groupBy(block_of(F.col(key), blocks).alias("block")).agg(*(F.bit_or(bit(F.col(key), i)).alias(f"w{i}") for i in range(WORDS)))


def literal(filter_: DataFrame, blocks: int) -> Column:
    """All longs of a filter of bounded size, block by block, as one constant."""
    longs = [0] * (blocks * WORDS)
    for r in filter_.collect():
        longs[r["block"] * WORDS : (r["block"] + 1) * WORDS] = r[1:]
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<bigint>")


def inside(words: list[Column], key: Column) -> Column:
    """Whether a block's longs have all bits of a key."""
    out = F.lit(True)
    for i, word in enumerate(words):
        out = out & (word.bitwiseAND(bit(key, i)) != 0)
    return out


def url_verdicts(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits: int = 16) -> DataFrame:
    """A row for each row of ``pages``: id, host, path, rule, verdict.

    ``listed`` has host, path, verdict; a rule fits its host and all its subdomains where the URL's path starts
    with the rule's, and the longest fitting rule wins (among equally long ones the longest host). A rule listed
    twice with both verdicts blocks; rules with a null or empty host are ignored, a null path is an empty one.
    Without a fitting rule the verdict is ``default``: nothing listed holds the URL. Null and malformed URLs have
    empty host and path and fit no rule. Ids may be null or repeated. An empty list lets everything through; an
    empty table gives an empty result.

    Rows without a possible hit stay where they were read. The others meet the list by key, each row by itself, so a URL or
    host with very many pages is no hot key but in a join that can be split. The list is broadcast only up to a counted number of rows.
    """
    rules = kept(
        listed.where(F.coalesce(F.col("host"), F.lit("")) != "")
        .select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule_key", F.concat_ws("\n", "rule_host", "rule_path"))
    )
    host, path = host_and_path(F.col(f"`{url_col}`"))
    narrow = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    n, lengths = rules.agg(F.count("*"), F.collect_set(F.length("rule_path"))).first()
    if not n:
        return narrow.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = max(1, math.ceil(n * bits / (64 * WORDS)))
    parts = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    prefixes = F.array_distinct(F.transform(F.filter(F.array(*(F.lit(x) for x in sorted(lengths))), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k)))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat_ws("\n", s, p))))
    filter_ = bloom(rules, "rule_key", blocks)
    if blocks * WORDS <= LONGS:
        longs = literal(filter_, blocks)

        def passes(key: Column) -> Column:
            first = block_of(key, blocks).cast("int") * WORDS
            return inside([F.element_at(longs, first + i + 1) for i in range(WORDS)], key)

        looked_up = kept(narrow.withColumn("row", F.monotonically_increasing_id()).withColumn("keys", F.filter(candidates, passes)))
        possible = looked_up.where(F.size("keys") > 0)
        rest = looked_up.where(F.size("keys") == 0)
        hits = possible.select("row", F.explode("keys").alias("rule_key"))
    else:
        possible = kept(narrow.withColumn("row", F.monotonically_increasing_id()))
        rest = possible.limit(0)
        each = possible.select("row", F.explode(candidates).alias("rule_key")).withColumn("block", block_of(F.col("rule_key"), blocks))
        hits = each.join(filter_, "block").where(inside([F.col(f"w{i}") for i in range(WORDS)], F.col("rule_key"))).select("row", "rule_key")
    best = hits.join(few(rules, n), "rule_key").groupBy("row").agg(
        F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best")
    )
    found = possible.join(best, "row", "left").select("id", "host", "path", "best").unionByName(rest.select("id", "host", "path"), allowMissingColumns=True)
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


OP2_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT p.rid, u.host || u.path AS rule, u.verdict,
    row_number() OVER (PARTITION BY p.rid ORDER BY length(u.host || u.path) DESC, length(u.host) DESC) AS k
    FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON p.rid = f.rid AND f.k = 1
"""
