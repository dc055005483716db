"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.
DataFrame operations only.

Words are runs of a-z and 0-9 after lower-casing A-Z; shingles are three words, as the shortest notices have no
more. Templates are put in classes by size: class S takes those of over S/2 and up to S shingles (S a power of
two), and looks at windows of 2S shingle positions, one every S, so a passage of up to S + 1 positions lies in
one window. A shingle that no template of a class has can't be the smallest of a template's there, so windows are hashed over the
shingles that some template of the class has; that only raises the similarity to a template.

Bands have one row each. A window W that holds 0.8 of a template T has a Jaccard similarity of at least
0.8 |T| / (2S + 0.2 |T|) > 0.19 to it, so that none of 48 bands meets has a chance under 0.81^48 = 4e-5.
What a band retrieves is kept if the window holds at least ``containment`` of the template's distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import few, kept, table
from colloquy.llm.license_texts import TEMPLATES
from colloquy.llm.url_filter import LOWER, UPPER

BANDS, CONTAINMENT = 48, 0.8

def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def shingles(column: str) -> Column:
    """Hashes of the three-word shingles of an array column of words, in order; none for fewer words."""
    w = F.col(column)
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))


def signature(shingle: str) -> list[Column]:
    return [F.min(F.xxhash64(shingle, F.lit(i))).alias(f"band_{i}") for i in range(BANDS)]


def banded(signed: DataFrame, *keys: str) -> DataFrame:
    """A row for each band: (keys, band), band a hash of its number and value."""
    bands = F.array(*(F.xxhash64(F.lit(i), f"band_{i}") for i in range(BANDS)))
    return signed.select(*keys, F.explode(bands).alias("band"))


def license_scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, first_word): each license that a row of ``docs`` holds, with the share of its
    shingles in the best window and the first word of the earliest window that has that share.

    ``templates`` has license and text; those of under three words or null are ignored, and a license may have
    several wordings (the best one counts). Null and empty texts hold none. Rows with null or repeated ids are
    scanned one by one. Empty tables give an empty result. Rows without a license aren't returned.

    The templates' shingles are broadcast up to a counted number; beyond that the joins are shuffled.
    """
    sized = templates.select("license", words(F.col("text")).alias("w")).select("license", F.array_distinct(shingles("w")).alias("s")).where("s is not null")
    wordings = kept(sized.withColumn("template", F.monotonically_increasing_id()).withColumn("n", F.size("s")).withColumn("class", F.pow(2, F.ceil(F.log2(F.size("s")))).cast("int")))
    each = kept(wordings.select("template", "license", "n", "class", F.explode("s").alias("shingle")))
    known = kept(each.groupBy("shingle").agg(F.collect_set("class").alias("classes")))  # a class for each power of two
    n = known.count()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(f"`{text_col}`")).alias("w"))
    found = rows.select("id", "row", F.posexplode(shingles("w")).alias("pos", "shingle"))
    hits = kept(found.join(few(known, n), "shingle"))
    one = hits.select("id", "row", "pos", "shingle", F.explode("classes").alias("class"))
    at = one.withColumn("window", F.explode(F.array(*((F.floor(F.col("pos") / F.col("class")) - k) for k in (0, 1)))))
    windows = at.groupBy("row", "class", "window").agg(*signature("shingle"))
    retrieved = banded(windows, "row", "class", "window").join(few(banded(each.groupBy("template", "class").agg(*signature("shingle")), "template", "class"), BANDS * n), ["class", "band"])
    candidates = retrieved.select("row", "class", "window", "template").distinct()
    inside = at.join(candidates, ["row", "class", "window"]).join(few(each.select("template", "license", "n", "shingle"), each.count()), ["template", "shingle"])
    held = inside.groupBy("id", "row", "license", "template", "window").agg((F.count_distinct("shingle") / F.first("n")).alias("share"), F.min("pos").cast("bigint").alias("first_word")).where(F.col("share") >= containment)
    best = held.groupBy("id", "row", "license").agg(F.min(F.struct((-F.col("share")).alias("less"), F.col("first_word"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "license", (-F.col("best.less")).alias("containment"), F.col("best.first_word").alias("first_word"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), spark.createDataFrame(list(TEMPLATES), "license string, text string"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP10_SQL = (
    """
WITH templates(template, license, text) AS (VALUES """
    + ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))
    + """),
t_words AS (SELECT template, license, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM templates),
t_shingles AS (SELECT DISTINCT template, license, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS shingle FROM t_words),
t AS (SELECT *, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS class FROM (SELECT *, count(*) OVER (PARTITION BY template) AS n FROM t_shingles)),
d_words AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
d AS (SELECT doc_id, r, unnest(range(0, len(w) - 2)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS shingle FROM d_words),
hits AS (SELECT doc_id, r, pos, shingle, template, license, n, pos // class - back AS win FROM d JOIN t USING (shingle) CROSS JOIN (VALUES (0), (1)) AS b(back)),
held AS (SELECT doc_id, r, template, license, win, count(DISTINCT shingle) / any_value(n) AS share, min(pos) AS first_word FROM hits GROUP BY ALL HAVING share >= 0.8)
SELECT doc_id, license, max(share) AS containment, arg_min(first_word, (-share, first_word)) AS first_word FROM held GROUP BY doc_id, r, license
"""
)
