"""Claims of documents held against facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HAN = r"[\x{4e00}-\x{9fff}]"
# What counts as a claim.
QUOTED = '"([^"]{8,})"'
ITEM = r"-\s+\*\*(.+?)\*\*[：:]\s*([^\n]+)"


def claims(documents: DataFrame) -> DataFrame:
    """(doc, kind, claim) of texts: what is quoted, and list items with a bold title and some detail."""
    quoted = documents.select("doc", F.lit("quoted").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1))).alias("claim"))
    titles, details = F.regexp_extract_all("text", F.lit(ITEM), F.lit(1)), F.regexp_extract_all("text", F.lit(ITEM), F.lit(2))
    items = documents.select("doc", F.explode(F.arrays_zip(titles.alias("t"), details.alias("d"))).alias("i")).where(F.length("i.d") > 5)
    return quoted.unionByName(items.select("doc", F.lit("list_item").alias("kind"), F.concat(F.col("i.t"), F.lit(": "), F.substring("i.d", 1, 80)).alias("claim")))


def tokens(text: Column, longest: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({HAN}{{2,{longest}}})"), F.lit(1))


def claim_match(claimed: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, fact_id, hits): how many of a claim's words are words of a fact; repeats in the claim count."""
    index = facts.select("fact_id", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "source_content", "object"), 4))).alias("word"))
    words = claimed.select("claim_id", F.explode(tokens(F.col("claim"), 6)).alias("word"))
    return words.join(index, "word").groupBy("claim_id", "fact_id").agg(F.count("*").alias("hits"))


def verify_claims(claimed: DataFrame, facts: DataFrame, top: int = 3) -> DataFrame:
    """(claim_id, status, fact_ids): the best facts of a claim; VERIFIED if the expected subject is in one of
    their subjects, MISATTRIBUTED if in none, PARTIAL if none is expected, UNVERIFIED without facts."""
    w = Window.partitionBy("claim_id").orderBy(F.desc("hits"), "fact_id")
    best = claim_match(claimed, facts).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).join(facts.select("fact_id", "subject"), "fact_id")
    held = claimed.select("claim_id", "expected").join(best, "claim_id", "left")
    fits = F.col("subject").contains(F.col("expected"))
    g = held.groupBy("claim_id", "expected").agg(F.count("fact_id").alias("n"), F.count_if(fits).alias("fit"), F.sort_array(F.collect_list(F.when(F.col("expected").isNull() | fits, F.col("fact_id")))).alias("fitting"), F.sort_array(F.collect_list("fact_id")).alias("all"))
    status = F.when(F.col("n") == 0, "UNVERIFIED").when(F.col("expected").isNull(), "PARTIAL").when(F.col("fit") > 0, "VERIFIED").otherwise("MISATTRIBUTED")
    return g.select("claim_id", status.alias("status"), F.when(F.col("fit") > 0, F.col("fitting")).otherwise(F.col("all")).alias("fact_ids"))


def verify_stats(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count("*").alias("n"))
