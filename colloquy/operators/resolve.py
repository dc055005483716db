"""Entity resolution: name rules, blocked candidates, graph evidence, identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.operators.components import components, durable

HAN = r"\x{4e00}-\x{9fff}"


def normalize_name(name: Column, suffixes: Sequence[str] = lex.HONORIFICS) -> Column:
    """Without the first suffix of the list that the name ends in and is longer than."""
    out = name
    for s in reversed(suffixes):
        out = F.when(name.endswith(s) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def is_abbreviation(name: Column) -> Column:
    return F.lower(name).rlike("^[a-z]{2,4}$")


def initials(name: Column, table: Mapping[str, str] = lex.INITIALS) -> Column:
    """Each character's initial; a character that the table lacks stands for itself in lower case."""
    return F.lower(F.translate(name, "".join(table), "".join(table.values())))


#: What the rules look at in a name, computed once for each name and not for each pair.
FEATURES = ("n", "han", "bare", "initials", "short", "titled")


def described(rows: DataFrame, name: str, prefix: str, titles: Sequence[str] = lex.TITLES, suffixes: Sequence[str] = lex.HONORIFICS, table: Mapping[str, str] = lex.INITIALS) -> DataFrame:
    """``rows`` with the features of a name column, each named by the prefix: the normalised name, its Han characters,
    it without letters at its end, its initials, whether it is an abbreviation, whether the name holds a title."""
    n = f"{prefix}n"
    return rows.withColumn(n, normalize_name(F.col(name), suffixes)).withColumns(
        {
            f"{prefix}han": F.length(F.regexp_replace(n, f"[^{HAN}]", "")),
            f"{prefix}bare": F.regexp_replace(n, "[a-zA-Z]+$", ""),
            f"{prefix}initials": initials(F.col(n), table),
            f"{prefix}short": is_abbreviation(F.col(n)),
            f"{prefix}titled": any_contains(F.col(name), titles),
        }
    )


def rule(a: str = "a_", b: str = "b_") -> Column:
    """struct(confidence, reason) of the first rule that two described names meet; null if none does."""
    f = {k: (F.col(a + k), F.col(b + k)) for k in FEATURES}
    (n1, n2), (h1, h2) = f["n"], f["han"]
    l1, l2 = F.length(n1), F.length(n2)
    held = (n1.contains(n2) | n2.contains(n1)) & (F.when(l1 < l2, h1).otherwise(h2) >= 2) & (F.greatest(l1, l2) <= 3 * F.least(l1, l2))
    both = (h1 > 0) & (h2 > 0)

    def abbreviates(x: int, y: int) -> Column:
        return f["short"][x] & (F.length(f["n"][y]) >= 2) & (l1 == l2) & (f["initials"][y] == F.lower(f["n"][x]))

    def hit(confidence: float, *reason: Column | str) -> Column:
        return F.struct(F.lit(confidence).alias("confidence"), F.concat(*(F.lit(r) if isinstance(r, str) else r for r in reason)).alias("reason"))

    return (
        F.when(n1 == n2, hit(1.0, "identical"))
        .when(held, hit(0.85, "substring"))
        .when(both & (f["bare"][0] == f["bare"][1]), hit(0.95, "name+title"))
        .when(abbreviates(0, 1), hit(0.9, "abbrev:", n1, "→", n2))
        .when(abbreviates(1, 0), hit(0.9, "abbrev:", n2, "→", n1))
        .when(both & (F.substring(n1, 1, 1) == F.substring(n2, 1, 1)) & ((f["titled"][0] & (l2 <= 3)) | (f["titled"][1] & (l1 <= 3))), hit(0.7, "surname+title"))
    )


def rule_match(pairs: DataFrame, e1: str = "e1", e2: str = "e2", **lists) -> DataFrame:
    """(e1, e2, confidence, reason) of the pairs that meet a rule."""
    both = described(described(pairs, e1, "a_", **lists), e2, "b_", **lists)
    return both.withColumn("_m", rule()).where(F.col("_m").isNotNull()).select(e1, e2, "_m.*")


def any_contains(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def candidates(names: DataFrame, table: Mapping[str, str] = lex.INITIALS, **lists) -> DataFrame:
    """(e1 < e2, confidence, reason) of all pairs that meet a rule.

    Pairs come from blocks, not from the product of all names: equal normalised names or names without letters at their
    end, equal initials (an abbreviation is its own), for the substring rule the first two characters of one name anywhere
    in the other, and for the title rule equal first characters of a titled name and one of up to three characters. So
    names with a common surname or a common pair of characters don't all meet each other. Every pair that meets a rule shares one of these.
    """
    e = durable(described(names.select(F.col("name")).where(F.length("name") > 0).distinct(), "name", "_", table=table, **lists))  # read from eight places
    whole = F.when(F.col("_bare") == "", F.col("_n")).otherwise(F.col("_bare"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_n") - 1), lambda i: F.substr(F.col("_n"), i, F.lit(2))))
    surname = F.substring("_n", 1, 1)

    def met(first: DataFrame, key: Column, second: DataFrame, other: Column) -> DataFrame:
        return first.select(key.alias("_key"), F.col("name").alias("x")).join(second.select(other.alias("_key"), F.col("name").alias("y")), "_key").where("x <> y")

    long = e.where(F.length("_n") >= 2)
    blocks = (met(e, whole, e, whole), met(e, F.col("_initials"), e, F.col("_initials")), met(long, F.explode(pairs), long, F.substring("_n", 1, 2)), met(e.where("_titled"), surname, e.where(F.length("_n") <= 3), surname))
    ends = [found.select(F.least("x", "y").alias("a_name"), F.greatest("x", "y").alias("b_name")) for found in blocks]
    each = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct()
    for side in ("a_", "b_"):  # the features come to what is left
        each = each.join(e.select(F.col("name").alias(f"{side}name"), *(F.col(f"_{f}").alias(f"{side}{f}") for f in FEATURES)), f"{side}name")
    held = each.withColumn("_m", rule()).where(F.col("_m").isNotNull())
    return held.select(F.col("a_name").alias("e1"), F.col("b_name").alias("e2"), "_m.*")


def confirmed(found: DataFrame, structure: DataFrame, threshold: float = 0.75, least: float = 0.3, confirm=None) -> DataFrame:
    """(e1, e2, confidence, reason): 0.7 rule + 0.3 structure, kept from the threshold on or where structure alone
    is above ``least``. With ``confirm`` (a function of rows to rows of e1, e2, same, llm_confidence), pairs under
    0.85 need it, and those under the threshold are dropped."""
    joined = found.join(structure.select(F.col("p1").alias("e1"), F.col("p2").alias("e2"), F.col("jaccard").alias("_j")), ["e1", "e2"], "left").withColumn("_j", F.coalesce("_j", F.lit(0.0)))
    c = F.col("_c")
    both = joined.withColumn("_c", 0.7 * F.col("confidence") + 0.3 * F.col("_j")).where((c >= threshold) | (F.col("_j") > least))
    kept = both.select("e1", "e2", F.round(c, 6).alias("confidence"), F.when((c < threshold) & (F.col("_j") > least), F.concat("reason", F.lit("+graph"))).otherwise(F.col("reason")).alias("reason"))
    if confirm is None:
        return kept
    sure, ask = kept.where("confidence >= 0.85"), kept.where((F.col("confidence") >= threshold) & (F.col("confidence") < 0.85))
    said = ask.join(confirm(ask), ["e1", "e2"]).where("same and llm_confidence >= 0.6")
    return sure.unionByName(said.select("e1", "e2", ((F.col("confidence") + F.col("llm_confidence")) / 2).alias("confidence"), "reason"))


def identities(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(member, identity): groups of linked names, named after the member with most mentions, ties to the smaller name."""
    roots = components(pairs.select(F.col("e1").alias("src"), F.col("e2").alias("dst")))
    members = roots.select(F.col("node").alias("member"), "root").union(roots.select(F.col("root").alias("member"), "root")).distinct()
    counted = members.join(counts.select(F.col("name").alias("member"), "n"), "member", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    top = counted.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("less"), "member")).alias("_t"))
    return members.join(top.select("root", F.col("_t.member").alias("identity")), "root").select("member", "identity")


def identity_aliases(same_as: DataFrame, asked: str) -> DataFrame:
    """Identities of which a member or the name holds the asked name, with all members."""
    hit = same_as.where(F.col("member").contains(asked) | F.col("identity").contains(asked)).select("identity").distinct()
    return same_as.join(hit, "identity", "left_semi").groupBy("identity").agg(F.sort_array(F.collect_set("member")).alias("members"))
