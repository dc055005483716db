"""Graph measures on edge tables: degree, PageRank, communities, modularity, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.components import durable


def degree_share(messages: DataFrame, top: int = 20) -> DataFrame:
    """The most active people; share among those, and among all."""
    n = messages.groupBy("sender").agg(F.count("*").alias("msg_count"))
    whole = n.agg(F.sum("msg_count")).scalar()
    first = n.orderBy(F.desc("msg_count"), "sender").limit(top)
    among = first.agg(F.sum("msg_count")).scalar()
    return first.select("sender", "msg_count", F.round(F.col("msg_count") / among, 6).alias("share"), F.round(F.col("msg_count") / whole, 6).alias("true_share"))


def message_counts(people: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of everyone, zeros included."""
    n = messages.groupBy(F.col("sender").alias("name")).agg(F.count("*").alias("_n"))
    return people.join(n, "name", "left").select("name", F.coalesce("_n", F.lit(0)).alias("msg_count"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def pagerank(edges: DataFrame, directed: bool = False, damping: float = 0.85, rounds: int = 20, every: int = 5) -> DataFrame:
    """(node, score) after fixed rounds of (1 - d) + d sum(score weight / out weight), not normalised.

    Edges have src, dst, weight; each edge goes both ways unless ``directed``. A round is one join and one
    aggregation by node; lineage is cut every few rounds.
    """
    e = (edges if directed else both_ways(edges)).where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    links = durable(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("part")))
    nodes = durable(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    ranks = nodes.withColumn("score", F.lit(1 - damping))
    for i in range(rounds):
        got = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("score") * F.col("part")).alias("_in"))
        ranks = nodes.join(got, F.col("node") == F.col("dst"), "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("_in", F.lit(0.0))).alias("score"))
        if (i + 1) % every == 0:
            ranks = durable(ranks)
    return ranks


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Newman's modularity of undirected weighted edges for (node, community)."""
    e = both_ways(edges).where("weight > 0")
    a = communities.select(F.col("node").alias("src"), F.col("community").alias("c1"))
    b = communities.select(F.col("node").alias("dst"), F.col("community").alias("c2"))
    row = e.join(a, "src").join(b, "dst").groupBy("c1").agg(F.sum("weight").alias("t"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("weight")).otherwise(0.0)).alias("i"))
    m2 = e.agg(F.sum("weight")).first()[0]
    if not m2:
        return 0.0
    return row.agg(F.sum(F.col("i") / m2 - F.pow(F.col("t") / m2, 2))).first()[0] or 0.0


def louvain(edges: DataFrame, levels: int = 2, rounds: int = 4) -> DataFrame:
    """(node, community) by local moves and aggregation.

    In a round half of the nodes (by a hash of node and round) move to the neighbouring community with the
    largest gain in modularity, ties to the smaller one; as not all move at once, neighbours don't swap for ever.
    A level ends when nothing moves; its communities are the next level's nodes. Deterministic for given edges.
    """
    e = durable(both_ways(edges).where("weight > 0 and src <> dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    m2 = e.agg(F.sum("weight")).first()[0]
    nodes = e.select(F.col("src").alias("node")).distinct()
    if not m2:
        return nodes.withColumn("community", F.col("node"))
    own = durable(nodes.withColumn("community", F.col("node")))
    for _ in range(levels):
        degree = durable(e.groupBy("src").agg(F.sum("weight").alias("k")).withColumnRenamed("src", "node"))
        place = durable(degree.select("node", F.col("node").alias("c")))
        changed = 0
        for r in range(rounds):
            sums = place.join(degree, "node").groupBy("c").agg(F.sum("k").alias("s"))
            to = e.where("src <> dst").join(place.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("weight").alias("w"))
            here = place.select("node", F.col("c").alias("now")).join(degree, "node")
            choice = to.unionByName(place.select("node", "c", F.lit(0.0).alias("w"))).groupBy("node", "c").agg(F.sum("w").alias("w")).join(sums, "c").join(here, "node")
            rest = F.col("s") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("w") - F.col("k") * rest / m2, 9)
            best = choice.groupBy("node", "now").agg(F.max(F.struct(gain.alias("g"), (F.col("c") == F.col("now")).alias("stay"))).alias("top"), F.min(F.struct((-gain).alias("less"), F.col("c").alias("c"))).alias("low"))
            target = F.col("low.c")  # of the largest gain's communities the smallest
            turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
            moved = durable(best.select("node", "now", F.when(turn & ~F.col("top.stay"), target).otherwise(F.col("now")).alias("c")))
            n = moved.where("c <> now").count()
            changed += n
            place = moved.select("node", "c")
            if not n and r:
                break
        if not changed:
            break
        own = durable(own.join(place.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")))
        a, b = place.select(F.col("node").alias("src"), F.col("c").alias("a")), place.select(F.col("node").alias("dst"), F.col("c").alias("b"))
        e = durable(e.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
    smallest = own.groupBy("community").agg(F.min("node").alias("_c"))
    return own.join(smallest, "community").select("node", F.col("_c").alias("community"))


def communities(assigned: DataFrame, members: int = 10) -> DataFrame:
    """Communities by size, with a few members."""
    sizes = assigned.groupBy("community").agg(F.count("*").alias("size"))
    first = assigned.withColumn("_k", F.row_number().over(Window.partitionBy("community").orderBy("node"))).where(F.col("_k") <= members)
    return sizes.join(first.groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members")), "community").orderBy(F.desc("size"), "community")


def neighbor_jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(p1, p2, jaccard) of the neighbours of asked pairs, each one's set without the pair itself; 0 without any."""
    n = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).where("node <> other").distinct()
    a, b = n.select(F.col("node").alias("p1"), "other"), n.select(F.col("node").alias("p2"), "other")
    size = lambda side: pairs.join(side, side.columns[0]).where((F.col("other") != F.col("p1")) & (F.col("other") != F.col("p2"))).groupBy("p1", "p2").agg(F.count("*").alias("n"))
    shared = pairs.join(a, "p1").join(b, ["p2", "other"]).groupBy("p1", "p2").agg(F.count("*").alias("i"))
    joined = pairs.join(size(a).withColumnRenamed("n", "x"), ["p1", "p2"], "left").join(size(b).withColumnRenamed("n", "y"), ["p1", "p2"], "left").join(shared, ["p1", "p2"], "left")
    i = F.coalesce("i", F.lit(0))
    return joined.select("p1", "p2", F.when(F.coalesce("x", F.lit(0)) * F.coalesce("y", F.lit(0)) > 0, F.round(i / (F.col("x") + F.col("y") - i), 6)).otherwise(0.0).alias("jaccard"))


def person_context(mentions: DataFrame, speakers: DataFrame, about: DataFrame, texts: DataFrame | None = None, co: int = 10, topics: int = 5, samples: int = 5) -> DataFrame:
    """A row for every entity: mentions by speaker's role, co-occurring entities, topics, sample ids. All entities at once.

    mentions (msg_id, entity), speakers (msg_id, role), about (msg_id, topic).
    """
    m = mentions.select("msg_id", "entity").distinct()
    counts = m.join(speakers, "msg_id", "left").groupBy("entity").agg(F.count_distinct("msg_id").alias("mention_count"), F.count_if(F.col("role") == "target").alias("by_target"), F.count_if(F.col("role") == "self").alias("by_self"))

    def tops(pairs: DataFrame, other: str, most: int, name: str) -> DataFrame:
        w = Window.partitionBy("entity").orderBy(F.desc("n"), other)
        first = pairs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
        return first.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", other, "n"))), lambda x: F.struct(x[other].alias("name"), x["n"].alias("n"))).alias(name))

    both = m.join(m.select("msg_id", F.col("entity").alias("other")), "msg_id").where("entity <> other").groupBy("entity", "other").agg(F.count("*").alias("n")).where("n >= 2")
    on = m.join(about.select("msg_id", "topic").distinct(), "msg_id").groupBy("entity", "topic").agg(F.count("*").alias("n"))
    latest = m.withColumn("_k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("msg_id")))).where(F.col("_k") <= samples).groupBy("entity").agg(F.sort_array(F.collect_list("msg_id"), asc=False).alias("samples"))
    return counts.join(tops(both, "other", co, "co_occurring"), "entity", "left").join(tops(on, "topic", topics, "topics"), "entity", "left").join(latest, "entity")


def graph_stats(**tables: DataFrame) -> DataFrame:
    """(name, n) of node and edge tables."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out
