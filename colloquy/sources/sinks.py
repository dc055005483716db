"""Writers: JSON lines, graph files, timelines, import scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_messages(messages: DataFrame, path: str, by_chat: bool = False) -> None:
    """JSON lines, one folder or one for each chat."""
    w = messages.write.mode("overwrite")
    (w.partitionBy("source_file") if by_chat else w).json(path)


def escaped(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, line): a graph file's lines, to be written in order of part and key. nodes (name, role, msg_count),
    edges (p1, p2, interaction_strength, warmth)."""
    spark = nodes.sparkSession
    # The graph format's frame and attribute names.
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.3" version="1.3">\n<graph mode="static" defaultedgetype="undirected">\n<attributes class="node"><attribute id="role" title="Role" type="string"/><attribute id="size" title="Messages" type="integer"/></attributes>\n<attributes class="edge"><attribute id="strength" title="Strength" type="float"/><attribute id="warmth" title="Warmth" type="float"/></attributes>\n<nodes>'
    fixed = spark.createDataFrame([(0, "", head), (2, "", "</nodes><edges>"), (4, "", "</edges></graph></gexf>")], "part int, key string, line string")
    value = lambda name, c: F.concat(F.lit(f'<attvalue for="{name}" value="'), escaped(F.col(c)), F.lit('"/>'))
    n = nodes.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat(F.lit('<node id="'), escaped(F.col("name")), F.lit('" label="'), escaped(F.col("name")), F.lit('"><attvalues>'), value("role", "role"), value("size", "msg_count"), F.lit("</attvalues></node>")).alias("line"))
    key = F.concat_ws("|", "p1", "p2")
    e = edges.select(
        F.lit(3).alias("part"),
        key.alias("key"),
        F.concat(F.lit('<edge id="'), escaped(key), F.lit('" source="'), escaped(F.col("p1")), F.lit('" target="'), escaped(F.col("p2")), F.lit('" weight="'), F.col("interaction_strength").cast("string"), F.lit('"><attvalues>'), value("strength", "interaction_strength"), value("warmth", "warmth"), F.lit("</attvalues></edge>")).alias("line"),
    )
    return fixed.unionByName(n).unionByName(e)


def network_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, line): the lines of one JSON object of nodes and edges, to be written in order of part and key; a
    line for each node and edge, so nothing is collected into one row."""
    fixed = nodes.sparkSession.createDataFrame([(0, "", '{"nodes":['), (2, "", '],"edges":['), (4, "", "]}")], "part int, key string, line string")

    def lines(part: int, rows: DataFrame, key: Column, *fields: Column) -> DataFrame:
        each = rows.select(F.lit(part).alias("part"), key.alias("key"), F.to_json(F.struct(*fields)).alias("line"))
        first = each.agg(F.min("key")).scalar()
        return each.withColumn("line", F.concat(F.when(F.col("key") == first, "").otherwise(","), "line"))

    n = lines(1, nodes, F.col("name"), F.col("name").alias("id"), F.col("role"))
    e = lines(3, edges, F.concat_ws("|", "p1", "p2"), F.col("p1").alias("source"), F.col("p2").alias("target"), F.col("interaction_strength").alias("weight"), F.col("relationship_type").alias("type"))
    return fixed.unionByName(n).unionByName(e)


def quoted(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def cypher(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(part, key, line): statements that load persons, messages, who said what and what answers what."""
    person = people.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat(F.lit("MERGE (:Person {name: "), quoted(F.col("name")), F.lit(", role: "), quoted(F.col("role")), F.lit("});")).alias("line"))
    id_ = F.col("msg_id").cast("string")
    order = F.lpad(id_, 20, "0")
    m = messages.select(F.lit(2).alias("part"), order.alias("key"), F.concat(F.lit("CREATE (:Message {msg_id: "), id_, F.lit(", content: "), quoted(F.col("content")), F.lit("});")).alias("line"))
    said = messages.select(F.lit(3).alias("part"), order.alias("key"), F.concat(F.lit("MATCH (p:Person {name: "), quoted(F.col("sender")), F.lit("}), (m:Message {msg_id: "), id_, F.lit("}) CREATE (p)-[:SAID]->(m);")).alias("line"))
    reply = messages.where("reply_to is not null").select(F.lit(4).alias("part"), order.alias("key"), F.concat(F.lit("MATCH (a:Message {msg_id: "), id_, F.lit("}), (b:Message {msg_id: "), F.col("reply_to").cast("string"), F.lit("}) CREATE (a)-[:REPLY_TO]->(b);")).alias("line"))
    rules = messages.sparkSession.createDataFrame([(0, "0", "CREATE CONSTRAINT IF NOT EXISTS FOR (m:Message) REQUIRE m.msg_id IS UNIQUE;"), (0, "1", "CREATE CONSTRAINT IF NOT EXISTS FOR (p:Person) REQUIRE p.name IS UNIQUE;")], "part int, key string, line string")
    return rules.unionByName(person).unionByName(m).unionByName(said).unionByName(reply)


def write_lines(lines: DataFrame, path: str) -> None:
    """Sorted text files; their names keep the order."""
    lines.orderBy("part", "key").select("line").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)
