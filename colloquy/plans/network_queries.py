"""Queries over people's networks, activity over time, co-occurrence and raters."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import edges, evaluate, graph, relations, search, temporal, threads
from colloquy.sources import sinks
from colloquy.sources.adapters import E_REPLY_SQL, E_SQL, L_SQL, O_SQL, event_messages, nation_activity, order_mentions, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def threaded(spark, d):
    return threads.reply_chain(event_messages(spark, d))


DIRECT = """dr AS (SELECT least(a.sender, b.sender) AS p1, greatest(a.sender, b.sender) AS p2, count(*) AS direct_replies FROM er a JOIN er b ON a.reply_to = b.msg_id WHERE a.sender <> b.sender GROUP BY 1, 2)"""
PRESENT = "pr AS (SELECT source_file, sender, count(*) AS n FROM e GROUP BY 1, 2)"
COP = """cp AS (SELECT a.sender AS p1, b.sender AS p2, count(*) FILTER (starts_with(a.source_file, 'group_')) AS shared_groups,
    coalesce(sum(a.n + b.n) FILTER (starts_with(a.source_file, 'group_')), 0)::BIGINT AS group_messages, coalesce(sum(a.n + b.n) FILTER (starts_with(a.source_file, 'private_')), 0)::BIGINT AS private_messages
    FROM dr JOIN pr a ON a.sender = dr.p1 JOIN pr b ON a.source_file = b.source_file AND b.sender = dr.p2 GROUP BY 1, 2)"""
REL = """rel AS (SELECT p1, p2, direct_replies, coalesce(shared_groups, 0) AS shared_groups, coalesce(group_messages, 0) AS group_messages, coalesce(private_messages, 0) AS private_messages,
    round(15 * ln(1 + direct_replies) + 5 * ln(1 + coalesce(group_messages, 0)), 1) AS interaction_strength,
    CASE WHEN direct_replies >= 50 THEN 'close_private' WHEN coalesce(shared_groups, 0) >= 3 THEN 'group_regular' WHEN coalesce(shared_groups, 0) >= 1 THEN 'group_acquaintance' WHEN coalesce(private_messages, 0) > 0 THEN 'light_private' ELSE 'none' END AS relationship_type
    FROM dr LEFT JOIN cp USING (p1, p2))"""
REL_SQL = f"WITH RECURSIVE {E_REPLY_SQL}, {DIRECT}, {PRESENT}, {COP}, {REL}"


@query(f"WITH {E_REPLY_SQL}, {DIRECT} SELECT * FROM dr")
def direct_replies(spark, d):
    return relations.direct_replies(threaded(spark, d))


@query(f"WITH {E_REPLY_SQL}, {DIRECT}, {PRESENT}, {COP} SELECT * FROM cp")
def copresence(spark, d):
    m = threaded(spark, d)
    return relations.copresence(m, relations.interaction_pairs(m))


SHARED = "SELECT dr.p1, dr.p2, a.source_file, a.n AS n1, b.n AS n2 FROM dr JOIN pr a ON a.sender = dr.p1 JOIN pr b ON a.source_file = b.source_file AND b.sender = dr.p2 WHERE starts_with(a.source_file, 'group_')"


@query(f"WITH {E_REPLY_SQL}, {DIRECT}, {PRESENT} {SHARED}")
def shared_groups(spark, d):
    m = threaded(spark, d)
    return relations.shared_groups(m, relations.interaction_pairs(m))


@query(f"WITH {E_REPLY_SQL}, {DIRECT} SELECT p1, p2 FROM dr")
def interaction_pairs(spark, d):
    return relations.interaction_pairs(threaded(spark, d))


@query(REL_SQL + " SELECT p1, p2, direct_replies, shared_groups, interaction_strength, relationship_type FROM rel ORDER BY interaction_strength DESC, p1, p2 LIMIT 20")
def relationship_strength(spark, d):
    r = relations.relationships(threaded(spark, d)).orderBy(F.desc("interaction_strength"), "p1", "p2").limit(20)
    return r.select("p1", "p2", "direct_replies", "shared_groups", "interaction_strength", "relationship_type")


@query(REL_SQL + " SELECT * FROM rel")
def relationships(spark, d):
    return relations.relationships(threaded(spark, d))


@query(f"WITH {E_REPLY_SQL} SELECT least(a.sender, b.sender) AS p1, greatest(a.sender, b.sender) AS p2, round(avg(epoch(date_trunc('second', a.ts)) - epoch(date_trunc('second', b.ts))), 3) AS mean_lag_seconds, round(avg((hour(a.ts) < 6)::INT), 4) AS late_night_ratio FROM er a JOIN er b ON a.reply_to = b.msg_id WHERE a.sender <> b.sender GROUP BY 1, 2")
def contact_extras(spark, d):
    return relations.contact_extras(threaded(spark, d))


@query(f"WITH {E_SQL} SELECT a.msg_id AS from_id, b.msg_id AS to_id FROM e a JOIN e b ON abs(a.msg_id - b.msg_id) < 5 AND a.msg_id <> b.msg_id WHERE starts_with(a.source_file, 'group_click') AND starts_with(b.source_file, 'group_view')")
def path_pairs(spark, d):
    chat = F.col("source_file")
    return search.path_pairs(event_messages(spark, d), chat.startswith("group_click"), chat.startswith("group_view"), 5, limit=None)


@query(f"WITH {E_SQL}, n AS (SELECT sender, count(*) AS msg_count FROM e GROUP BY 1), t AS (SELECT * FROM n ORDER BY msg_count DESC, sender LIMIT 20) SELECT sender, msg_count, round(msg_count / (SELECT sum(msg_count) FROM t), 6) AS share, round(msg_count / (SELECT sum(msg_count) FROM n), 6) AS true_share FROM t")
def degree_centrality(spark, d):
    return graph.degree_share(event_messages(spark, d))


@query(f"WITH {E_SQL}, p AS (SELECT DISTINCT sender AS name FROM e) SELECT name, count(e.msg_id) AS msg_count FROM p LEFT JOIN e ON name = sender GROUP BY name")
def person_msg_counts(spark, d):
    m = event_messages(spark, d)
    return graph.message_counts(edges.persons(m).select("name"), m)


@query(f"WITH {E_REPLY_SQL}, {DIRECT} SELECT 'person' AS name, count(DISTINCT sender) AS n FROM er UNION ALL SELECT 'message', count(*) FROM er UNION ALL SELECT 'said', count(*) FROM er UNION ALL SELECT 'reply_to', count(reply_to) FROM er UNION ALL SELECT 'interacts_with', count(*) FROM dr UNION ALL SELECT 'role:' || sender_role, count(*) FROM er GROUP BY sender_role")
def graph_stats(spark, d):
    m = threaded(spark, d)
    people = edges.persons(m)
    roles = m.groupBy("sender_role").agg(F.count("*").alias("n")).select(F.concat(F.lit("role:"), "sender_role").alias("name"), "n")
    return graph.graph_stats(person=people, message=m, said=edges.said_edges(m, people), reply_to=edges.reply_edges(m), interacts_with=relations.interaction_pairs(m)).union(roles)


PR_SQL = REL_SQL + """, sym AS (SELECT p1 AS src, p2 AS dst, interaction_strength AS w FROM rel UNION ALL SELECT p2, p1, interaction_strength FROM rel),
nrm AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS part FROM sym WHERE w > 0), nodes AS (SELECT DISTINCT src AS node FROM nrm),
rk AS (SELECT 0 AS i, node, 0.15::DOUBLE AS score FROM nodes UNION ALL SELECT i + 1, dst, 0.15 + 0.85 * sum(score * part) FROM rk JOIN nrm ON node = src WHERE i < 20 GROUP BY i, dst)"""


@query(PR_SQL + " SELECT node AS name, round(score, 4) AS score FROM rk WHERE i = 20 ORDER BY round(score, 4) DESC, name LIMIT 20")
def pagerank(spark, d):
    r = relations.relationships(threaded(spark, d)).select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.col("interaction_strength").alias("weight"))
    return graph.pagerank(r).select(F.col("node").alias("name"), F.round("score", 4).alias("score")).orderBy(F.desc("score"), "name").limit(20)


@query()
def louvain(spark, d):
    r = relations.relationships(threaded(spark, d)).select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.col("interaction_strength").alias("weight"))
    return graph.communities(graph.louvain(r))


@query(f"WITH {E_SQL}, g AS (SELECT source_file, day, count(*) AS cnt FROM e WHERE starts_with(source_file, 'group_') GROUP BY 1, 2 HAVING count(*) >= 5) SELECT *, substr(replace(source_file, 'group_', ''), 1, 25) AS display, sum(cnt) OVER (PARTITION BY source_file)::BIGINT AS group_total FROM g")
def group_trend(spark, d):
    return temporal.group_trend(event_messages(spark, d))


@query(f"WITH {E_SQL}, g AS (SELECT source_file, day, count(*) AS cnt FROM e WHERE starts_with(source_file, 'group_') GROUP BY 1, 2 HAVING count(*) >= 3) SELECT source_file, string_agg(CASE WHEN cnt > 6 THEN '█' WHEN cnt > 4 THEN '▄' ELSE '▁' END, '' ORDER BY day) AS line FROM g GROUP BY 1")
def group_spark_line(spark, d):
    return temporal.spark_line(temporal.group_trend(event_messages(spark, d), least=3), high=6, low=4)


@query(f"WITH {E_SQL} SELECT msg_id, source_file, day FROM e WHERE sender = 'u7' ORDER BY msg_id DESC LIMIT 5")
def social_context_messages(spark, d):
    return search.social_context(event_messages(spark, d), *_no_relations(spark), "u7")["last_messages"].select("msg_id", "source_file", "day")


def _no_relations(spark):
    return (
        spark.createDataFrame([], "p1 string, p2 string, interaction_strength double"),
        spark.createDataFrame([], "p1 string, p2 string, source_file string, n1 bigint, n2 bigint"),
        spark.createDataFrame([], "member string, identity string"),
    )


@query(REL_SQL + " SELECT p1, p2, interaction_strength, relationship_type FROM rel WHERE p1 = 'u7' OR p2 = 'u7' ORDER BY interaction_strength DESC, p1, p2 LIMIT 20")
def social_context_relationships(spark, d):
    m = threaded(spark, d)
    _, shared, same = _no_relations(spark)
    return search.social_context(m, relations.relationships(m), shared, same, "u7")["relationships"].select("p1", "p2", "interaction_strength", "relationship_type")


@query(f"WITH {E_REPLY_SQL}, {DIRECT}, {PRESENT} {SHARED} AND (dr.p1 = 'u7' OR dr.p2 = 'u7')")
def social_context_groups(spark, d):
    m = threaded(spark, d)
    rel, _, same = _no_relations(spark)
    return search.social_context(m, rel, relations.shared_groups(m, relations.interaction_pairs(m)), same, "u7")["shared_groups"]


@query(REL_SQL + """ SELECT '<edge id="' || p1 || '|' || p2 || '" source="' || p1 || '" target="' || p2 || '"' AS line FROM rel UNION ALL SELECT '<node id="' || sender || '" label="' || sender || '"' FROM (SELECT DISTINCT sender FROM e)""")
def gexf_lines(spark, d):
    m = threaded(spark, d)
    nodes = edges.persons(m).join(graph.message_counts(edges.persons(m).select("name"), m), "name")
    lines = sinks.gexf(nodes, relations.relationships(m).withColumn("warmth", F.lit(0.0))).where("part in (1, 3)")
    return lines.select(F.regexp_extract("line", '^(<edge id="[^"]*" source="[^"]*" target="[^"]*"|<node id="[^"]*" label="[^"]*")', 1).alias("line"))


# ---- activity over months

COLD, WARM = "priority = '1-URGENT'", "priority IN ('4-NOT SPECIFIED', '5-LOW')"
LIFE = f"lc AS (SELECT person, month, count(*) AS total, count(*) FILTER ({WARM}) AS warm, count(*) FILTER ({COLD}) AS cold FROM o GROUP BY 1, 2 HAVING count(*) >= 5)"
TREND = """lt AS (SELECT *, CASE WHEN prev IS NULL THEN 'start' WHEN total > prev * 1.3 THEN 'up' WHEN total < prev * 0.7 THEN 'down' ELSE 'stable' END AS trend, round(warm / total, 6) AS warm_ratio, round(cold / total, 6) AS cold_ratio
    FROM (SELECT *, lag(total) OVER (PARTITION BY person ORDER BY month) AS prev FROM lc))"""


def life(spark, d):
    return temporal.lifecycle_counts(nation_activity(spark, d), F.expr(WARM), F.expr(COLD))


@query(f"WITH {O_SQL} SELECT person, month, count(*) AS cnt FROM o GROUP BY 1, 2 HAVING count(*) >= 3")
def monthly_activity(spark, d):
    return temporal.monthly_activity(nation_activity(spark, d))


@query(f"WITH {O_SQL}, m AS (SELECT person, month, count(*) AS cnt FROM o GROUP BY 1, 2 HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY cnt DESC, person) AS rank FROM m) SELECT person, month, cnt, rank, floor(cnt / max(cnt) OVER (PARTITION BY month) * 30)::BIGINT AS bar FROM r WHERE rank <= 15")
def monthly_top_n(spark, d):
    return temporal.monthly_top_n(nation_activity(spark, d))


@query(f"WITH {O_SQL}, {LIFE} SELECT * FROM lc")
def lifecycle_counts(spark, d):
    return life(spark, d)


@query(f"WITH {O_SQL}, {LIFE}, {TREND} SELECT person, month, total, warm, cold, prev, trend, warm_ratio, cold_ratio FROM lt")
def lifecycle_trend(spark, d):
    return temporal.lifecycle_trend(life(spark, d))


@query(f"WITH {O_SQL}, {LIFE}, {TREND} SELECT person, month, prev, total, cold_ratio FROM lt WHERE cold / total > 0.1 AND prev > 0 AND total < prev * 0.7")
def turning_points(spark, d):
    return temporal.turning_points(temporal.lifecycle_trend(life(spark, d)))


@query(f"WITH {O_SQL}, m AS (SELECT person, month, count(*) AS cnt FROM o GROUP BY 1, 2) SELECT person, sum(cnt)::BIGINT AS total, count(*) AS active_months, min(month) AS first_month, max(month) AS last_month FROM m GROUP BY 1 ORDER BY total DESC, person LIMIT 10")
def person_timeline(spark, d):
    return temporal.person_timeline(nation_activity(spark, d))


@query(f"WITH {O_SQL} SELECT person, month, count(*) AS cnt FROM o GROUP BY 1, 2 ORDER BY cnt DESC, person, month LIMIT 500")
def timeline_export(spark, d):
    return temporal.timeline_export(nation_activity(spark, d)).select("person", F.explode("months").alias("month", "cnt"))


# ---- co-occurrence over order lines

KN = "m AS (SELECT DISTINCT msg_id, entity FROM l), kn AS (SELECT a.entity AS p1, b.entity AS p2, count(*) AS weight FROM m a JOIN m b ON a.msg_id = b.msg_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {L_SQL}, {KN} SELECT * FROM kn")
def knows(spark, d):
    return edges.cooccurrence(order_mentions(spark, d), "msg_id", "entity", 2)


@query(f"WITH {L_SQL}, {KN} SELECT * FROM kn ORDER BY weight DESC, p1, p2 LIMIT 30")
def community_edges(spark, d):
    return edges.cooccurrence(order_mentions(spark, d), "msg_id", "entity", 2).orderBy(F.desc("weight"), "p1", "p2").limit(30)


@query(f"WITH {L_SQL}, {KN}, s AS (SELECT p1 AS entity, p2 AS other, weight FROM kn UNION ALL SELECT p2, p1, weight FROM kn), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, other) AS rank FROM s) SELECT entity, other, weight, rank FROM r WHERE rank <= 10")
def co_occurring(spark, d):
    from pyspark.sql import Window

    k = edges.cooccurrence(order_mentions(spark, d), "msg_id", "entity", 2)
    s = k.select(F.col("p1").alias("entity"), F.col("p2").alias("other"), "weight").union(k.select("p2", "p1", "weight"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("weight"), "other"))).where("rank <= 10")


@query(f"WITH {L_SQL}, own AS (SELECT DISTINCT msg_id FROM l WHERE entity = 7) SELECT t.topic, x.entity AS other, count(DISTINCT own.msg_id) AS messages FROM own JOIN l t ON t.msg_id = own.msg_id LEFT JOIN l x ON x.msg_id = own.msg_id AND x.entity <> 7 GROUP BY 1, 2 ORDER BY messages DESC, topic, other NULLS LAST LIMIT 20")
def related(spark, d):
    lm = order_mentions(spark, d)
    return search.related(lm.select("msg_id", "entity"), lm.select("msg_id", "topic"), 7)


@query(f"WITH {L_SQL}, n AS (SELECT m.entity, t.topic, count(DISTINCT m.msg_id) AS messages FROM l m JOIN l t ON m.msg_id = t.msg_id GROUP BY 1, 2) SELECT entity, topic, messages, row_number() OVER (PARTITION BY entity ORDER BY messages DESC, topic) AS rank FROM n QUALIFY rank <= 5")
def related_topics(spark, d):
    lm = order_mentions(spark, d)
    return search.related_topics(lm.select("msg_id", "entity"), lm.select("msg_id", "topic"))


@query(f"WITH {L_SQL} SELECT entity, count(DISTINCT msg_id) AS mention_count FROM l GROUP BY 1 HAVING count(DISTINCT msg_id) >= 35 ORDER BY mention_count DESC, entity")
def notable_persons(spark, d):
    n = order_mentions(spark, d).groupBy("entity").agg(F.count_distinct("msg_id").alias("mention_count"))
    return n.where("mention_count >= 35").orderBy(F.desc("mention_count"), "entity")


@query(
    f"""WITH {L_SQL}, m AS (SELECT DISTINCT msg_id, entity FROM l), c AS (SELECT entity, count(*) AS mention_count, count(*) FILTER (msg_id % 3 = 0) AS by_target, count(*) FILTER (msg_id % 3 = 1) AS by_self, string_agg(CAST(msg_id AS VARCHAR), ',' ORDER BY msg_id DESC) FILTER (k <= 5) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY msg_id DESC) AS k FROM m) GROUP BY 1),
t AS (SELECT entity, topic, n, row_number() OVER (PARTITION BY entity ORDER BY n DESC, topic) AS k FROM (SELECT m.entity, x.topic, count(DISTINCT m.msg_id) AS n FROM m JOIN l x ON m.msg_id = x.msg_id GROUP BY 1, 2)),
tt AS (SELECT entity, string_agg(topic || '=' || n, ',' ORDER BY k) AS topics FROM t WHERE k <= 5 GROUP BY 1),
o AS (SELECT entity, other, n, row_number() OVER (PARTITION BY entity ORDER BY n DESC, other) AS k FROM (SELECT a.entity, b.entity AS other, count(*) AS n FROM m a JOIN m b ON a.msg_id = b.msg_id AND a.entity <> b.entity GROUP BY 1, 2 HAVING count(*) >= 2)),
oo AS (SELECT entity, string_agg(other || '=' || n, ',' ORDER BY k) AS co_occurring FROM o WHERE k <= 10 GROUP BY 1)
SELECT c.*, coalesce(topics, '') AS topics, coalesce(co_occurring, '') AS co_occurring FROM c LEFT JOIN tt USING (entity) LEFT JOIN oo USING (entity)"""
)
def person_context(spark, d):
    lm = order_mentions(spark, d)
    role = F.when(F.col("msg_id") % 3 == 0, "target").when(F.col("msg_id") % 3 == 1, "self").otherwise("system")
    c = graph.person_context(lm.select("msg_id", "entity"), table(spark, d, "orders").select(F.col("o_orderkey").alias("msg_id")).withColumn("role", role), lm.select("msg_id", "topic"))
    joined = lambda x: F.coalesce(F.array_join(F.transform(x, lambda v: F.concat(v["name"].cast("string"), F.lit("="), v["n"].cast("string"))), ","), F.lit(""))
    return c.select("entity", "mention_count", "by_target", "by_self", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"), joined(F.col("topics")).alias("topics"), joined(F.col("co_occurring")).alias("co_occurring"))


@query(
    f"""WITH {E_REPLY_SQL}, {DIRECT}, nb AS (SELECT p1 AS node, p2 AS other FROM dr UNION SELECT p2, p1 FROM dr)
SELECT p1, p2, CASE WHEN x > 0 AND y > 0 THEN round(i / (x + y - i), 6) ELSE 0.0 END AS jaccard FROM (SELECT p1, p2, (SELECT count(*) FROM nb WHERE node = p1 AND other <> p2) AS x, (SELECT count(*) FROM nb WHERE node = p2 AND other <> p1) AS y,
  (SELECT count(*) FROM nb a JOIN nb b ON a.other = b.other WHERE a.node = p1 AND b.node = p2) AS i FROM dr)"""
)
def neighbor_jaccard(spark, d):
    pairs = relations.interaction_pairs(threaded(spark, d))
    return graph.neighbor_jaccard(pairs.select(F.col("p1").alias("src"), F.col("p2").alias("dst")), pairs)


# ---- raters

R_SQL = """r AS (SELECT doc_id AS item, CASE WHEN n_chars <= 800 THEN 'short' WHEN n_chars <= 3000 THEN 'medium' ELSE 'long' END AS bucket, unnest([{'rater': 'r1', 'label': quality}, {'rater': 'r2', 'label': 1 - toxic}, {'rater': 'r3', 'label': (n_chars % 5 > 0)::INT}], recursive := true) FROM labels JOIN documents USING (doc_id)),
pr AS (SELECT a.rater AS r1, b.rater AS r2, a.bucket, a.label AS l1, b.label AS l2 FROM r a JOIN r b ON a.item = b.item AND a.rater < b.rater),"""


def kappa_sql(by: str, least: int = 0) -> str:
    keys = "r1, r2" + by
    return f"""WITH {R_SQL} n AS (SELECT {keys}, count(*) AS n, avg((l1 = l2)::INT) AS po, avg((l1 = 0)::INT) * avg((l2 = 0)::INT) + avg((l1 = 1)::INT) * avg((l2 = 1)::INT) AS pe FROM pr GROUP BY {keys})
SELECT {keys}, n, round(po, 4) AS agreement, round(CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END, 4) AS kappa FROM n WHERE n >= {least}"""


def ratings(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    x = table(spark, d, "labels").join(doc, "doc_id")
    bucket = F.when(F.col("n_chars") <= 800, "short").when(F.col("n_chars") <= 3000, "medium").otherwise("long")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rater"), v.cast("int").alias("label")) for n, v in (("r1", F.col("quality")), ("r2", 1 - F.col("toxic")), ("r3", F.col("n_chars") % 5 > 0)))))
    return x.select(F.col("doc_id").alias("item"), bucket.alias("bucket"), each.alias("v")).select("item", "bucket", "v.*")


@query(kappa_sql("").replace("FROM n WHERE", "FROM n WHERE r1 = 'r1' AND r2 = 'r2' AND"))
def cohens_kappa(spark, d):
    return evaluate.pairwise_kappa(ratings(spark, d).where("rater in ('r1', 'r2')"))


@query(kappa_sql(", bucket", 5))
def pairwise_kappa(spark, d):
    return evaluate.pairwise_kappa(ratings(spark, d), "bucket", least=5)


@query(f"WITH {R_SQL} x AS (SELECT item, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS labels FROM r GROUP BY item HAVING count(DISTINCT label) > 1) SELECT * FROM x")
def disagreements(spark, d):
    return evaluate.disagreements(ratings(spark, d)).select("item", F.array_join(F.transform("labels", lambda v: v.cast("string")), ",").alias("labels"))
