"""Logical tables of the engine over the driver's tables, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.threads import typed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of private chats: msg_id, conv_id, turn, sender, sender_role, content, source_file."""
    role = F.when(F.col("role") == "user", "self").when(F.col("role") == "assistant", "target").otherwise("system")
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"),
        "conv_id",
        "turn",
        F.concat_ws("_", "role", (F.col("conv_id") % 10).cast("string")).alias("sender"),
        role.alias("sender_role"),
        F.col("text").alias("content"),
        F.concat(F.lit("private_"), F.col("conv_id").cast("string")).alias("source_file"),
    )
    return typed(rows)


C_SQL = """c AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn, role || '_' || (conv_id % 10) AS sender,
    CASE role WHEN 'user' THEN 'self' WHEN 'assistant' THEN 'target' ELSE 'system' END AS sender_role,
    text AS content, 'private_' || conv_id AS source_file FROM conversations)"""

CHAT = """CASE WHEN event_type = 'click' THEN concat('group_click_', user_id {div} 5) WHEN event_type = 'view' THEN concat('group_view_', user_id {div} 10)
    WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN concat('group_buy_', user_id {div} 5) WHEN event_type = 'error' AND event_id % 5 = 0 THEN concat('other_', user_id % 4)
    WHEN event_type = 'signup' AND event_id % 2 = 0 THEN concat('private_b', (user_id + 1) {div} 2) ELSE concat('private_a', user_id {div} 2) END"""


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of many people in groups and private chats: msg_id, sender, sender_role, source_file, ts, day."""
    e = table(spark, sf_dir, "events")
    chat = F.expr(CHAT.format(div="div"))
    private = F.col("chat_type") == "private"
    role = F.when(private & (F.col("user_id") % 2 == 0), "self").when(private, "target").otherwise("group_member")
    rows = e.select(F.col("event_id").alias("msg_id"), "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender"), chat.alias("source_file"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return typed(rows).withColumn("sender_role", role)


E_SQL = f"""e AS (SELECT *, CASE WHEN starts_with(source_file, 'private_') THEN CASE WHEN user_id % 2 = 0 THEN 'self' ELSE 'target' END ELSE 'group_member' END AS sender_role
    FROM (SELECT event_id AS msg_id, user_id, 'u' || user_id AS sender, {CHAT.format(div="//")} AS source_file, ts, strftime(ts, '%Y-%m-%d') AS day FROM events))"""

#: The reply chain over E: each message answers the one before it in its chat if the sender (in groups) or the role differs.
E_REPLY_SQL = (
    E_SQL
    + """,
er AS (SELECT *, CASE WHEN p_id IS NOT NULL AND (CASE WHEN sender_role = 'group_member' AND p_role = 'group_member' THEN sender <> p_sender ELSE sender_role <> p_role END) THEN p_id END AS reply_to
    FROM (SELECT *, lag(msg_id) OVER w AS p_id, lag(sender) OVER w AS p_sender, lag(sender_role) OVER w AS p_role FROM e WINDOW w AS (PARTITION BY source_file ORDER BY msg_id)))"""
)


def nation_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages of nations: person, month, priority."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("msg_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("person"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("priority")
    )


O_SQL = """o AS (SELECT o_orderkey AS msg_id, 'n' || c_nationkey AS person, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS priority
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as mentions: msg_id, entity (a part), topic (its brand)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("msg_id"), F.col("l_partkey").alias("entity"), F.col("p_brand").alias("topic"))


L_SQL = "l AS (SELECT l_orderkey AS msg_id, l_partkey AS entity, p_brand AS topic FROM lineitem JOIN part ON l_partkey = p_partkey)"
