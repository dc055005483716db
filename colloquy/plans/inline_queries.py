"""Queries over small inline tables, for patterns that the driver's text can't hold. The same VALUES are in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import lexicon as lex
from colloquy.functions import rules
from colloquy.operators import documents, evaluate, resolve, search, verify

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def values(rows) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


# ---- names

NAMES = [(n, c) for n, c in (("王小明", 9), ("王小明老师", 3), ("小明", 4), ("wxm", 2), ("王老师", 1), ("李大海", 5), ("李大海Ocean", 2), ("李导", 1), ("ldh", 1), ("张三", 7), ("Alice", 2), ("ALICE", 1), ("周文同学", 1), ("周文", 3), ("赵六哥", 1), ("赵六", 2), ("钱", 1), ("孙七八九十十一", 1), ("七八", 1))]
LETTERS = dict(lex.INITIALS) | {"小": "x", "明": "m", "大": "d", "海": "h"}
TABLE = f"'{''.join(LETTERS)}', '{''.join(LETTERS.values())}'"


def normal_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({c}, '{s}') AND length({c}) > {len(s)} THEN substr({c}, 1, length({c}) - {len(s)})" for s in lex.HONORIFICS) + f" ELSE {c} END"


def has_title(c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in lex.TITLES) + ")"


HAN_SQL = r"length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'))"
ABBREV = "(regexp_matches(lower({0}), '^[a-z]{{2,4}}$') AND length({1}) >= 2 AND length({0}) = length({1}) AND lower(translate({1}, " + TABLE.replace("{", "{{") + ")) = lower({0}))"
MATCH_SQL = f"""names(name, n) AS (VALUES {values(NAMES)}),
prs AS (SELECT a.name AS e1, b.name AS e2, {normal_sql('a.name')} AS n1, {normal_sql('b.name')} AS n2 FROM names a JOIN names b ON a.name < b.name),
sl AS (SELECT *, CASE WHEN length(n1) < length(n2) THEN n1 ELSE n2 END AS shorter, CASE WHEN length(n1) >= length(n2) THEN n1 ELSE n2 END AS longer, {HAN_SQL.format('n1')} > 0 AND {HAN_SQL.format('n2')} > 0 AS han FROM prs),
mt AS (SELECT e1, e2, CASE WHEN n1 = n2 THEN {{'c': 1.0, 'r': 'identical'}}
  WHEN (contains(n1, n2) OR contains(n2, n1)) AND {HAN_SQL.format('shorter')} >= 2 AND length(longer) <= 3 * length(shorter) THEN {{'c': 0.85, 'r': 'substring'}}
  WHEN han AND regexp_replace(n1, '[a-zA-Z]+$', '') = regexp_replace(n2, '[a-zA-Z]+$', '') THEN {{'c': 0.95, 'r': 'name+title'}}
  WHEN {ABBREV.format('n1', 'n2')} THEN {{'c': 0.9, 'r': 'abbrev:' || n1 || '→' || n2}}
  WHEN {ABBREV.format('n2', 'n1')} THEN {{'c': 0.9, 'r': 'abbrev:' || n2 || '→' || n1}}
  WHEN han AND substr(n1, 1, 1) = substr(n2, 1, 1) AND (({has_title('e1')} AND length(n2) <= 3) OR ({has_title('e2')} AND length(n1) <= 3)) THEN {{'c': 0.7, 'r': 'surname+title'}} END AS m FROM sl),
found AS (SELECT e1, e2, m.c::DOUBLE AS confidence, m.r AS reason FROM mt WHERE m IS NOT NULL)"""


def names(spark):
    return spark.createDataFrame(NAMES, "name string, n bigint")


def found(spark):
    return resolve.candidates(names(spark), LETTERS)


@query(f"WITH {MATCH_SQL} SELECT * FROM found")
def rule_match(spark, d):
    pairs = spark.createDataFrame([(a, b) for a, _ in NAMES for b, _ in NAMES if a < b], "e1 string, e2 string")
    return resolve.rule_match(pairs, table=LETTERS)


@query(f"WITH {MATCH_SQL} SELECT * FROM found")
def resolve_candidates(spark, d):
    return found(spark)


LINKS = [("王小明", "王小明老师", 0.5), ("小明", "王小明", 0.2), ("李大海", "李导", 0.4), ("王小明", "王老师", 0.1)]
CONFIRM_SQL = MATCH_SQL + f""", st(p1, p2, j) AS (VALUES {values([(min(a, b), max(a, b), j) for a, b, j in LINKS])}),
cf AS (SELECT e1, e2, round(0.7 * confidence + 0.3 * coalesce(j, 0), 6) AS confidence, reason || CASE WHEN 0.7 * confidence + 0.3 * coalesce(j, 0) < 0.65 AND coalesce(j, 0) > 0.3 THEN '+graph' ELSE '' END AS reason
  FROM found LEFT JOIN st ON e1 = p1 AND e2 = p2 WHERE 0.7 * confidence + 0.3 * coalesce(j, 0) >= 0.65 OR coalesce(j, 0) > 0.3)"""


def confirmed(spark):
    s = spark.createDataFrame([(min(a, b), max(a, b), j) for a, b, j in LINKS], "p1 string, p2 string, jaccard double")
    return resolve.confirmed(found(spark), s, threshold=0.65)


@query(f"WITH {CONFIRM_SQL} SELECT * FROM cf")
def confirmed_pairs(spark, d):
    return confirmed(spark)


GROUP_SQL = f"""WITH RECURSIVE {CONFIRM_SQL}, ed AS (SELECT e1 AS a, e2 AS b FROM cf UNION SELECT e2, e1 FROM cf),
rc AS (SELECT DISTINCT a AS node, a AS reach FROM ed UNION SELECT rc.node, ed.b FROM rc JOIN ed ON rc.reach = ed.a),
gr AS (SELECT node AS member, min(reach) AS root FROM rc GROUP BY 1),
idt AS (SELECT member, first_value(member) OVER (PARTITION BY root ORDER BY n DESC, member) AS identity FROM gr JOIN names ON member = name)"""


@query(f"{GROUP_SQL} SELECT member, identity FROM idt")
def identity_groups(spark, d):
    return resolve.identities(confirmed(spark), names(spark))


@query(f"{GROUP_SQL} SELECT identity, string_agg(member, ',' ORDER BY member) AS members FROM idt WHERE identity IN (SELECT identity FROM idt WHERE contains(member, '大海') OR contains(identity, '大海')) GROUP BY 1")
def identity_aliases(spark, d):
    found_ = resolve.identity_aliases(resolve.identities(confirmed(spark), names(spark)), "大海")
    return found_.select("identity", F.array_join("members", ",").alias("members"))


@query(f"WITH n(name) AS (VALUES {values([(n,) for n, _ in NAMES])}) SELECT name, {normal_sql('name')} AS normal, regexp_matches(lower(name), '^[a-z]{{2,4}}$') AS abbreviation, lower(translate(name, {TABLE})) AS initials FROM n")
def normalize_names(spark, d):
    n = names(spark)
    return n.select("name", resolve.normalize_name(F.col("name")).alias("normal"), resolve.is_abbreviation(F.col("name")).alias("abbreviation"), resolve.initials(F.col("name"), LETTERS).alias("initials"))


# ---- claims

DOCS = [
    ("a.md", 'She said "今天论文答辩顺利结束了" and "太短".\n- **喜欢吃**：喜欢吃火锅和烤肉\n- **短**：少\n- **态度**: 论文答辩 准备充分\n'),
    ("b.md", '"没有任何事实支持这句话啊" and "完全是英文 not in facts"\n'),
]
FACTS = [("F_00001", "p1", "论文答辩", "今天 论文答辩 结束"), ("F_00002", "p2", "火锅", "喜欢吃 火锅 真的"), ("F_00003", "p1x", "准备充分", "答辩 准备充分"), ("F_00004", "p2", "烤肉", "烤肉 喜欢吃火")]
CLAIM_SQL = r"""docs(doc, text) AS (VALUES """ + values(DOCS) + r"""),
cl AS (SELECT doc, 'quoted' AS kind, unnest(regexp_extract_all(text, '"([^"]{8,})"', 1)) AS claim FROM docs
  UNION ALL SELECT doc, 'list_item', t || ': ' || substr(d, 1, 80) FROM (SELECT doc, unnest(regexp_extract_all(text, '-\s+\*\*(.+?)\*\*[：:]\s*([^\n]+)', 1)) AS t, unnest(regexp_extract_all(text, '-\s+\*\*(.+?)\*\*[：:]\s*([^\n]+)', 2)) AS d FROM docs) WHERE length(d) > 5)"""
ASKED = [(1, "论文答辩 顺利", "p1"), (2, "喜欢吃 火锅 烤肉", "p1"), (3, "没有依据的话", "p1"), (4, "准备充分 论文答辩", None), (5, "火锅 火锅", "p2")]
VERIFY_SQL = r"""ask(claim_id, claim, expected) AS (VALUES """ + values(ASKED) + r"""), fct(fact_id, subject, object, source_content) AS (VALUES """ + values(FACTS) + r"""),
ix AS (SELECT DISTINCT fact_id, unnest(regexp_extract_all(source_content || ' ' || object, '[\x{4e00}-\x{9fff}]{2,4}')) AS word FROM fct),
cw AS (SELECT claim_id, unnest(regexp_extract_all(claim, '[\x{4e00}-\x{9fff}]{2,6}')) AS word FROM ask),
cm AS (SELECT claim_id, fact_id, count(*) AS hits FROM cw JOIN ix USING (word) GROUP BY 1, 2),
tp AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY hits DESC, fact_id) AS k FROM cm),
vf AS (SELECT ask.claim_id, CASE WHEN count(tp.fact_id) = 0 THEN 'UNVERIFIED' WHEN expected IS NULL THEN 'PARTIAL' WHEN count(*) FILTER (contains(subject, expected)) > 0 THEN 'VERIFIED' ELSE 'MISATTRIBUTED' END AS status,
  coalesce(CASE WHEN count(*) FILTER (contains(subject, expected)) > 0 THEN string_agg(tp.fact_id, ',' ORDER BY tp.fact_id) FILTER (contains(subject, expected)) ELSE string_agg(tp.fact_id, ',' ORDER BY tp.fact_id) END, '') AS fact_ids
  FROM ask LEFT JOIN tp ON tp.claim_id = ask.claim_id AND k <= 3 LEFT JOIN fct ON fct.fact_id = tp.fact_id GROUP BY ask.claim_id, expected)"""


def asked(spark):
    return spark.createDataFrame(ASKED, "claim_id int, claim string, expected string")


def known(spark):
    return spark.createDataFrame(FACTS, "fact_id string, subject string, object string, source_content string")


@query(f"WITH {CLAIM_SQL} SELECT * FROM cl")
def claims(spark, d):
    return verify.claims(spark.createDataFrame(DOCS, "doc string, text string"))


@query(f"WITH {VERIFY_SQL} SELECT * FROM cm")
def claim_match(spark, d):
    return verify.claim_match(asked(spark), known(spark))


@query(f"WITH {VERIFY_SQL} SELECT * FROM vf")
def verify_claims(spark, d):
    return verify.verify_claims(asked(spark), known(spark)).select("claim_id", "status", F.array_join("fact_ids", ",").alias("fact_ids"))


@query(f"WITH {VERIFY_SQL} SELECT status, count(*) AS n FROM vf GROUP BY 1")
def verify_stats(spark, d):
    return verify.verify_stats(verify.verify_claims(asked(spark), known(spark)))


# ---- style

STYLE = rules.Style(others=("监视器",))
REPLIES = [(1, "哈哈 好呀"), (2, "太厉害了[旺柴]"), (3, "（等一下，我不该这样说话的）算了吧真的太长了"), (4, "监视器坏了[旺柴]太强了"), (5, ""), (6, "好的（嗯）"), (7, "[捂脸]没招了")]
S_SQL = f"""rp(id, t) AS (VALUES {values(REPLIES)}),
sc AS (SELECT *, list_filter([CASE WHEN contains(t, '[旺柴]') THEN 'forbidden_mark' END, CASE WHEN contains(t, '太优秀了') OR contains(t, '太厉害了') OR contains(t, '太强了') THEN 'self_praise' END,
  CASE WHEN contains(t, '监视器') THEN 'misattributed' END, CASE WHEN contains(t, '（') AND length(t) > 20 THEN 'aside' END], lambda x: x IS NOT NULL) AS issues FROM rp)"""


def scored(spark):
    r = spark.createDataFrame(REPLIES, "id int, t string")
    return r.withColumn("s", rules.style_score(F.col("t"), STYLE))


@query(f"WITH {S_SQL} SELECT id, CAST(CASE WHEN len(issues) = 0 THEN 5 ELSE greatest(1, 5 - 2 * len(issues)) END AS INTEGER) AS style_score, array_to_string(issues, ',') AS issues, len(issues) = 0 AS passed, len(issues) > 0 AS retry FROM sc")
def style_score(spark, d):
    return scored(spark).select("id", "s.style_score", F.array_join("s.issues", ",").alias("issues"), "s.passed", rules.should_retry(F.col("s")).alias("retry"))


@query(f"WITH {S_SQL} SELECT id, trim(CASE WHEN list_contains(issues, 'aside') THEN regexp_replace(f, '（[^）]*）', '', 'g') ELSE f END) AS fixed FROM (SELECT *, CASE WHEN list_contains(issues, 'forbidden_mark') THEN replace(t, '[旺柴]', '') ELSE t END AS f FROM sc)")
def auto_fix(spark, d):
    return scored(spark).select("id", rules.auto_fix(F.col("t"), F.col("s.issues"), STYLE).alias("fixed"))


@query(f"WITH {S_SQL} SELECT round(greatest(0, 100 * (1 - 2 * avg((len(issues) > 0)::INT))), 1) AS score, round(avg((len(issues) > 0)::INT), 3) AS forbidden_rate, count(*) FILTER (len(issues) > 0) AS violations, count(*) AS total FROM sc WHERE id <> 3")
def style_compliance(spark, d):
    return evaluate.compliance(scored(spark).where("id <> 3").select("s.passed"))


@query(f"WITH t(id, t) AS (VALUES {values(REPLIES)}) SELECT id, CASE WHEN ({' OR '.join(f'contains(t, {w!r})' for w in lex.NEUTRAL_WORDS)}) AND NOT ({' OR '.join(f'contains(t, {w!r})' for w in lex.WARM_WORDS)}) THEN 'neutral_ack' WHEN ({' OR '.join(f'contains(t, {w!r})' for w in lex.WARM_WORDS)}) THEN 'warm_reply' WHEN length(t) <= 8 AND ({' OR '.join(f'contains(t, {w!r})' for w in lex.COLD_WORDS)}) THEN 'cold_response' ELSE 'neutral' END AS emotion FROM t")
def emotion_default_lexicon(spark, d):
    return spark.createDataFrame(REPLIES, "id int, t string").select("id", rules.classify(F.col("t"))["emotion"].alias("emotion"))


STATES = [(1, -0.5, 0.1), (2, 0.0, 0.5), (3, 0.6, 0.2), (4, 0.31, 0.3)]


@query(f"WITH s(id, mood, intimacy) AS (VALUES {values(STATES)}) SELECT id, concat_ws(chr(10), CASE WHEN intimacy < 0.3 THEN 'RULE: no pet names' END, CASE WHEN mood < -0.3 THEN 'RULE: at most 8 characters, no emoji' END, CASE WHEN mood > 0.3 THEN 'STYLE: may be a little warmer' END) AS rules FROM s")
def session_rules(spark, d):
    return spark.createDataFrame(STATES, "id int, mood double, intimacy double").select("id", rules.session_rules(F.col("mood"), F.col("intimacy")).alias("rules"))


# ---- ablations, history, links

SCORES = [(k, s, e, round(60 + 10 * k + 5 * s - 3 * e + 2 * k * s + 0.25 * i, 2)) for i in range(4) for k in (0, 1) for s in (0, 1) for e in (0, 1)]
ABL = f"ab AS (SELECT kg = 1 AS kg, style = 1 AS style, session = 1 AS session, score::DOUBLE AS score FROM (VALUES {values(SCORES)}) AS v(kg, style, session, score))"


def ablations(spark):
    return spark.createDataFrame([(bool(k), bool(s), bool(e), v) for k, s, e, v in SCORES], "kg boolean, style boolean, session boolean, score double")


@query(f"WITH {ABL} SELECT kg, style, session, round(avg(score), 6) AS mean_score, count(*) AS n FROM ab GROUP BY CUBE (kg, style, session)")
def ablation_cube(spark, d):
    return evaluate.ablation(ablations(spark), ("kg", "style", "session"))


@query(f"WITH {ABL} " + " UNION ALL ".join(f"SELECT '{f}' AS factor, round(avg(score) FILTER ({f}) - avg(score) FILTER (NOT {f}), 6) AS contribution FROM ab" for f in ("kg", "style", "session")))
def ablation_contrib(spark, d):
    return evaluate.contributions(ablations(spark), ("kg", "style", "session"))


RUNS = [(i, 50 + (i * 7) % 11 + i * 0.5) for i in range(1, 15)]


@query(f"WITH r(run, score) AS (VALUES {values(RUNS)}), d AS (SELECT run, score::DOUBLE AS score, round(score::DOUBLE - lag(score::DOUBLE) OVER (ORDER BY run), 6) AS delta FROM r) SELECT * FROM d ORDER BY run DESC LIMIT 10")
def history_delta(spark, d):
    return evaluate.history(spark.createDataFrame(RUNS, "run int, score double"))


DIMENSIONS = [(1, 80.0, 60.0, 90.0, 70.0, 100.0), (2, 0.0, 50.0, 100.0, 20.0, 30.0)]


@query(f"WITH x(id, a, b, c, d, e) AS (VALUES {values(DIMENSIONS)}) SELECT id, round((a + b + c + d + e) * 0.2::DOUBLE, 6) AS composite FROM x")
def composite_score(spark, d):
    x = spark.createDataFrame(DIMENSIONS, "id int, a double, b double, c double, d double, e double")
    return x.select("id", F.round(evaluate.composite([F.col(k) for k in "abcde"]), 6).alias("composite"))


THINGS = [("person", "ann", ["annie", "an"]), ("person", "bob", []), ("person", "annabel", ["bell"]), ("topic", "sea trip", ["boat", "sail"]), ("topic", "work", ["office"]), ("event", "boat race", [])]
QUESTION = "did annie and bob take the boat to work with annabel"


@query(
    "WITH t(type, name, aliases) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c!r}::VARCHAR[])" for a, b, c in THINGS) + f"), h AS (SELECT * FROM t WHERE contains('{QUESTION}', name) OR len(list_filter(aliases, lambda a: contains('{QUESTION}', a))) > 0), r AS (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY length(name) DESC, name) AS rank FROM h) SELECT * FROM r WHERE rank <= 5"
)
def entity_link(spark, d):
    t = spark.createDataFrame(THINGS, "type string, name string, aliases array<string>")
    return search.entity_link(t, QUESTION).select("type", "name", "rank")


@query("SELECT 1 AS documents, true AS titled")
def memories_document(spark, d):
    f = spark.createDataFrame([(i, "preference" if i % 2 else "attitude", "likes", f"thing number {i}", i, 0.9, "p1") for i in range(40)], "rule int, category string, predicate string, object string, source_msg_id bigint, confidence double, subject string")
    m = documents.memories(f, "memories")
    return m.select(F.lit(1).alias("documents"), F.col("text").startswith("# memories").alias("titled"))
