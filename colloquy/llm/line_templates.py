"""Line dedup with a log-template tree.

A line's tokens are what ASCII white space separates; a token with a digit (0-9) is a variable field from the start and reads
``<*>``. The tree has a fixed depth: token count first, then a run of leading tokens; so that a field among the leading
ones doesn't hide a line, trees on the middle and the last run stand beside it. A run is a half of the tokens (leading and last),
from ``thirds`` tokens on a third (leading, middle, last). Lines of under ``least`` tokens are in no leaf.

Each leaf learns its template from the different lines that it holds: at each position the token that most of them have is fixed, and a
position at which no single token leads is variable. A line belongs to the template if its fixed tokens cover
``share`` of the line's tokens; so lines that only share a leaf are not merged. Growing templates line by line, as a parser of one
log does, would depend on the order of lines; here what is learnt depends on the lines alone, all of it by
aggregations over different lines, which a line or leaf with very many copies enters once.

A line recurs if its whole masked text, or a template that it belongs to, is in two different documents (rows that repeat id and text
are one document). Of what recurs the first document (smallest id; rows of that id) keeps its lines, all others drop theirs. Where a line
recurs in two ways with two first documents, it is dropped in all documents, as each of the two has it from the other.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import few, kept, table, text_batches

LEAST, THIRDS, SHARE = 5, 12, 0.75
#: Keys of one long each that are broadcast at most.
LONGS = 1_000_000
#: Bytes of the bitmap of lines whose tokens are asked for; a power of two.
SIEVE = 1 << 19
MASK = 2**32 - 1
FREE = b"<*>"
DIGIT = re.compile(rb"[0-9]")


def masked(line: str) -> list[bytes]:
    """The line's tokens, variable fields masked."""
    return [FREE if not t.isalpha() and DIGIT.search(t) else t for t in line.encode().split()]  # at ASCII white space


def runs(n: int, least: int = LEAST, thirds: int = THIRDS) -> list[tuple[int, int]]:
    """The runs of positions that lead to a line's leaves."""
    if n < least:
        return []
    k = 3 if n >= thirds else 2
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def key_columns(id_col: str, text_col: str) -> list:
    """A document is an id with a text; rows that repeat both are one document."""
    return [F.col(f"`{id_col}`").alias("k_id"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("k_doc")]


def hashed(words: list[bytes]) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(b" ".join(words)) - 2**63


def parsed(docs: DataFrame, id_col: str, text_col: str, least: int, thirds: int) -> DataFrame:
    """(k_id, k_doc, line, chars, all_chars, whole, leaves): a row for each line with tokens, what it holds as
    hashes; all_chars are those of the document's lines with tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            at, number, chars, every, whole, leaves, ends = array("i"), array("i"), array("i"), array("i"), array("q"), array("q"), array("i", [0])
            for i in range(batch.num_rows):
                first = len(at)
                for j, line in enumerate((batch.column(2)[i].as_py() or "").split("\n")):
                    words = masked(line)
                    if not words:
                        continue
                    n = len(words)
                    at.append(i)
                    number.append(j)
                    chars.append(len(line))
                    whole.append(hashed(words))
                    for k, (a, b) in enumerate(runs(n, least, thirds)):
                        leaves.append(xxh3_64_intdigest(b"%d\t%d\t%s" % (n, k, b" ".join(words[a:b]))) - 2**63)
                    ends.append(len(leaves))
                total = sum(chars[first:])
                every.extend([total] * (len(at) - first))
            rows = pa.array(at, pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaves, pa.int64()))
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number, pa.int32()), pa.array(chars, pa.int32()), pa.array(every, pa.int32()), pa.array(whole, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["k_id", "k_doc", "line", "chars", "all_chars", "whole", "leaves"])

    schema = f"k_id {kind}, k_doc bigint, line int, chars int, all_chars int, whole bigint, leaves array<bigint>"
    return docs.select(*key_columns(id_col, text_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(parse, schema)


def sieve(wholes: DataFrame) -> bytes:
    """A bitmap of ``SIEVE`` bytes, whatever the number of lines: a line whose bit isn't set is none of them."""
    at = F.col("whole").bitwiseAND(8 * SIEVE - 1)
    word = wholes.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(whole & 63L as int))")).alias("bits"))
    bits = np.zeros(SIEVE // 8, np.int64)
    for r in word.collect():  # the bitmap's words at most
        bits[r["word"]] = r["bits"]
    return bits.tobytes()


def tokens_of(docs: DataFrame, text_col: str, wholes: DataFrame, least: int) -> DataFrame:
    """(whole, tokens): each asked line once, its tokens as checksums of 32 bits. Lines are parsed again for it: only those in leaves
    with something to learn need their tokens, and these are few. A bitmap keeps most others from being looked up."""
    bitmap = sieve(wholes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            found: dict[int, list[bytes]] = {}
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    words = masked(line)
                    if len(words) >= least:
                        h = hashed(words)
                        bit = h & (8 * SIEVE - 1)
                        if bitmap[bit >> 3] >> (bit & 7) & 1:
                            found[h] = words
            tokens = [np.fromiter(map(crc32, words), np.uint32, len(words)).view(np.int32) for words in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["whole", "tokens"])

    every = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(parse, "whole bigint, tokens array<int>")
    return every.join(few(wholes, limit=LONGS), "whole").dropDuplicates(["whole"])


def learnt(members: DataFrame, tokens: DataFrame, thirds: int, share: float) -> DataFrame:
    """(leaf, whole): the lines that belong to their leaf's template, from (leaf, k, whole), k the number of the run that
    leads to the leaf, and each line's (whole, tokens). The run's own tokens are fixed, so only the others are counted."""
    n, k = F.size("tokens"), F.col("k")
    parts = F.when(n >= thirds, 3).otherwise(2)
    start, end = F.floor(k * n / parts), F.floor((k + 1) * n / parts)
    place = lambda t, i: F.when((i < F.col("start")) | (i >= F.col("end")), F.shiftleft(i.cast("bigint"), 32) + t.cast("bigint") + F.lit(2**31))
    sized = members.join(tokens, "whole").select("leaf", "whole", "tokens", n.alias("n"), start.alias("start"), end.alias("end"))
    at = kept(sized.select("leaf", "whole", "n", (F.col("end") - F.col("start")).alias("run"), F.filter(F.transform("tokens", place), lambda x: x.isNotNull()).alias("places")))
    counts = at.select("leaf", F.explode("places").alias("place")).groupBy("leaf", "place").agg(F.count("*").alias("c"))
    # the token that leads, if one alone does: packed with its count into longs, largest and smallest token first
    token = F.col("place").bitwiseAND(MASK)
    packed = lambda t: F.max(F.shiftleft(F.col("c"), 32) + t)
    tops = counts.groupBy("leaf", F.shiftrightunsigned("place", 32).alias("pos")).agg(packed(token).alias("high"), packed(F.lit(MASK) - token).alias("low"))
    high = F.col("high").bitwiseAND(MASK)
    alone = tops.where(high == F.lit(MASK) - F.col("low").bitwiseAND(MASK))
    templates = alone.groupBy("leaf").agg(F.collect_list(F.shiftleft(F.col("pos"), 32) + high).alias("fixed"))  # a place for each of the line's tokens at most
    held = F.col("run") + F.size(F.array_intersect("places", "fixed"))
    return at.join(templates, "leaf").where(held >= F.ceil(F.col("n") * share)).select("leaf", "whole")


def recurring(docs: DataFrame, text_col: str, lines: DataFrame, least: int, thirds: int, share: float) -> DataFrame:
    """(whole, first, several): what recurs, the first document that has it, and whether that differs by the way it recurs."""
    wholes = lines.groupBy("whole").agg(F.min("k_id").alias("first"), F.min("k_doc").alias("low"), F.max("k_doc").alias("high"))
    exact = wholes.where("low <> high").select("whole", "first")
    leaves = lines.select("whole", F.posexplode("leaves").alias("k", "leaf"))
    # of leaves only those with different lines have something to learn
    open_ = kept(leaves.groupBy("leaf").agg(F.min("whole").alias("least"), F.max("whole").alias("most")).where("least <> most").select("leaf"))
    members = kept(leaves.join(few(open_, limit=LONGS), "leaf").select("leaf", "k", "whole").distinct())
    asked = kept(members.select("whole").distinct())
    belongs = kept(learnt(members, tokens_of(docs, text_col, asked, least), thirds, share))
    known = kept(lines.select("whole", "k_id", "k_doc").join(few(asked, limit=LONGS), "whole").groupBy("whole").agg(F.min("k_id").alias("first"), F.min("k_doc").alias("low"), F.max("k_doc").alias("high")))
    templates = belongs.join(known, "whole").groupBy("leaf").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    by_template = belongs.join(templates.select("leaf", "first"), "leaf").select("whole", "first")
    ways = exact.withColumn("exactly", F.lit(True)).unionByName(by_template.withColumn("exactly", F.lit(False)))
    found = ways.groupBy("whole").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.min(F.when(F.col("exactly"), F.col("first"))).alias("exact"))
    return kept(found.select("whole", F.coalesce("exact", "low").alias("first"), F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("several")))


def dropped(lines: DataFrame, ways: DataFrame) -> DataFrame:
    """(k_id, k_doc, line, chars, all_chars, first, several): the lines that go."""
    # always dealt by line: a broadcast that ends at some number of lines would change the plan as data grow
    again = lines.select("k_id", "k_doc", "line", "chars", "all_chars", "whole").join(ways.hint("merge"), "whole")
    return again.where(F.col("several") | ~F.col("k_id").eqNullSafe(F.col("first"))).drop("whole")


def whole_copies(gone: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(c_id, c_doc, original): near copies of one earlier document. Without the lines that go because of other documents,
    the lines from that one are, by characters, at least ``similarity`` of all lines of the two."""
    doc = ["k_id", "k_doc"]
    lost = gone.groupBy(*doc).agg(F.sum("chars").alias("lost"), F.max("all_chars").alias("all"))
    by = gone.groupBy(*doc, "first").agg(F.sum("chars").alias("shared")).groupBy(*doc).agg(F.max(F.struct("shared", "first")).alias("_m"))
    like = by.join(lost.withColumnRenamed("k_id", "l_id").withColumnRenamed("k_doc", "l_doc"), (F.col("k_doc") == F.col("l_doc")) & F.col("k_id").eqNullSafe(F.col("l_id")))
    mine = like.select(F.col("k_id").alias("c_id"), F.col("k_doc").alias("c_doc"), F.col("_m.first").alias("original"), F.col("_m.shared").alias("shared"), (F.col("all") - F.col("lost") + F.col("_m.shared")).alias("rest"))
    left = lines.groupBy(F.col("k_id").alias("original"), "k_doc").agg(F.max("all_chars").alias("all")).join(lost.select("k_doc", "lost"), "k_doc", "left")
    theirs = kept(left.groupBy("original").agg(F.max(F.col("all") - F.coalesce("lost", F.lit(0))).alias("other")))  # on its own, so that a document with very many copies can be split
    near = mine.where(F.col("shared") >= similarity * F.col("rest")).join(theirs, "original")
    return near.where(F.col("shared") >= similarity * (F.col("rest") + F.col("other") - F.col("shared"))).select("c_id", "c_doc", "original")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, thirds: int = THIRDS, share: float = SHARE, copies: float | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the text column cleaned, and n_lines, n_dropped beside them.

    With ``copies``, a document that is a near copy of one earlier document (see whole_copies) keeps the lines that it has
    from it, and loses the same lines as that one; so near copies stay near copies. Its other recurring lines go.
    A null text stays null and an empty one empty (no line is dropped); a document whose lines all recur keeps its
    row with an empty text. Null ids count as one id that comes last. Rows that repeat id and text are one
    document and are cleaned alike. Lines without tokens are never dropped. An empty table gives an empty result.
    Columns of the input named as ours are not allowed to be n_lines or n_dropped; they are replaced.
    """
    text_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = kept(parsed(docs, id_col, text_col, least, thirds))
    gone = dropped(lines, recurring(docs, text_col, lines, least, thirds, share))
    if copies is not None:
        gone = kept(gone)
        met = gone.join(whole_copies(gone, lines, copies), (F.col("k_doc") == F.col("c_doc")) & F.col("k_id").eqNullSafe(F.col("c_id")), "left")
        gone = met.where(F.col("several") | F.col("original").isNull() | (F.col("first") != F.col("original")))
    drops = gone.groupBy("k_id", "k_doc").agg(F.collect_set("line").alias("lines"))
    keys = key_columns(id_col, text_col)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), *keys)
    d = drops.select(F.col("k_id").alias("d_id"), F.col("k_doc").alias("d_doc"), "lines")
    joined = row.join(d, (F.col("k_doc") == F.col("d_doc")) & F.col("k_id").eqNullSafe(F.col("d_id")), "left")
    flat = joined.select(*(F.col("row").getField(c).alias(c) for c in others), F.col("lines").alias("n_dropped"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in others)).schema) + ", n_lines bigint, n_dropped bigint"
    at = others.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(len(others)).to_pylist(), strict=True):
                lines = [] if text is None else text.split("\n")
                gone = set(drop or ())
                texts.append("\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text)
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            columns = [batch.column(i) for i in range(len(others))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*others, "n_lines", "n_dropped"])

    return flat.mapInArrow(clean, schema)


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length("text").cast("bigint").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '-') || md5(coalesce(text, '')) AS k, text FROM documents),
ln AS (SELECT r, k, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM d),
tk AS (SELECT r, k, doc_id, j, list_transform(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM ln),
wl AS (SELECT *, len(t) AS n, array_to_string(t, ' ') AS w FROM tk WHERE len(t) > 0),
ex AS (SELECT w, min(doc_id) AS first FROM wl GROUP BY w HAVING count(DISTINCT k) >= 2),
dl AS (SELECT DISTINCT w, n, t, CASE WHEN n >= {THIRDS} THEN 3 ELSE 2 END AS parts FROM wl WHERE n >= {LEAST}),
lf AS (SELECT w, n, t, n || ':' || i || ':' || array_to_string(list_slice(t, i * n // parts + 1, (i + 1) * n // parts), ' ') AS leaf FROM dl, range(3) AS x(i) WHERE i < parts),
op AS (SELECT * FROM lf WHERE leaf IN (SELECT leaf FROM lf GROUP BY leaf HAVING count(*) >= 2)),
ps AS (SELECT leaf, w, n, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM op),
ct AS (SELECT leaf, pos, token, count(*) AS c FROM ps GROUP BY ALL),
tp AS (SELECT leaf, pos, arg_max(token, c) AS token FROM (SELECT *, max(c) OVER (PARTITION BY leaf, pos) AS m FROM ct) WHERE c = m GROUP BY leaf, pos HAVING count(*) = 1),
mb AS (SELECT ps.leaf, ps.w FROM ps JOIN tp USING (leaf, pos, token) GROUP BY ps.leaf, ps.w, ps.n HAVING count(*) >= ceil(ps.n * {SHARE})),
fl AS (SELECT leaf, min(doc_id) AS first FROM mb JOIN wl USING (w) GROUP BY leaf HAVING count(DISTINCT k) >= 2),
ways AS (SELECT w, first FROM ex UNION SELECT w, first FROM mb JOIN fl USING (leaf)),
dr AS (SELECT DISTINCT r, j FROM wl JOIN ways USING (w) WHERE doc_id <> first),
res AS (SELECT ln.r, count(*) AS n_lines, count(dr.j) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY ln.j) FILTER (dr.j IS NULL), '') AS text FROM ln LEFT JOIN dr ON ln.r = dr.r AND ln.j = dr.j GROUP BY ln.r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(res.text) AS n_chars_kept, md5(res.text) AS text_md5 FROM d LEFT JOIN res ON d.r = res.r
"""
