"""Near copies at a similarity of word shingles: the Golay-code fuzzy hashing of simhash_golay on wider fingerprints.

Two longs make a fingerprint of 126 bits, six segments of 21 bits (padded to the code's 23). Two texts of shingle
similarity J differ in about arccos(2 J / (1 + J)) / pi of the bits: 19 of 126 at J = 0.8, 13 at 0.9, 8 at 0.96. Such
fingerprints have segments with few differing bits; two segments of a long that share a key each give a joint key
(six pairs of segments, about 170 keys for a text). Links of fingerprints that share a joint key and differ in at
most ``RADIUS`` bits put texts into groups. They only span what is near, so they are not what is verified: within a
group every pair of texts is compared by all its shingles' hashes, unless verified links join the two already.
Groups of over ``BLOCK`` hashes are dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import kept, partitions, text_batches
from colloquy.llm.simhash_golay import bits_of, links, mixed, node, paired, segment_keys
from colloquy.operators.components import components

RADIUS, SIMILARITY = 25, 0.8
SEGMENT = 21
#: Hashes of a group's block; a task holds two blocks.
BLOCK = 1 << 19


def wide_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint keys of the pairs of each long's three segments."""
    a, b = (paired([segment_keys(bits_of(fps[:, w], at, SEGMENT), SEGMENT) for at in (0, SEGMENT, 2 * SEGMENT)]) for w in (0, 1))
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + (3 << 24)])


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; words as in simhash_golay.fingerprint."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hash_ = partial(xxhash.xxh64_intdigest, seed=seed)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([hash_(joined)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - shingle + 1].tolist()
    return np.fromiter((hash_(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The 63 bits that over half of the hashes have."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0]) & (2**63 - 1)


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, hash, a, b, fp, node, n) of every row: the text's hash, the fingerprint and its number, the number of
    the set of shingles and its size; no words: zeros."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            a, b, nodes, n = [], [], [], []
            for text in batch.column(2):
                h = shingle_hashes(text.as_py(), shingle)
                a.append(majority(h))
                b.append(majority(mixed(h)))
                different = np.unique(h)
                nodes.append(xxh64_intdigest(different.tobytes()) - 2**63)
                n.append(len(different))
            fps = np.array([a, b], np.int64).T.copy().reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(node(fps)), pa.array(nodes, pa.int64()), pa.array(n, pa.int64())], ["id", "hash", "a", "b", "fp", "node", "n"])

    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(run, f"id {kind}, hash bigint, a bigint, b bigint, fp bigint, node bigint, n bigint")


def alike(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join all that the pairs of sets as similar as asked join, within the sets (side: None)
    or across the two sides. Sets hold different hashes, one at least. A pair is left uncompared only if the links
    join it already."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    mark = np.zeros(int(codes.max()) + 1, bool)
    todo = np.ones(len(sets), bool)
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while todo.any():  # from each start, all that it reaches
        wave = [int(todo.argmax())]
        todo[wave[0]] = False
        while wave and todo.any():
            at = wave.pop()
            mine = codes[starts[at] : starts[at] + sizes[at]]
            mark[mine] = True
            both = np.add.reduceat(mark[codes], starts, dtype=np.int64)
            mark[mine] = False
            ok = todo & (both / (sizes + sizes[at] - both) >= similarity)
            if side is not None:
                ok &= side != side[at]
            reached = np.nonzero(ok)[0]
            todo[reached] = False
            x.append(np.full(len(reached), at))
            y.append(reached)
            wave.extend(reached.tolist())
    return np.concatenate(x), np.concatenate(y)


def verified(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(src, dst): links that join all texts of a group which are as similar as asked, or are joined by such pairs.
    members: (group, blocks, node, some), a row for each text to compare, of id and hash ``some``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sets, pa.binary())], ["group", "blocks", "node", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bool, np.ndarray]] = {}  # of the last pair of blocks, which may go on in the next batch
        last: tuple | None = None

        def done() -> tuple[np.ndarray, np.ndarray]:
            nodes, sides = np.fromiter(held, np.int64, len(held)), np.array([v[0] for v in held.values()])
            x, y = alike([v[1] for v in held.values()], None if last[1] == last[2] else sides, similarity)
            return nodes[x], nodes[y]

        def rows(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["src", "dst"])

        for batch in batches:
            found = []
            for group, i, j, block, number, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (group, i, j) != last:
                    if len(held) > 1:
                        found.append(done())
                    held, last = {}, (group, i, j)
                held[number] = (block == i, np.frombuffer(data, np.uint64))
            if found:
                yield rows(found)
        if len(held) > 1:
            yield rows([done()])

    n = partitions(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    texts = rows.join(members, (F.col("hash") == F.col("some.hash")) & F.col("id").eqNullSafe(F.col("some.id")))
    sets = texts.select("group", "blocks", "node", "text").mapInArrow(cut, "group bigint, blocks bigint, node bigint, set binary")
    placed = sets.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    pairs = placed.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "set")
    return pairs.repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j", "node").mapInArrow(compare, "src bigint, dst bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs``: id and component_id, the smallest id reachable over links of texts whose word
    shingles are as similar as asked.

    Texts with the same set of shingles count as one text; those with the same fingerprint only are compared. Null and empty texts are one class. Rows with null ids keep
    them and take part; repeated rows give repeated rows; an empty table gives none. Links within ``similarity`` are found
    with the probability that the shared keys give (see README), never between texts that are less similar.
    """
    each = kept(described(docs, id_col, text_col, shingle))
    classes = kept(each.groupBy("a", "b", "fp", "node").agg(F.min("id").alias("first"), F.min(F.struct("id", "hash")).alias("some"), F.max("n").alias("n")))
    full = classes.where("n > 0")
    near = components(links(full.select("a", "b").distinct(), RADIUS, keys=wide_keys)).select(F.col("node").alias("fp"), "root")
    members = kept(full.join(near, "fp", "left").select(F.coalesce("root", "fp").alias("group"), "node", "some", "n"))
    groups = kept(members.groupBy("group").agg(F.count("*").alias("texts"), F.ceil(F.sum("n") / BLOCK).alias("blocks")).where("texts > 1"))  # on its own, so that a large group can be split
    roots = components(verified(docs, members.join(groups, "group").select("group", "blocks", "node", "some"), id_col, text_col, shingle, similarity))
    joined = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = kept(joined.select("node", "root").distinct().join(smallest, "root").select("node", "component_id"))
    return each.select("id", "node").join(ids, "node").select(F.col("id").alias(id_col), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each class of near copies: the one with the smallest id
    (null ids last, then by the text's hash). Null and empty texts are one class. Rows that repeat id and text are one
    class and leave one row. An empty table gives an empty result."""
    id_, hash_ = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    key = F.struct(id_.isNull().alias("none"), id_.alias("id"), hash_.alias("hash"))
    found = near_copies(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), "key", "text", shingle, similarity)
    winners = kept(found.where(F.col("key") == F.col("component_id")).groupBy("key").agg(F.count("*").alias("rows")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_.alias("id"), hash_.alias("hash"))

    def chosen(some: DataFrame) -> DataFrame:
        w = some.select(F.col("key.id").alias("w_id"), F.col("key.hash").alias("w_hash"))
        return rows.join(w, (F.col("hash") == F.col("w_hash")) & F.col("id").eqNullSafe(F.col("w_id")), "left_semi")

    once = chosen(winners.where("rows = 1"))
    repeated = winners.where("rows > 1")
    if not repeated.isEmpty():  # only what repeats is gathered to leave one row of each
        once = once.unionByName(chosen(repeated).dropDuplicates(["id", "hash"]))
    return once.select("row.*")
