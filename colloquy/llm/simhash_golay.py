"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded with zeros to a 23-bit word of the
binary Golay code. That code is perfect: each word decodes to the one codeword within three bits. A segment's keys
are the indices of the codewords that it or any word one bit beside it decodes to: one of them or six. So two
segments that differ in at most one bit share a key. If two fingerprints differ in at most three bits, the two
segments with the fewest differing bits have at most one each (pigeonhole), so the fingerprints share a joint key
of two segments. Every link is found; what shares a joint key by chance is removed by counting the differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import kept, partitions, table, text_batches
from colloquy.operators.components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0b101011100011
#: Buckets up to SMALL give all their links, larger ones a link for each member; those over BLOCK are dealt out as pairs of blocks.
SMALL, BLOCK = 8, 4_096


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of a text's word shingles; 0 without words.

    Only A-Z are lower-cased, words are what ASCII white space separates, repeats count; a text of fewer words than
    a shingle is one shingle. A bit is 1 if it is set in over half the shingles' XXH64.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash_ = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) <= shingle:
        return hash_(joined)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    bits = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):  # bounded memory for very long texts
        part = np.fromiter((hash_(joined[a:b]) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)), np.uint64)
        bits += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(starts), bitorder="little").view(np.uint64)[0])


@lru_cache(1)
def decoder() -> np.ndarray:
    """For each of the 2^23 words, the 12-bit index of the codeword within three bits of it."""
    code = np.zeros(1 << 12, np.int64)
    for b in range(12):
        code ^= np.where(np.arange(1 << 12) >> b & 1, GENERATOR << b, 0)
    errors = np.array([sum(1 << i for i in at) for n in range(4) for at in combinations(range(23), n)])
    out = np.full(1 << 23, 0xFFFF, np.uint16)
    index = np.arange(1 << 12, dtype=np.uint16)
    for e in errors:
        out[code ^ e] = index
    return out


def segment_keys(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, 6): each segment value's codeword indices, with -1 where there are fewer."""
    dec = decoder()
    found = np.stack([dec[values], *(dec[values ^ (1 << i)] for i in range(bits))], axis=1).astype(np.int32)
    found.sort(axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    at = np.cumsum(first, axis=1) - 1
    out = np.full((len(values), 6), -1, np.int32)
    rows = np.nonzero(first)
    out[rows[0], at[rows]] = found[rows]
    return out


def joint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position, key): each fingerprint's joint keys."""
    return paired([segment_keys(bits_of(fps[:, 0], at, n), n) for at, n in SEGMENTS])


def bits_of(longs: np.ndarray, at: int, n: int) -> np.ndarray:
    return ((longs.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)


def paired(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position, key) of all pairs of segments and all pairs of their keys."""
    where, out = [], []
    for k, (a, b) in enumerate(combinations(keys, 2)):
        both = (a[:, :, None].astype(np.int64) << 12 | b[:, None, :]) | k << 24
        ok = (a[:, :, None] >= 0) & (b[:, None, :] >= 0)
        where.append(np.nonzero(ok)[0])
        out.append(both[ok])
    return np.concatenate(where), np.concatenate(out)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints; their longs are the last axis."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)).sum(axis=-1, dtype=np.int16)


def spanning(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a (b: None) or across a and b that join all that the linked pairs join: positions, a row for each
    member at most, not each pair. Each is a link itself, from a member to the nearest of those that were reached
    just before; the first row is reached first."""
    rows = a if b is None else np.concatenate([a, b])
    n, offset = len(rows), 0 if b is None else len(a)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = np.ones(n, bool)
    while todo.any():  # from each start, what it reaches is reached in waves
        wave = np.array([todo.argmax()])
        todo[wave] = False
        while len(wave) and todo.any():
            open_ = np.nonzero(todo)[0]
            best, parent = np.full(len(open_), radius + 1, np.int16), np.zeros(len(open_), np.int64)
            for part in np.array_split(wave, -(-len(wave) // 256)):
                d = distance(rows[part][:, None], rows[open_][None])
                if b is not None:
                    d[(part < offset)[:, None] == (open_ < offset)[None]] = radius + 1
                low = d.argmin(axis=0)
                value = d[low, np.arange(len(open_))]
                nearer = value < best
                best[nearer], parent[nearer] = value[nearer], part[low[nearer]]
            reached = best <= radius
            wave = open_[reached]
            out_a.append(parent[reached])
            out_b.append(wave)
            todo[wave] = False
    return np.concatenate(out_a), np.concatenate(out_b)


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (positions) within the buckets of rows sorted by key; and which rows are in buckets over ``block``, left for later."""
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    small = min(SMALL, block)
    at = np.nonzero((size > 1) & (size <= small))[0]
    for step in range(1, small):
        at = at[place[at] + step < size[at]]
        if not len(at):
            break
        hit = at[distance(fps[at], fps[at + step]) <= radius]
        x.append(hit)
        y.append(hit + step)
    large = (sizes > small) & (sizes <= block)
    for s, n in zip(starts[large], sizes[large], strict=True):
        a, b = spanning(fps[s : s + n], None, radius)
        x.append(a + s)
        y.append(b + s)
    return np.concatenate(x), np.concatenate(y), size > block


def mixed(h: np.ndarray) -> np.ndarray:
    """Another hash of unsigned hashes (the finaliser of splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def node(fps: np.ndarray) -> np.ndarray:
    """A fingerprint's number: itself if it is one long, else a hash of its longs."""
    if fps.shape[1] == 1:
        return fps[:, 0]
    return mixed(fps[:, 0].view(np.uint64) ^ mixed(fps[:, 1].view(np.uint64))).view(np.int64)


def links(fps: DataFrame, radius: int = 3, block: int = BLOCK, keys=joint_keys) -> DataFrame:
    """(src, dst): links that join all fingerprints (distinct rows of one or two longs) which differ in at most
    ``radius`` bits and share a key; with joint_keys and up to three bits, all that differ in so few.

    src and dst are the fingerprints' numbers (see node). Buckets of over ``block`` fingerprints are dealt out anew as
    pairs of blocks, so that no bucket has to fit a task.
    """
    if keys is joint_keys and not 0 <= radius <= 3:
        raise ValueError("the pigeonhole over three segments holds up to three bits")
    spark = fps.sparkSession
    cols = fps.columns
    longs = ", ".join(f"{c} bigint" for c in cols)
    width = len(cols)

    def read(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
        return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1) if batch.num_rows else np.zeros((0, width), np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = read(batch)
            for k in range(0, len(fp), 1024):
                at, key = keys(fp[k : k + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(fp[k : k + 1024, i][at]) for i in range(width))], ["key", *cols])

    names = ["late", *cols, "src", "dst"]

    def found(fp: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        a, b = node(fp[x]), node(fp[y])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(pairs), pa.int64()) for _ in range(1 + width)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)

    def late(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(fp[:, i]) for i in range(width)), pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int64())], names)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key, which may go on in the next batch
        hot: int | None = None

        def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            x, y, over = bucket_links(key, fp, radius, block)
            yield found(fp, x, y)
            if over.any():
                yield late(key[over], fp[over])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(zero_copy_only=False), read(batch, 1)
            if hot is not None:  # the rest of a bucket that is too large already
                n = int(np.searchsorted(key, hot, side="right"))
                if n:
                    yield late(key[:n], fp[:n])
                    key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            hot = None
            held.append((key, fp))
            key, fp = (np.concatenate(v) for v in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1], side="left"))
            yield from done(key[:cut], fp[:cut])
            held = [(key[cut:], fp[cut:])]
            if len(key) - cut > block:
                hot = int(key[-1])
                yield late(key[cut:], fp[cut:])
                held = []
        if held:
            yield from done(*held[0])

    n = partitions(spark)
    # a fingerprint becomes many rows, so the few bytes of all fingerprints are spread over all tasks first
    dealt = fps.repartition(n).mapInArrow(spread, f"key bigint, {longs}").repartition(n, "key").sortWithinPartitions("key", *cols)  # so that a class is reached from its smallest in all its buckets
    first = kept(dealt.mapInArrow(link, f"late bigint, {longs}, src bigint, dst bigint"))
    out = first.where("late is null").select("src", "dst").distinct()
    rest = first.where("late is not null").select(F.col("late").alias("key"), *cols)
    sizes = rest.groupBy("key").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
    if sizes.isEmpty():
        return out
    placed = rest.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64(*cols, F.lit(7)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    tasks = placed.withColumn("other", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *cols)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4 + width)], axis=1)
            held = now if held is None else np.concatenate([held, now])
            change = np.nonzero((held[1:, :3] != held[:-1, :3]).any(axis=1))[0] + 1
            for a, b in zip([0, *change[:-1]], change, strict=False):
                yield one(held[a:b])
            if len(change):
                held = held[change[-1] :]
        if held is not None and len(held):
            yield one(held)

    def one(rows: np.ndarray) -> pa.RecordBatch:
        side = rows[:, 3] == rows[:, 1]
        fp = np.ascontiguousarray(np.concatenate([rows[side, 4:], rows[~side, 4:]]))
        m = int(side.sum())
        x, y = spanning(fp, None, radius) if m == len(fp) else spanning(fp[:m], fp[m:], radius)
        return found(fp, x, y).select(["src", "dst"])

    blocks = tasks.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return out.union(blocks.mapInArrow(pair, "src bigint, dst bigint")).distinct()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for every row of ``docs``; fp as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    text_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """A row for each row of ``docs``: id, fp, component_id (the smallest id reachable over links of at most
    ``radius`` differing bits).

    Null and empty texts have the fingerprint zero and link like others. Rows with a null id keep it and take part;
    a class of null ids only has a null component. Repeated rows give repeated rows. An empty table gives none.
    Copies meet as one fingerprint before anything is compared; pairs of copies are never formed.
    """
    each = kept(fingerprints(docs, id_col, text_col, shingle))
    classes = kept(each.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    joined = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = kept(joined.select("fp", "root").join(smallest, "root").select("fp", "component_id"))
    return each.join(ids, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
