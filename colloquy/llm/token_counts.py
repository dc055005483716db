"""Token counts of whole texts by overlap resynchronisation.

A text of over ``chunk`` characters is encoded in overlapping chunks by the library, each with its tokens' offsets. Two
neighbouring encodings are spliced at a stable common boundary inside their overlap; where the overlap has none,
it is doubled and the right chunk is encoded anew, at worst from the left chunk's start, and then the left chunk
grows. So an encoding spans little more than a chunk while boundaries can be found, and texts of any length take
bounded memory beside the text. A text of one chunk has nothing to splice; it is counted by its spans between stable
boundaries.

A boundary at character p is stable if p follows ASCII white space and precedes something else, for a tokenizer that
drops white space before it merges: then no token spans p and no merge can look across it, and normalisation (NFC,
lower case) works within what stands on either side. Whether a tokenizer does so is tried on it when it is loaded; with one
that doesn't, no boundary is stable and texts are encoded whole. A boundary is common if neither encoding has a
token across p. The tokens of the right chunk from p on are then those of the whole text, whatever stood before the chunk.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import table, text_batches

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 8_192, 256
#: Characters of texts of one chunk that are encoded together.
GROUP = 1_000_000
OVER = 2_048
SPACE = " \t\n\r"

#: Spans that a task remembers; beyond, it starts over.
MEMORY = 600_000

SPAN = re.compile(r"[^ \t\n\r]+")
BOUNDARY = re.compile(r"(?<=[ \t\n\r])(?=[^ \t\n\r])")

#: A token of a text as encoded: start, end.
Part = tuple[int, int]
Encode = Callable[[str], list[Part]]


def spliced(text: str, encode: Encode, chunk: int = CHUNK, overlap: int = OVERLAP, seen: dict[str, int] | None = None) -> int:
    """The number of tokens of ``text``; ``encode`` gives those of a chunk, with offsets in it. ``seen`` counts what was
    done: chunks encoded, splices, widened overlaps, grown chunks."""
    seen = {} if seen is None else seen

    def encoded(piece: str) -> list[Part]:
        seen["chunks"] = seen.get("chunks", 0) + 1
        return encode(piece)

    if len(text) <= chunk:
        return len(encoded(text))
    out = 0
    start, end = 0, chunk
    known = encoded(text[:chunk])  # the tokens from start on, relative to start
    while end < len(text):
        width = overlap
        while True:
            left = max(start, end - width)
            stop = min(len(text), left + max(chunk, 2 * width))
            found = encoded(text[left:stop])
            at = common(text, start, known, left, found, end)
            if at is not None or left == start:
                break
            width *= 2
            seen["widened"] = seen.get("widened", 0) + 1
        if at is None:  # no boundary in the whole chunk: it grows instead
            end = min(len(text), start + 2 * (end - start))
            known = encoded(text[start:end])
            seen["grown"] = seen.get("grown", 0) + 1
            continue
        seen["spliced"] = seen.get("spliced", 0) + 1
        out += bisect.bisect_right(known, at - start, key=itemgetter(1))
        first = bisect.bisect_left(found, at - left, key=itemgetter(0))
        known = [(a - (at - left), b - (at - left)) for a, b in found[first:]]
        start, end = at, stop
    return out + len(known)


def common(text: str, start: int, known: list[Part], left: int, found: list[Part], end: int) -> int | None:
    """The last stable boundary in text[left:end] that no part of either encoding spans."""
    for m in reversed(list(BOUNDARY.finditer(text, max(left, start + 1), end))):
        p = m.start()
        i = bisect.bisect_left(known, p - start, key=itemgetter(0)) - 1
        j = bisect.bisect_left(found, p - left, key=itemgetter(0)) - 1
        if p > left and (i < 0 or start + known[i][1] <= p) and (j < 0 or left + found[j][1] <= p):
            return p
    return None


class Counter:
    """Token counts of texts by one tokenizer of the tokenizers library, given as its JSON text. ``seen`` as in spliced()."""

    def __init__(self, model: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.seen: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.splits = self.drops_space()

    def tokens(self, text: str) -> list[Part]:
        """A chunk's tokens as parts, straight from the library."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def drops_space(self) -> bool:
        """White space is part of no token and leaves what stands beside it alone, in all that is tried."""
        words = ("a", "Zx9", ".", "'s", "\u00e9", "\u0301", "\u65e5\u672c", "\U0001f642")
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        for space in (*SPACE, "  ", "\r\n", " \n\t "):
            for x in words:
                for y in words:
                    text = x + space + y
                    if ids(text) != ids(x) + ids(y) or any(a < len(x) + len(space) and b > len(x) for a, b in self.tokens(text)):
                        return False
        return True

    def counts(self, texts: list[str]) -> list[int]:
        """Texts of over a chunk are encoded by overlapping chunks, each by itself, the others together."""
        out, group, held = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                out[i] = spliced(text, self.tokens, self.chunk, self.overlap, self.seen) if self.splits else len(self.tokens(text))
                continue
            group.append(i)
            held += len(text)
            if held > GROUP:
                self.count_group(texts, group, out)
                group, held = [], 0
        self.count_group(texts, group, out)
        return out

    def count_group(self, texts: list[str], group: list[int], out: list[int]) -> None:
        """Texts of one chunk have nothing to splice. Their counts are those of the spans between their stable boundaries;
        spans recur, and are encoded once while they are remembered."""
        if not self.splits:
            for i, found in zip(group, self.tokenizer.encode_batch_fast([texts[i] for i in group], add_special_tokens=False), strict=True):
                out[i] = len(found)
            return
        spans = [SPAN.findall(texts[i]) for i in group]
        new = set().union(*spans).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set().union(*spans)
        listed = list(new)
        self.known.update(zip(listed, map(len, self.tokenizer.encode_batch_fast(listed, add_special_tokens=False)), strict=True))
        for i, found in zip(group, spans, strict=True):
            out[i] = sum(map(self.known.__getitem__, found))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """A row for each row of ``docs``: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeated, each row is counted by itself.
    Texts hold their special tokens' strings as the library takes them. An empty table gives an empty result;
    other columns are ignored. ``model`` is the tokenizer's JSON text: it goes to the tasks with the function,
    so that executors need no file.
    """
    kind = docs.schema[id_col].dataType

    schema = f"id {kind.simpleString()}, n_bytes bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model, chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counter.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    text_batches(docs.sparkSession)
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's tokens by word_bpe_49k.json, or by the tokenizer at ``path``."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    return token_counts(table(spark, sf_dir, "documents"), model)
