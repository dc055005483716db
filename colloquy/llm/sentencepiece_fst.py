"""SentencePiece encoding and decoding as a shortest path in a weighted finite-state transducer.

Four machines are built from a model (tropical weights: sums along a path, the minimum across paths):
- ``Normaliser``: a transducer that reads characters and writes symbols: white space as U+2581, with a dummy prefix, and extra
  white space removed where the model says so;
- ``Pieces``: a loop of arcs that read a piece's symbols and write its id, kept as a trie;
- ``Bytes``: arcs that read one symbol which no piece holds, and write its UTF-8 bytes' ids (or the unknown id);
- ``Follows``: an acceptor over ids. For a merge (BPE) model its states are the last piece, and a piece may follow another at
  weight zero if encoding the two together yields just these two, else at infinite weight. A sequence of pieces is
  the merge encoding of what it spells if and only if all its neighbours pass, so one path alone stays finite. For a unigram model it has
  one state and weighs nothing; there the pieces' arcs weigh minus their score, and the path is the cheapest segmentation.

A text is composed with them lazily: states are (position, state of the acceptor), built when a path reaches them. ``relaxed``
relaxes them in the order of positions, for either kind of model. ``rest`` is the same recursion from the other end, for short spans: the cheapest
way from a state to the end, remembered across words, as words share their ends; it stops at a way that weighs nothing, as none weighs less.

Texts are composed in spans. No piece holds a pair of characters that never stand side by side in any piece, so no
path crosses between such a pair; spans recur and are solved once for each worker. What is normalised is never
cut, so texts of any length are encoded whole. Runs of nothing but white space, of which a merge model's pieces all score alike, are merged in the
model's order, as there neighbours alone don't tell the order.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import table, text_batches

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGE = 1, 2
INFINITE = float("inf")
NONE: tuple[float, tuple[int, ...]] = (INFINITE, ())
#: Spans up to which the search goes by remembered states; longer ones are relaxed from their start.
SHORT = 32
#: Words that a worker remembers; beyond, it starts over.
MEMORY = 1_200_000


class Model:
    """A model file's pieces and normaliser. Models with a character map or user-defined symbols are refused."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(data)
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.kind = proto.trainer_spec.model_type
        norm = proto.normalizer_spec
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        if norm.precompiled_charsmap or USER in self.types or self.kind not in (UNIGRAM, MERGE) or not self.escape or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model's normaliser or pieces are not supported")
        self.unknown = self.types.index(UNKNOWN)
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}


class Normaliser:
    """Characters to symbols. States: START before anything is written, INSIDE, and GAP behind white space that is
    written only if something follows it (where extra white space is removed)."""

    START, INSIDE, GAP = range(3)

    def __init__(self, prefix: bool, squeeze: bool):
        self.prefix, self.squeeze = prefix, squeeze

    def arc(self, state: int, c: str) -> tuple[int, str]:
        """(next state, symbols) for reading a character; all arcs weigh nothing."""
        if c == " " and self.squeeze:
            return (state if state == self.START else self.GAP), ""
        symbol = SPACE if c == " " else c
        before = SPACE if state == self.GAP or state == self.START and self.prefix else ""
        return self.INSIDE, before + symbol

    def output(self, text: str) -> str:
        state, out = self.START, []
        for c in text:
            state, symbols = self.arc(state, c)
            out.append(symbols)
        return "".join(out)


class Pieces:
    """The loop over pieces as a trie: a node is the id of the piece that ends there or -1, and the next symbols' nodes."""

    def __init__(self, ids: dict[str, int], weights: list[float]):
        self.root: list = [-1, {}]
        self.weights = weights
        self.longest = max(map(len, ids), default=0)
        for p, i in ids.items():
            node = self.root
            for c in p:
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i

    def arcs(self, span: str, at: int) -> list[tuple[int, int, float]]:
        """(end, id, weight) of the pieces that start at a position, the longest first."""
        following, end, out, weights = self.root[1], at, [], self.weights
        for c in span[at : at + self.longest]:
            node = following.get(c)
            if node is None:
                break
            piece, following = node
            end += 1
            if piece >= 0:
                out.append((end, piece, weights[piece]))
        out.reverse()
        return out


class Bytes:
    """What reads a symbol that no piece holds."""

    def __init__(self, model: Model, weight: float):
        self.bytes, self.unknown, self.weight = model.bytes, model.unknown, weight

    def output(self, c: str) -> list[int]:
        if self.bytes:
            return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
        return [self.unknown]


class Follows:
    """The acceptor: ``weight(last, piece)`` is zero or infinite, ``state(piece)`` where reading a piece leads. -1 is the start."""

    def __init__(self, model: Model, ids: dict[str, int]):
        self.model, self.ids, self.merges = model, ids, model.kind == MERGE
        self.known: dict[int, float] = {}

    def state(self, piece: int) -> int:
        return piece if self.merges else -1

    def weight(self, last: int, piece: int) -> float:
        if not self.merges:
            return 0.0
        key = last << 20 | piece if last >= 0 else -1 - piece
        known = self.known.get(key)
        if known is None:
            pieces = self.model.pieces
            whole, parts = (pieces[last] + pieces[piece], [last, piece]) if last >= 0 else (pieces[piece], [piece])
            known = self.known[key] = 0.0 if self.merged(whole) == parts else INFINITE
        return known

    def merged(self, text: str) -> list[int]:
        """Merges of best score, leftmost first; the acceptor's weights come from this, on two pieces at a time."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.model.scores[k] > best):
                    best, at = self.model.scores[k], i
            if at < 0:
                return [self.ids.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """A model's machines and the search in their composition. ``merges`` counts the spans that were merged in the model's
    order instead (runs of white space), ``relaxations`` the arcs that were relaxed."""

    def __init__(self, data: bytes, memory: int = MEMORY):
        self.model = m = Model(data)
        self.memory = memory
        self.ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == NORMAL}
        worst = min([m.scores[i] for i in self.ids.values()], default=0.0) - 10.0
        self.normaliser = Normaliser(m.prefix, m.squeeze)
        self.pieces = Pieces(self.ids, [0.0 if m.kind == MERGE else -s for s in m.scores])
        self.bytes = Bytes(m, 0.0 if m.kind == MERGE else -worst)
        self.follows = Follows(m, self.ids)
        self.merges = self.relaxations = 0
        self.characters = {c for p in self.ids for c in p}
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.prefixed: dict[str, tuple[int, ...]] = {}
        self.bare: dict[str, tuple[int, ...]] = {}
        self.states: dict[tuple[int, str], tuple[float, tuple[int, ...]]] = {}
        #: What each id spells; the bytes of longer UTF-8 sequences are put together in decode().
        self.surface = [p.replace(SPACE, " ") if t == NORMAL else m.unknown_surface if t == UNKNOWN else "" for p, t in zip(m.pieces, m.types, strict=True)]
        self.value = {i: b for b, i in m.bytes.items()}
        self.high = {i for i, b in self.value.items() if b > 127}
        for i, b in self.value.items():
            self.surface[i] = chr(b) if b < 128 else ""
        crossing = any(p[i] != SPACE and p[i + 1] == SPACE for p in self.ids for i in range(len(p) - 1))
        self.words = re.compile("(?s).+" if crossing else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.by_lines = not (crossing or m.squeeze or "\n" in self.characters)
        self.line_break = self.bytes.output("\n")

    def arcs(self, span: str, at: int) -> list[tuple[int, int, float]]:
        """(end, id, weight) of what reads symbols from a position on, the longest first; the bytes of a symbol that no piece holds
        have the id -2."""
        out = self.pieces.arcs(span, at)
        if not out or out[-1][0] != at + 1:
            out.append((at + 1, -2, self.bytes.weight))
        return out

    def path(self, span: str) -> tuple[int, ...]:
        """The ids on the shortest path."""
        if self.model.kind == MERGE and span[0] == SPACE == span[-1] and len(span) > 1 and set(span) == {SPACE}:
            return tuple(self.merged_run(span))
        if len(span) > SHORT:
            weight, path = self.relaxed(span)
        else:
            weight, path = self.rest(-1, span)
        if weight == INFINITE:  # no finite path: the pieces aren't closed under merging
            return tuple(self.merged_run(span))
        if -2 not in path:
            return path
        out: list[int] = []
        at = 0
        for piece in path:
            out += self.bytes.output(span[at]) if piece == -2 else [piece]
            at += 1 if piece == -2 else len(self.model.pieces[piece])
        return tuple(out)

    def relaxed(self, span: str) -> tuple[float, tuple[int, ...]]:
        """(weight, ids) of the shortest path: states (position, acceptor's state) relaxed in the order of positions."""
        n, weight, state = len(span), self.follows.weight, self.follows.state
        reached: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in range(n + 1)]  # weight, and from where by what
        reached[0][-1] = (0.0, -1, -1, -1)
        for at in range(n):
            here = reached[at]
            if not here:
                continue
            for end, piece, w in self.arcs(span, at):
                to, there = state(piece) if piece >= 0 else -1, reached[end]
                best = there.get(to, (INFINITE,))
                for last, (so_far, *_) in here.items():
                    self.relaxations += 1
                    total = so_far + w + (weight(last, piece) if piece >= 0 else 0.0)
                    if total < best[0]:
                        best = (total, at, last, piece)
                if best[0] < INFINITE:
                    there[to] = best
        if not reached[n]:
            return INFINITE, ()
        last = min(reached[n], key=lambda s: reached[n][s][0])
        total, out, at = reached[n][last][0], [], n
        while at:
            _, at, last, piece = reached[at][last]
            out.append(piece)
        return total, tuple(reversed(out))

    def rest(self, last: int, text: str) -> tuple[float, tuple[int, ...]]:
        """(weight, ids) of the shortest way from the state (last piece, text left to read) to the end."""
        found = self.states.get((last, text))
        if found is not None:
            return found
        weight, state, best, n = self.follows.weight, self.follows.state, NONE, len(text)
        for end, piece, w in self.arcs(text, 0):
            self.relaxations += 1
            step = w + (weight(last, piece) if piece >= 0 else 0.0)
            if step >= best[0]:
                continue
            if end == n:
                best = (step, (piece,))
            else:
                behind, path = self.rest(state(piece) if piece >= 0 else -1, text[end:])
                if step + behind < best[0]:
                    best = (step + behind, (piece, *path))
            if best[0] <= 0.0:
                break
        if last >= 0 and n <= 6:
            if len(self.states) >= self.memory // 2:
                self.states.clear()
            self.states[last, text] = best
        return best

    def merged_run(self, span: str) -> list[int]:
        """Merges of best score, leftmost first, with a heap, for spans of any length."""
        self.merges += 1
        text, nexts, befores = list(span), list(range(1, len(span) + 1)), list(range(-1, len(span) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = nexts[i]
            if j < len(text) and (k := self.ids.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (-self.model.scores[k], i, len(text[i]), len(text[j])))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nexts[i]
            if len(text[i]) != a or j >= len(text) or len(text[j]) != b or not a:
                continue
            text[i], text[j], nexts[i] = text[i] + text[j], "", nexts[j]
            if nexts[j] < len(text):
                befores[nexts[j]] = i
            offer(i)
            if befores[i] >= 0:
                offer(befores[i])
        return [i for p in text if p for i in ([self.ids[p]] if p in self.ids else self.bytes.output(p))]

    def spans(self, text: str) -> list[str]:
        """The normalised text cut wherever no piece can cross."""
        out, start, pairs = [], 0, self.pairs
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return out

    def solve(self, span: str) -> tuple[int, ...]:
        if len(span) <= 32 and self.characters.issuperset(span):
            return self.path(span)
        return tuple(i for part in self.spans(span) for i in self.path(part))

    def word(self, word: str, prefixed: bool) -> tuple[int, ...]:
        """A word's ids, with U+2581 before it or without; punctuation that nothing reads together with what stands
        before it is split off first."""
        memo = self.prefixed if prefixed else self.bare
        ids = memo.get(word)
        if ids is None:
            if len(memo) >= self.memory:
                memo.clear()
            if len(word) > 1 and word[-1] in ".," and word[-2:] not in self.pairs and word[-1] in self.ids:
                ids = (*self.word(word[:-1], prefixed), self.ids[word[-1]])
            else:
                ids = self.solve(SPACE + word if prefixed else word)
            if len(word) <= 64:
                memo[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The text's ids. No piece reads another character before U+2581 and none reads a line break (if the model
        is so), so each word of a line is a composition of its own."""
        m, out = self.model, []
        if not text:
            return out
        if not self.by_lines or SPACE in text or "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] == " ":
            for word in self.words.findall(self.normaliser.output(text)):
                one = word[:1] == SPACE and SPACE not in word[1:] and len(word) > 1
                out += self.word(word[1:], True) if one else self.solve(word) if SPACE in word else self.word(word, False)
            return out
        known, solve, first = self.prefixed, self.word, m.prefix
        for line in text.split("\n"):
            if out:
                out += self.line_break
            words = line.split(" ")
            if not first:
                out += solve(words[0], False) if words[0] else ()
                words = words[1:]
            first = False
            for word in words:
                ids = known.get(word)
                out += solve(word, True) if ids is None else ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that the ids spell; bytes that aren't UTF-8 read U+FFFD each, control ids spell nothing."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            out, held = [], bytearray()
            for i in ids:
                if i in self.high:
                    held.append(self.value[i])
                    continue
                if held:
                    out.append(utf8(bytes(held)))
                    held.clear()
                out.append(self.surface[i])
            text = "".join(out) + utf8(bytes(held))
        m = self.model
        first = next((i for i in ids if m.types[i] != CONTROL), None)
        strip = m.prefix and first is not None and m.types[first] == NORMAL and m.pieces[first].startswith(SPACE)
        return text[1:] if strip else text


def utf8(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def pieces_of(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, memory: int = MEMORY) -> DataFrame:
    """A row for each row of ``docs``: id, ids (unless ``with_ids`` is false), n_pieces, ids_md5, text_md5, exact.

    ids_md5 is the MD5 of the ids as little-endian 32-bit numbers; text_md5 that of the decoded text; exact says
    whether decoding gives the text back (it doesn't where the text holds U+2581 itself). A null text counts
    as empty: no ids. Ids of rows may be null or repeated; each row is encoded by itself. An empty table gives an
    empty result. ``model`` is the model file's content and goes to the tasks with the function; a worker remembers
    the ids of up to ``memory`` words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ("ids array<int>, " if with_ids else "") + "n_pieces bigint, ids_md5 string, text_md5 string, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        fst = Transducer(model, memory)
        for batch in batches:
            every, n, a, b, same = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = fst.encode(text)
                back = fst.decode(ids)
                if with_ids:
                    every.append(ids)
                n.append(len(ids))
                a.append(md5(array("i", ids).tobytes()).hexdigest())
                b.append(md5(back.encode()).hexdigest())
                same.append(back == text)
            columns = [batch.column(0), *([pa.array(every, pa.list_(pa.int32()))] if with_ids else []), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(["ids"] if with_ids else []), "n_pieces", "ids_md5", "text_md5", "exact"])

    text_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def model_bytes(path: str | None = None) -> bytes:
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_sentencepiece_fst(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document by piece_bpe_32k.model, or by the model at ``path``."""
    return pieces_of(table(spark, sf_dir, "documents"), model_bytes(path), with_ids=False)
