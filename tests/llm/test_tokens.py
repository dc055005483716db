"""Token counts and SentencePiece against the libraries."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from hard_cases import HARD

from colloquy.llm import sentencepiece_fst as sp
from colloquy.llm import token_counts as tc


@pytest.fixture(scope="module")
def word_model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def piece_model():
    return sp.model_bytes()


ALPHABET = "ab'sS \n\t \u0301eéİςΣ1٣日🙂<|endoftext|> .,\x1c\x85"


def texts(seed, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) if r.random() < 0.9 else r.choice(["<|endoftext|>", " the", "ﬁ", "'ll", "▁▁", " " * 30, "tion"]) for _ in range(r.randrange(most))) for _ in range(n)]


def test_counts_equal_library(word_model):
    c = tc.Counter(word_model)
    small = [tc.Counter(word_model, *sizes) for sizes in ((8, 2), (16, 8), (40, 4))]
    for t in texts(1, 800, 200):
        want = len(c.tokenizer.encode(t, add_special_tokens=False))
        assert c.counts([t])[0] == want
        for s in small:
            assert s.counts([t])[0] == want
            assert tc.spliced(t, c.tokens, s.chunk, s.overlap) == want
    done = small[0].seen
    assert done["spliced"] > 1000 and done["widened"] > 100 and done["grown"] > 10


def test_long_texts_are_spliced(word_model):
    """What is done to a long text, and that the library never sees more of it than a few chunks at once."""
    c = tc.Counter(word_model)
    text = " ".join(random.Random(5).choice(["alpha", "beta,", "gamma.", "δέλτα", "x" * 70]) for _ in range(4000))
    pieces = []

    def encode(piece):
        pieces.append(len(piece))
        return c.tokens(piece)

    seen = {}
    assert tc.spliced(text, encode, 200, 8, seen) == len(c.tokens(text))
    assert max(pieces) <= 800 and seen["spliced"] >= len(text) / 800 and seen["widened"] > 10 and seen["chunks"] == len(pieces)
    whole = tc.Counter(word_model, 2048, 64)
    assert whole.counts([text, "a b"]) == [len(c.tokens(text)), 2] and whole.seen["spliced"] > 20


def test_boundaries_are_proven_by_the_tokenizer(word_model):
    """A tokenizer that puts white space into tokens has no stable boundaries; its texts are encoded whole."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        other = tc.Counter(f.read(), 16, 4)
    text = "the quick  brown fox jumps\n\nover the lazy dog " * 5
    assert tc.Counter(word_model).splits and not other.splits
    assert other.counts([text])[0] == len(other.tokenizer.encode(text, add_special_tokens=False)) and not other.seen


def test_token_counts_query(spark, docs, word_model):
    got = tc.token_counts(docs(HARD).withColumnRenamed("source", "n_tokens"), word_model).orderBy("doc_id").collect()
    c = tc.Counter(word_model)
    assert [r.n_tokens for r in got] == [len(c.tokenizer.encode(t or "", add_special_tokens=False)) for t in HARD]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in HARD]
    assert [r.over_limit for r in got] == [r.n_tokens > 2048 for r in got] and any(r.over_limit for r in got)
    assert tc.token_counts(docs([]), word_model).count() == 0
    twice = tc.token_counts(docs(["a b", "a b c"], [None, None]), word_model).collect()
    assert sorted(r.n_tokens for r in twice) == [2, 3]


def test_pieces_equal_library(piece_model):
    import sentencepiece

    lib, fst = sentencepiece.SentencePieceProcessor(model_proto=piece_model), sp.Transducer(piece_model)
    for t in texts(2, 2500, 80) + ["", " ", " " * 500 + "word" + " " * 333, "▁a ▁", "http://www.example.org/?a=1&b=2", "ab" * 3000]:
        ids = fst.encode(t)
        assert ids == lib.encode(t), t
        assert fst.decode(ids) == lib.decode(ids)
    spaces = fst.merges
    plain = random.Random(8)
    for _ in range(400):  # no path but the shortest is taken outside runs of white space
        t = "".join(plain.choice("abcdefgtion ,.éß") for _ in range(200)).replace("  ", " ").strip()
        before = fst.relaxations
        assert fst.encode(t) == lib.encode(t) and fst.relaxations > before
    assert fst.merges == spaces
    r = random.Random(3)
    for _ in range(500):
        ids = [r.randrange(32_000) if r.random() < 0.4 else r.randrange(259) for _ in range(r.randrange(12))]
        assert fst.decode(ids) == lib.decode(ids)


def test_both_searches_give_the_shortest_path(piece_model):
    fst = sp.Transducer(piece_model)
    r = random.Random(9)
    for _ in range(600):
        span = "".join(r.choice("abcdefghtinor") for _ in range(r.randrange(1, 20)))
        assert fst.relaxed(span) == fst.rest(-1, span) and fst.relaxed(span)[0] == 0.0
    words = [w for w in ("tokenisation", "internationalisation", "strength") if fst.characters.issuperset(w)]
    for w in words:  # of all paths one alone is finite
        finite, todo = [], [(0, -1, ())]
        while todo:
            at, last, path = todo.pop()
            if at == len(w):
                finite.append(path)
                continue
            todo += [(end, piece, (*path, piece)) for end, piece, _ in fst.arcs(w, at) if fst.follows.weight(last, piece) < sp.INFINITE]
        assert finite == [fst.relaxed(w)[1]]


def test_normaliser_states():
    for prefix, squeeze, want in ((True, True, "▁a▁b"), (False, True, "a▁b"), (True, False, "▁▁a▁▁b▁"), (False, False, "▁a▁▁b▁")):
        assert sp.Normaliser(prefix, squeeze).output(" a  b ") == want
    assert sp.Normaliser(True, True).output("   ") == "" == sp.Normaliser(True, False).output("")


def test_unigram_path_is_the_cheapest():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = False
    proto.normalizer_spec.remove_extra_whitespaces = True
    for piece, score, kind in (("<unk>", 0, 2), ("a", -3, 1), ("b", -3, 1), ("ab", -4, 1), ("ba", -3.5, 1), ("▁", -2, 1), ("aba", -8, 1)):
        p = proto.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    fst = sp.Transducer(proto.SerializeToString())
    spelt = lambda t: [fst.model.pieces[i] for i in fst.encode(t)]
    r = random.Random(4)
    for _ in range(200):
        span = "".join(r.choice("abc") for _ in range(r.randrange(1, 14)))
        a, b = fst.relaxed(span), fst.rest(-1, span)
        assert a[0] == pytest.approx(b[0])
        best = [0.0] + [sp.INFINITE] * len(span)  # by the textbook
        for i in range(len(span)):
            for end, _, w in fst.arcs(span, i):
                best[end] = min(best[end], best[i] + w)
        assert a[0] == pytest.approx(best[-1])
    assert spelt("aba") == ["a", "ba"] and spelt(" ab  ab ") == ["ab", "▁", "ab"] and spelt("c") == ["<unk>"]


def test_pieces_query(spark, docs, piece_model):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    got = sp.pieces_of(docs(HARD), piece_model).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [lib.encode(t or "") for t in HARD]
    assert [r.exact for r in got] == ["▁" not in (t or "") for t in HARD]
    assert sp.pieces_of(docs([]), piece_model).count() == 0
    assert "ids" not in sp.pieces_of(docs(["a"]), piece_model, with_ids=False).columns
