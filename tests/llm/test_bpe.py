import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from panelkit.llm import bpe
from panelkit.llm.bpe import BpeTransducer, Tokenizer, Utf8Stream, merged, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(autouse=True, params=[0, 4])
def rare(request, monkeypatch):
    """With and without states for what is met first."""
    monkeypatch.setattr(bpe, "RARE", request.param)


@pytest.fixture(scope="module")
def coder():
    return Tokenizer(PATH, public_tokenizers.PATTERN)


TEXTS = [
    "", " ", "\n\n  x", "Hello world, it's 2024!!", "naïve ÉCOLE ñandú ßtraße 東京 🙂🙂 ​", "=" * 1000, " " * 777 + "a", "a" * 5000, "don't DON'T we'll", "<|endoftext|> x", "\t\r\n mixed \x00 \x1f",
    "".join(chr(c) for c in range(0x20, 0x500)), "ab" * 3000, "-" * 131 + "=" * 67 + "_" * 129,
]


def test_like_tiktoken(coder, known):
    for text in TEXTS:
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == known.encode_ordinary(text), text[:40]
        assert b"".join(coder.decode(np.array(ids, "<u4").tobytes())) == text.encode()


def test_random_pieces_follow_the_definition(coder):
    rng = random.Random(7)
    letters = "etaoinshr dluENTIéßñ1230=-_.,'\n"
    ranks = coder.transducer.ranks
    for _ in range(1500):
        piece = "".join(rng.choices(letters, k=rng.randrange(1, 40))).encode()
        want = [ranks[piece]] if piece in ranks else [ranks[t] for t in merged(piece, ranks)]
        assert coder.transducer.encode(piece) == want


def test_small_vocabularies_with_ties_and_unreachable_tokens():
    rng = random.Random(11)
    for _ in range(60):
        ranks = {b"a": 0, b"b": 1, b"c": 2}
        while len(ranks) < 14:
            ranks.setdefault(bytes(rng.choices(b"abc", k=rng.randrange(2, 6))), len(ranks))
        machine = BpeTransducer(ranks)
        for _ in range(60):
            piece = bytes(rng.choices(b"abc", k=rng.randrange(1, 30)))
            want = [ranks[piece]] if piece in ranks else [ranks[t] for t in merged(piece, ranks)]
            assert machine.encode(piece) == want, (ranks, piece)


def test_lookahead_stays_bounded(coder):
    machine = BpeTransducer(coder.transducer.ranks)
    machine.encode(b"=" * 5000 + b"the" * 2000)
    assert max(len(tail) for tail, *_ in machine.states) <= 2 * machine.longest


def test_forgetting_changes_nothing(known, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    monkeypatch.setattr(bpe, "RARE", 0)
    small = Tokenizer(PATH, public_tokenizers.PATTERN)
    text = "Thntblere of then, edtioner in inea that esly " * 3
    assert np.frombuffer(small.encode(text), "<u4").tolist() == known.encode_ordinary(text)


def test_words_and_white_space(coder, known):
    rng = random.Random(3)
    parts = ["a", "É", "9", " ", " ", "  ", "\n", "\x1c", "\xa0", "'s", "!", ".x", "\t", "東"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 12)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == known.encode_ordinary(text), repr(text)


def test_blocks_cut_where_pieces_end(known):
    text = "".join(random.Random(2).choices(["word", " ", "  ", "É", " x", "\n", "9", "!", "'s"], k=4000))
    parts = list(bpe.blocks(text, 50))
    assert "".join(parts) == text and len(parts) > 20
    assert [i for p in parts for i in known.encode_ordinary(p)] == known.encode_ordinary(text)


def test_utf8_stream_at_every_cut():
    data = "aé東🙂z".encode() + b"\xff\xe2\x82" + "ok".encode() + b"\xed\xa0\x80\xf0\x9f"
    for size in range(1, 8):
        stream = Utf8Stream()
        parts = [stream.feed(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join(parts) + stream.feed(b"", final=True) == data.decode("utf-8", "replace")


def test_operator(documents, known):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (91, "word " * 300_000), (0, ""), (None, "x y")]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["restored"]) for r in bpe.round_trip(documents(rows), PATH, public_tokenizers.PATTERN).collect()}
    want = set()
    for i, t in rows:
        ids = known.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == want
    encoded = bpe.encode_documents(documents(rows), PATH, public_tokenizers.PATTERN)
    back = bpe.decode_documents(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted((str(r[0]), r[1]) for r in back.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip(documents([]), PATH, public_tokenizers.PATTERN).count() == 0
