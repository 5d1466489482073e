import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelkit.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def opened(data):
    return tf.TokenFile(pa.PythonFile(__import__("io").BytesIO(data), "r"))


@pytest.mark.parametrize("top", [1, 200, 70_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_round_trip_and_random_access(top, n):
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** 3 * top).astype(np.uint32)
    if n:
        ids[0] = top
    file = opened(tf.pack([7, None], [n // 2, n], ids))
    assert file.doc_ids() == [7, None] and file.doc_ids(1, 2) == [None] and file.ends().tolist() == [n // 2, n]
    assert np.array_equal(file.tokens(0, n), ids)
    assert [file.token(i) for i in range(0, n, 7)] == ids[::7].tolist()
    for a in range(0, n, 97):
        assert np.array_equal(file.tokens(a, min(n, a + 130)), ids[a : a + 130])
    with pytest.raises(IndexError):
        file.token(n)


def test_few_bytes_are_read_for_a_token():
    ids = np.random.default_rng(1).integers(0, 2**20, 100_000).astype(np.uint32)
    read = []

    class Counted:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            read.append(n)
            return self.data[at : at + n]

    file = tf.TokenFile(Counted(tf.pack([1], [len(ids)], ids)))
    read.clear()
    assert file.token(77_777) == ids[77_777] and sum(read) <= 3 * (2 + 8 + 64)


def test_not_a_token_file():
    with pytest.raises(ValueError):
        opened(b"something else, and long enough to hold a head")


ROWS = [
    (5, "The Quick brown fox's  tail\tdidn't\x1cmove \x85 it　now é ́x"), (3, None), (9, ""), (1, "a" * 3000 + " " + "ab1" * 500), (None, "no id"),
    (3, "second text of three"), (3, "second text of three"), (12, "<|endoftext|> is text ΟΔΟΣ Σ. İstanbul 中文 字 \U0001f600\U0001f600"), (-4, "  \n "), (7, "long " * 30_000),
]


def expected(rows):
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    return [(i, coder.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]


def test_files_against_whole_texts(spark, documents):
    files = tf.write_tokens(documents(ROWS), PATH, file_tokens=2000).persist()
    assert files.count() > 1
    got = sorted(tf.read_tokens(files).collect(), key=lambda r: r.start)
    want = expected(ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == sorted((i is not None, i or 0, ids) for i, ids in want)
    ids = [-(10**9) if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    starts = np.cumsum([0] + [len(r.ids) for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    run = np.concatenate([r.ids for r in got])
    short = {r.start: r for r in tf.digest(files).collect()}
    for r in got:
        assert short[r.start].n_tokens == len(r.ids) and short[r.start].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    places = [0, 1, 5, len(run) - 1, len(run) // 2, 5, len(run), -1, None]
    asked = spark.createDataFrame([(p, "x") for p in places], "place long, id string")
    answered = sorted((r.place, r.id) for r in tf.tokens_at(files, asked, bin_tokens=1500).collect())
    assert answered == sorted((p, int(run[p])) for p in places if p is not None and 0 <= p < len(run))
    files.unpersist()


def test_many_repeats_of_one_document(documents):
    files = tf.write_tokens(documents([(4, "one text")] * 300 + [(2, "other")]), PATH, file_tokens=50)
    got = tf.digest(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [2] + [4] * 300 and len({r.ids_crc32 for r in got[1:]}) == 1


def test_empty_table(documents):
    files = tf.write_tokens(documents([]), PATH)
    assert files.count() == 0 and tf.digest(files).count() == 0


def ids_of(tool, texts):
    ids, counts = tool.encode([t.encode() for t in texts])
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tf, "MEMO", 50)
    tool = tf.Encoder(PATH)
    assert tool.cuts
    for _ in range(2):
        for (_, text), (_, ids) in zip(ROWS, expected(ROWS), strict=True):
            assert ids_of(tool, [text or ""])[0] + [1] == ids
            assert len(tool.hashes) <= 50 + 2 * len((text or "").split()) + 1100
    rng = np.random.default_rng(2)
    for _ in range(30):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, 200, 9)) for _ in range(3)]
        assert ids_of(tool, texts) == [ids[:-1] for _, ids in expected(list(enumerate(texts)))]
        assert len(tool.hashes) <= 50 + 60 and len(tool.store) <= 8 * len(tool.hashes) + 4000


@pytest.mark.parametrize("cuts", [True, False])
def test_words_and_pieces_like_whole_texts(cuts):
    rng = np.random.default_rng(8)
    signs = ["a", "B", "it's", "'", "'S", "'ll", "12", "x9", ",", ".", "--", " ", " ", "\n", "\x1f", "\x00", "\x01", "\x7f", "é", "É", "\u0301", "h\u0331", "H\u0331", "İ", "Σ", "ß", "\u00a0", "\u2003", "中", "\u212a", "<|endoftext|>", "</w>", "…", "٣"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(4000)]
    tool = tf.Encoder(PATH)
    tool.cuts = cuts
    assert tool.sign is not None
    want = [ids[:-1] for _, ids in expected(list(enumerate(texts)))]
    got = [x for k in range(0, 4000, 200) for x in ids_of(tool, texts[k : k + 200])]
    assert [(t, g) for t, g in zip(texts, got, strict=True)] == [(t, w) for t, w in zip(texts, want, strict=True)]
    clean = [t.replace("\x01", "\x02") for t in texts]
    assert ids_of(tool, clean) == [ids[:-1] for _, ids in expected(list(enumerate(clean)))]
