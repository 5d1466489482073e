"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly when each two neighbours are the encoding of theirs. So the
encoding of every prefix is fixed by its last token, and reading one more byte needs only the last tokens of the prefixes
at which a token may still begin. The transducer's state is the token before the last settled boundary and the bytes
after it; a boundary is settled, and the tokens before it are emitted, as soon as every token that could still begin
leads through it. States and transitions are made for what is met again and again and then looked up; the ends of rare
pieces are read by the same steps without making states for them.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelkit.llm.text import document_columns, per_batch

#: What is learned of states, pairs and pieces is forgotten beyond these counts; they bound memory and change no result.
MAX_STATES = 150_000
MAX_PAIRS = 250_000
MAX_PIECES = 200_000
#: Longer pieces aren't remembered.
PIECE_CHARS = 48
#: So many times a state may miss a transition before it gets any.
RARE = 8
#: Characters that are split into pieces at once.
BLOCK_CHARS = 1 << 20
#: Token ids that are decoded at once.
BLOCK_TOKENS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank (also the id) of a file with one base64 token and its rank per line."""

    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The definition: join the neighbours of the lowest rank (under `below`), the leftmost first, until none can be joined."""

    none = max(ranks.values()) + 1 if below is None else below
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
        if rank >= none:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BpeTransducer:
    """encode(piece) gives the token ids of one piece of text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: Of each token and each beginning of one: 2 * (token or -1) + (1 if a longer token begins so).
        self.parts = {token: 2 * rank for token, rank in ranks.items()}
        for token in ranks:
            for n in range(1, len(token)):
                self.parts[token[:n]] = self.parts.get(token[:n], -2) | 1
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple[bytes, list[int], list[int], list[int]]] = []
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.ends: list[tuple[int, ...] | None] = []
        self.missed: list[int] = []
        self._state(b"", [-1], [0], [0])

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes this one last; (token, token) for a byte, None if no joins of lower ranks do."""

        if token not in self._halves:
            whole = self.tokens[token]
            parts = merged(whole, self.ranks, below=token)
            self._halves[token] = (token, token) if len(whole) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def _fit(self, left: int, right: int) -> bool:
        """May these tokens stand side by side? left -1: right begins the piece.

        The joins that made both are undone, the latest first: they stand unless, at some time, the neighbours across the
        border could have been joined before the next of those joins.
        """

        found = self._fits.get((left, right))
        if found is not None:
            return found
        if len(self._fits) > MAX_PAIRS:
            self._fits.clear()
        self._fits[left, right] = found = self._undo(left, right)
        return found

    def _undo(self, left: int, right: int) -> bool:
        a, b, before = left, right, len(self.tokens)
        while True:
            undo_a, undo_b = self._split(a) if left >= 0 else (a, a), self._split(b)
            if undo_a is None or undo_b is None:  # made by joins of higher ranks, or not at all: follow the definition
                pair = [self.tokens[t] for t in (left, right) if t >= 0]
                return merged(b"".join(pair), self.ranks) == pair
            if left < 0:
                return True
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            # of equal ranks the leftmost join goes first: the border's comes before joins inside b, after those inside a
            if across is not None and across < before:
                return False
            whole_a, whole_b = undo_a[0] == a, undo_b[0] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                a, before = undo_a[1], a
            else:
                b, before = undo_b[0], b + 1

    def _state(self, tail: bytes, last: list[int], start: list[int], alive: list[int]) -> int:
        """tail: bytes since the settled boundary; of each prefix of it, last token (last[0]: the one before the boundary)
        and where that begins (-1: it can't be reached); alive: where a token may have begun that isn't ended."""

        key = (last[0], tail)
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.states)
            self.states.append((tail, last, start, alive))
            self.arcs.append({})
            self.ends.append(None)
            self.missed.append(0)
        return at

    @staticmethod
    def _path(last: list[int], start: list[int], end: int) -> tuple[int, ...]:
        out = []
        while end > 0:
            out.append(last[end])
            end = start[end]
        return tuple(out[::-1])

    def _read(self, tail: bytes, last: list[int], start: list[int], alive: list[int]) -> list[int]:
        """Take one prefix more of tail into last and start; returns the new alive places."""

        end, found, part_of = len(last), (-1, -1), self.parts.get
        still = []
        for begin in alive:
            part = part_of(tail[begin:end], -2)
            if part >= 0 and found[1] < 0:
                token = part >> 1
                fits = self._fits.get((last[begin], token))
                if self._fit(last[begin], token) if fits is None else fits:
                    found = (token, begin)
            if part & 1:
                still.append(begin)
        last.append(found[0])
        start.append(found[1])
        if found[1] >= 0:
            still.append(end)
        return still

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        tail, last, start, alive = self.states[state]
        tail, last, start = tail + bytes((byte,)), [*last], [*start]
        alive = self._read(tail, last, start, alive)
        heads = set(alive)
        while len(heads) > 1:  # back to the last boundary that all of them come through
            far = max(heads)
            heads.remove(far)
            heads.add(start[far])
        settled = heads.pop()
        emitted = self._path(last, start, settled)
        if settled:
            last, alive = last[settled:], [p - settled for p in alive]
            start = [0, *(p - settled if p >= settled else -1 for p in start[settled + 1 :])]
        out = self.arcs[state][byte] = (self._state(tail[settled:], last, start, alive), emitted)
        return out

    def _rest(self, state: int, rest: bytes) -> tuple[int, ...]:
        """The ids from a state to the end of the piece: _read() again and again, without making states."""

        tail, last, start, alive = self.states[state]
        begun, tail, last, start = len(tail) + 1, tail + rest, [*last], [*start]
        part_of, fit_of = self.parts.get, self._fits.get
        for end in range(begun, len(tail) + 1):
            token, at, still = -1, -1, []
            for begin in alive:
                part = part_of(tail[begin:end], -2)
                if at < 0 and part >= 0:
                    pair = (last[begin], part >> 1)
                    fits = fit_of(pair)
                    if self._fit(*pair) if fits is None else fits:
                        token, at = part >> 1, begin
                if part & 1:
                    still.append(begin)
            last.append(token)
            start.append(at)
            if at >= 0:
                still.append(end)
            alive = still
        return self._path(last, start, len(tail))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MAX_STATES:
            self._forget()
        out: list[int] = []
        state, arcs = 0, self.arcs
        for at, byte in enumerate(piece):
            arc = arcs[state].get(byte)
            if arc is None:
                self.missed[state] += 1
                if self.missed[state] <= RARE and len(piece) <= PIECE_CHARS:
                    out += self._rest(state, piece[at:])
                    return out
                arc = self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        ends = self.ends[state]
        if ends is None:
            tail, last, start, _ = self.states[state]
            ends = self.ends[state] = self._path(last, start, len(tail))
        out += ends
        return out


def _pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Remembered(dict):
    """Results of a function by text. When it is full, what was not asked for since it was last full is forgotten."""

    def __init__(self, find: Callable[[str], bytes]):
        self.find = find
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.find(text)
            if len(text) > PIECE_CHARS:
                return found
        if len(self) >= MAX_PIECES:
            self.older = dict(self)
            self.clear()
        self[text] = found
        return found


_SAFE_CUT = regex.compile(r"\p{L}(?= \p{L})")


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in blocks that are cut before a space between two letters, where a piece ends in any case."""

    begin = 0
    while len(text) - begin > size:
        cut = _SAFE_CUT.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.end()]
        begin = cut.end()
    yield text[begin:] if begin else text


class Tokenizer:
    """Pieces by a pattern, each encoded by the transducer."""

    def __init__(self, path: str, pattern: str):
        self.transducer = BpeTransducer(read_ranks(path))
        self.tokens = self.transducer.tokens
        self.split = regex.compile(pattern).findall
        self.pieces = _Remembered(lambda piece: _pack(self.transducer.encode(piece.encode())))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers."""

        find = self.pieces.__getitem__
        return b"".join(b"".join(map(find, self.split(block))) for block in blocks(text))

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of the tokens, a block of tokens at a time."""

        numbers, find = np.frombuffer(ids, "<u4"), self.tokens.__getitem__
        for at in range(0, len(numbers), BLOCK_TOKENS):
            yield b"".join(map(find, numbers[at : at + BLOCK_TOKENS].tolist()))


class Utf8Stream:
    """Incremental UTF-8 decoder: its state is the lead byte of an unfinished character and what followed it.

    feed() gives the text of all characters finished so far; bytes that can't belong to one become U+FFFD.
    """

    #: Lowest and highest second byte by lead byte where these aren't 80 and BF.
    SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self) -> None:
        self.held = b""

    @classmethod
    def _unfinished(cls, data: bytes) -> int:
        """Length of the begun character at the end of data."""

        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead < 0xC0:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            low, high = cls.SECOND.get(lead, (0x80, 0xBF))
            return back if back < need and (back == 1 or low <= data[1 - back] <= high) else 0
        return 0

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.held + data
        left = 0 if final else self._unfinished(data)
        self.held = data[len(data) - left :]
        return data[: len(data) - left].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id and ids (array of int), encoded without special tokens.

    Null and empty texts give an empty array. Rows are independent: repeated rows give repeated results. Texts of any
    length are encoded whole, in blocks. An empty table gives no rows. Columns other than doc_id and text aren't read.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        coder = tokenizer(path, pattern)
        yield {"doc_id": batch.column(0), "ids": [np.frombuffer(coder.encode(t or ""), "<u4").astype("int32") for t in batch.column(1).to_pylist()]}

    return per_batch(document_columns(docs), make, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of (doc_id, ids) rows: token bytes through the streaming decoder; null ids give an empty text."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        coder, texts = tokenizer(path, pattern), []
        for ids in batch.column(1).to_pylist():
            stream = Utf8Stream()
            texts.append("".join(map(stream.feed, coder.decode(np.array(ids or [], "<u4").tobytes()))) + stream.feed(b"", final=True))
        yield {"doc_id": batch.column(0), "text": texts}

    return per_batch(encoded.selectExpr("cast(doc_id as long) doc_id", "ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, restored (the decoded text is the text).

    The digests are of the ids as little-endian 32-bit integers and of the decoded bytes; null counts as empty.
    Nulls, empty and long texts, repeated rows, empty tables and other columns as in encode_documents().
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        coder = tokenizer(path, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "restored": []}
        for text in batch.column(1).to_pylist():
            text = text or ""
            ids = coder.encode(text)
            digest, stream, at, same = hashlib.sha256(), Utf8Stream(), 0, True
            for data in coder.decode(ids):
                digest.update(data)
                part = stream.feed(data)
                same = same and text.startswith(part, at)
                at += len(part)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(digest.hexdigest())
            out["restored"].append(same and at == len(text) and not stream.held)
        yield {"doc_id": batch.column(0)} | out

    return per_batch(document_columns(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, restored boolean")
