"""Token ids in binary files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k of a file holds the k-th chunks of all ids that have one, each
with a continuation bit that says whether level k + 1 goes on; the place there is the number of set bits before it, which
a directory of counts every 512 bits gives with one short look. Any token is read by a few small reads, one or two a level,
without decoding what comes before it.

File layout, little-endian: magic, number of levels, documents and tokens, chunks of each level; validity bits of the
document ids, the ids, and the end of each document in tokens; then, of each level, chunks, continuation bits and directory
(the last level needs no bits). Files are written by tasks that hold documents in ascending order. A file gets a new name
at each attempt, and only the manifest table, written by Spark from the tasks that succeeded, names the files that count.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelkit.llm.text import WHITESPACE, chunks, document_columns, hash_runs, per_batch, word_runs
from panelkit.session import shared_folder

MAGIC = b"DACTOKS1"
#: Bits between two counts of a rank directory.
RANK_BITS = 512
#: The end id that closes each document.
END_ID = 1
#: A file is closed once it holds so many tokens (it takes whole documents, so a long one may go beyond).
FILE_TOKENS = 1 << 23
#: Bytes of text that are encoded at once.
TEXT_BYTES = 1 << 22
#: Words and pieces of words that a worker remembers (beside those of a batch), about 50 bytes each.
MEMO = 1 << 20
#: Fixed value: the pattern of word tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A sign that the pattern keeps apart from words when white space is around it.
_SIGN = b"\x01"
#: Kinds of bytes: white space, letters, digits, other signs, and those of words that aren't cut.
_DIGIT, _ODD = 2, 4
_KINDS = np.array([0 if WHITESPACE[c] else _ODD if c >= 128 or c == 0x27 else _DIGIT if 48 <= c <= 57 else 1 if chr(c).isalpha() else 3 for c in range(256)], np.uint8)
#: Tokens that a scan of a file decodes at once, at most (more only if a single document is longer).
SCAN_TOKENS = 1 << 20

_HEAD = struct.Struct("<8sIQQ")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def pack(doc_ids: list[int | None], ends: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a file: documents with their ends (in tokens) and all their ids (unsigned 32 bits)."""

    levels: list[tuple[np.ndarray, np.ndarray | None]] = []
    rest = ids.astype(np.uint32, copy=False)
    while len(rest):
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        rest = rest[more] >> np.uint32(8)
    out = [_HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)), np.array([len(c) for c, _ in levels], "<u8").tobytes()]
    known = np.array([d is not None for d in doc_ids], bool)
    out += [np.packbits(known, bitorder="little").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(ends, "<u8").tobytes()]
    for k, (chunk, more) in enumerate(levels):
        out.append(chunk.tobytes())
        if k < len(levels) - 1:
            bits = np.packbits(more, bitorder="little")
            out += [bits.tobytes(), directory(bits).astype("<u8").tobytes()]
    return b"".join(out)


def directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before every RANK_BITS-th place."""

    step = RANK_BITS // 8
    counts = np.add.reduceat(_BITS[bits], np.arange(0, len(bits), step)) if len(bits) else np.zeros(0, np.int64)
    return np.cumsum(counts) - counts


class TokenFile:
    """Random access to a file of directly addressable codes; only the parts that a call needs are read."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        head = source.read_at(_HEAD.size, 0)
        magic, levels, self.n_docs, self.n_tokens = _HEAD.unpack(head) if len(head) == _HEAD.size else (b"", 0, 0, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.sizes = np.frombuffer(source.read_at(8 * levels, _HEAD.size), "<u8").astype(np.int64)
        self._known = _HEAD.size + 8 * levels
        self._ids = self._known + -(-self.n_docs // 8)
        self._ends = self._ids + 8 * self.n_docs
        at, self._places = self._ends + 8 * self.n_docs, []
        for k, n in enumerate(self.sizes.tolist()):
            bits, last = -(-n // 8), k == levels - 1
            self._places.append((at, at + n, at + n + bits))
            at += n if last else n + bits + 8 * -(-n // RANK_BITS)

    def doc_ids(self, first: int = 0, stop: int | None = None) -> list[int | None]:
        stop = self.n_docs if stop is None else stop
        known = np.unpackbits(np.frombuffer(self.source.read_at(-(-stop // 8) - first // 8, self._known + first // 8), np.uint8), bitorder="little")[first % 8 :]
        ids = np.frombuffer(self.source.read_at(8 * (stop - first), self._ids + 8 * first), "<i8")
        return [int(i) if ok else None for i, ok in zip(ids, known, strict=False)]

    def ends(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_docs if stop is None else stop
        return np.frombuffer(self.source.read_at(8 * (stop - first), self._ends + 8 * first), "<u8").astype(np.int64)

    def _rank(self, level: int, place: int) -> int:
        """Continuation bits set before a place."""

        if place == 0:
            return 0
        block, start = divmod(place, RANK_BITS)
        if place == self.sizes[level]:
            return int(self.sizes[level + 1])
        _, bits, counts = self._places[level]
        before = int.from_bytes(self.source.read_at(8, counts + 8 * block), "little")
        held = np.frombuffer(self.source.read_at(start // 8 + 1, bits + block * (RANK_BITS // 8)), np.uint8)
        return before + int(np.unpackbits(held, bitorder="little")[:start].sum())

    def token(self, place: int) -> int:
        """The id at a place of the file."""

        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = 0
        for level, (chunk, bits, _) in enumerate(self._places):
            value |= self.source.read_at(1, chunk + place)[0] << (8 * level)
            if level == len(self._places) - 1 or not self.source.read_at(1, bits + place // 8)[0] >> (place % 8) & 1:
                break
            place = self._rank(level, place)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop."""

        if not 0 <= start <= stop <= self.n_tokens:
            raise IndexError((start, stop))
        out, where = np.zeros(stop - start, np.uint32), None
        for level, (chunk, bits, _) in enumerate(self._places):
            if start == stop:
                break
            part = np.frombuffer(self.source.read_at(stop - start, chunk + start), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            if level == len(self._places) - 1:
                break
            held = np.frombuffer(self.source.read_at(-(-stop // 8) - start // 8, bits + start // 8), np.uint8)
            more = np.flatnonzero(np.unpackbits(held, bitorder="little")[start % 8 : start % 8 + stop - start])
            where = more if where is None else where[more]
            start = self._rank(level, start)
            stop = start + len(more)
        return out


def store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder that all executors reach (a URI or an absolute path)."""

    return pyarrow.fs.FileSystem.from_uri(folder)


def _cut(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [ids[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]


class Encoder:
    """Token ids of whole texts.

    For tokenizers to which white space is a border that leaves no trace, as for word tokenizers: a text's ids are then
    those of its words. Where the tokenizer's file lower-cases and has the pattern PATTERN, words of ASCII characters
    without apostrophes are cut at the pattern's borders too, since their pieces come again far more often. Distinct words
    and pieces go to the tokenizer once while they are remembered (by a 64-bit hash), many in one text.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # names of special tokens in a text are text
        made = json.loads(self.tokenizer.to_str())
        parts = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = made["model"].get("end_of_word_suffix")
        self.cuts = parts[0].get("pattern") == {"Regex": PATTERN} and "Lowercase" in str(made.get("normalizer")) and bool(suffix)
        vocabulary = self.tokenizer.get_vocab()
        alone = self._ids(_SIGN)
        self.sign = int(alone[0]) if len(alone) == 1 else None
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        #: What is remembered, sorted by hash: the ids of entry k are store[starts[k]:starts[k] + sizes[k]]; used counts calls.
        self.hashes, self.starts, self.sizes, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.calls = np.zeros(0, np.uint32), 0

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _alone(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(c.ids, np.uint32) for c in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces that the pattern doesn't cut: in the ids of all of them, each ends with a token that ends a word."""

        ids = self._ids(b" ".join(pieces))
        ends = np.flatnonzero(self.last[ids]) + 1
        return _cut(ids, np.r_[0, ends[:-1]], ends) if len(ends) == len(pieces) else self._alone(pieces)

    def _words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of any words: encoded in one text, with a sign between them that none of them holds and that has one id."""

        if self.sign is None or not words or any(_SIGN in w for w in words):
            return self._alone(words)
        ids = self._ids((b" " + _SIGN + b" ").join(words))
        signs = np.flatnonzero(ids == self.sign)
        return _cut(ids, np.r_[0, signs + 1], np.r_[signs, len(ids)]) if len(signs) == len(words) - 1 else self._alone(words)

    def _units(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each word or piece, whether it is a word that isn't cut, and the bytes (pieces lower-cased)."""

        kind = _KINDS[data]
        starts, ends = word_runs(data)
        odd = np.r_[0, np.cumsum(kind >= _ODD)]
        whole = odd[ends] > odd[starts] if self.cuts else np.ones(len(starts), bool)
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[whole]] += 1
        step[ends[whole]] -= 1
        uncut = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        begins = (kind > 0) & ~uncut & ((kind != np.r_[np.uint8(0), kind[:-1]]) | (kind == _DIGIT))
        begins[starts] = True
        at = np.flatnonzero(begins)
        word = np.searchsorted(starts, at, side="right") - 1
        sizes = np.minimum(np.r_[at[1:], len(data)], ends[word]) - at
        upper = (data >= 0x41) & (data <= 0x5A) & ~uncut
        return at, sizes, whole[word], np.where(upper, data | 0x20, data)

    def _learn(self, hashes: np.ndarray, units: list[bytes], whole: np.ndarray) -> None:
        """Remember new entries; beyond MEMO the half that was used longest ago is forgotten."""

        coded: list = [None] * len(units)
        for mine, code in ((np.flatnonzero(whole), self._words), (np.flatnonzero(~whole), self._pieces)):
            if len(mine):
                for k, ids in zip(mine.tolist(), code([units[k] for k in mine.tolist()]), strict=True):
                    coded[k] = ids
        keep = np.ones(len(self.hashes), bool)
        if len(self.hashes) > MEMO:
            keep = (self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]) | (self.used == self.calls)
            self.store, self.starts = gather(self.store, self.starts[keep], self.sizes[keep]), np.cumsum(self.sizes[keep]) - self.sizes[keep]
        else:
            self.starts = self.starts[keep]
        sizes = np.array([len(c) for c in coded], np.int64)
        every = np.r_[self.hashes[keep], hashes]
        order = np.argsort(every)
        self.hashes = every[order]
        self.starts = np.r_[self.starts, len(self.store) + np.cumsum(sizes) - sizes][order]
        self.sizes = np.r_[self.sizes[keep], sizes][order]
        self.used = np.r_[self.used[keep], np.full(len(sizes), self.calls)][order]
        self.store = np.concatenate([self.store, *coded])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many of them each text has."""

        data = np.frombuffer(b"\n".join(texts), np.uint8)
        lengths = np.array([len(t) + 1 for t in texts])
        at, sizes, whole, data = self._units(data)
        hashes, first, unit = np.unique(hash_runs(data[_KINDS[data] > 0], sizes), return_index=True, return_inverse=True)
        self.calls += 1
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        self.used[place[known]] = self.calls
        if not known.all():
            new = first[~known]
            raw = data.tobytes()
            self._learn(hashes[~known], [raw[a : a + n] for a, n in zip(at[new].tolist(), sizes[new].tolist(), strict=True)], whole[new])
            place = np.searchsorted(self.hashes, hashes)
        place = place[unit]
        counts = np.r_[0, np.cumsum(self.sizes[place])]
        texts_at = np.searchsorted(at, np.r_[np.cumsum(lengths) - lengths, len(data) + 1])
        return gather(self.store, self.starts[place], self.sizes[place]), np.diff(counts[texts_at])


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start:start + size], one after the other."""

    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path)


_FILES = "file string, first_id long, first_hash long, first_row long, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, *, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode whole texts, add end_id to each, and write the ids in ascending doc_id order; returns the table of files.

    One row per file: file, start (ids in all files before it), n_docs, n_tokens. The folder is one that all executors
    reach, by default a new one in the session's shared folder. Null and empty texts have the end id alone. Documents
    without a doc_id come first. Rows that share a doc_id are ordered by a hash of the text; rows that repeat both are
    written once each. An empty table gives no file and an empty table of files. Other columns of docs are not read.
    """

    spark = docs.sparkSession
    folder = f"{folder or shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    ordered = document_columns(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("doc_id"), "h", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "row")

    def close(fs: pyarrow.fs.FileSystem, path: str, held: list[tuple], coded: list[np.ndarray], ends: list[int]) -> pa.RecordBatch:
        name = f"{uuid.uuid4().hex}.dac"
        with fs.open_output_stream(f"{path}/{name}") as out:
            out.write(pack([h[0] for h in held], ends, np.concatenate(coded)))
        first = held[0]
        return pa.RecordBatch.from_pylist(
            [{"file": f"{folder}/{name}", "first_id": first[0], "first_hash": first[1], "first_row": first[2], "n_docs": len(held), "n_tokens": ends[-1]}],
            schema=pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("first_id", "first_hash", "first_row", "n_docs", "n_tokens"))]),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        tool = encoder(tokenizer)
        held, coded, ends = [], [], []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            for some, texts in chunks(keys, batch.column(1).to_pylist(), TEXT_BYTES):
                ids, counts = tool.encode(texts)
                stops = np.cumsum(counts)
                ids, begin = np.insert(ids, stops, np.uint32(end_id)), 0
                stops += np.arange(1, len(some) + 1)
                while begin < len(some):
                    # documents up to the one that fills the file
                    room, done = file_tokens - (ends[-1] if ends else 0), int(stops[begin - 1]) if begin else 0
                    stop = min(len(some), int(np.searchsorted(stops, done + room)) + 1)
                    ends += ((ends[-1] if ends else 0) + stops[begin:stop] - done).tolist()
                    held += some[begin:stop]
                    coded.append(ids[done : int(stops[stop - 1])])
                    begin = stop
                    if ends[-1] >= file_tokens:
                        yield close(fs, path, held, coded, ends)
                        held, coded, ends = [], [], []
        if held:
            yield close(fs, path, held, coded, ends)

    manifest = f"{folder}/files"
    ordered.mapInArrow(run, _FILES).write.parquet(manifest)
    return token_files(spark, folder)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The table of files that write_tokens() left in a folder: file, start, n_docs, n_tokens."""

    files = spark.read.schema(_FILES).parquet(f"{folder}/files")
    # one row per file: a few numbers for some millions of tokens
    before = Window.orderBy(F.asc_nulls_first("first_id"), "first_hash", "first_row").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_docs", "n_tokens")


def _scan(files: DataFrame, make: Callable[[int, list, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """Documents read from the files: make(place of the first id, doc_ids, ends among the ids, ids) -> columns."""

    def rows(batch: pa.RecordBatch) -> Iterator[dict]:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, path = store(name)
            with fs.open_input_file(path) as source:
                held = TokenFile(source)
                ends, first = held.ends(), 0
                while first < held.n_docs:
                    base = int(ends[first - 1]) if first else 0
                    stop = max(first + 1, int(np.searchsorted(ends, base + SCAN_TOKENS, side="right")))
                    yield make(start + base, held.doc_ids(first, stop), ends[first:stop] - base, held.tokens(base, int(ends[stop - 1])))
                    first = stop

    tasks = max(1, min(10_000, files.count()))
    return per_batch(files.select("file", "start").repartitionByRange(tasks, "start"), rows, schema)


def read_tokens(files: DataFrame) -> DataFrame:
    """The documents of a table of files: doc_id, start (ids of all documents before it), ids."""

    def make(start: int, doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> dict:
        offsets = np.r_[0, ends].astype(np.int32)
        return {"doc_id": doc_ids, "start": start + offsets[:-1].astype(np.int64), "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))}

    return _scan(files, make, "doc_id long, start long, ids array<long>")


def digest(files: DataFrame) -> DataFrame:
    """The documents of a table of files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""

    def make(start: int, doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> dict:
        raw, cuts = ids.astype("<u4", copy=False), np.r_[0, ends]
        marks = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"doc_id": doc_ids, "start": start + cuts[:-1], "n_tokens": np.diff(cuts), "ids_crc32": marks}

    return _scan(files, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(files: DataFrame, places: DataFrame, *, bin_tokens: int = FILE_TOKENS) -> DataFrame:
    """The ids at places of the whole run of ids: place (as in the column `place` of places), id.

    Each lookup reads a few bytes of one file. Places outside the run and null places give no row; repeated places are
    answered as often as they occur.
    """

    width = F.lit(bin_tokens)
    bins = F.explode(F.sequence(F.expr(f"start div {bin_tokens}"), F.expr(f"(start + n_tokens - 1) div {bin_tokens}"))).alias("bin")
    at = files.where("n_tokens > 0").select("file", F.col("start").alias("a"), (F.col("start") + F.col("n_tokens")).alias("b"), bins)
    wanted = places.select(F.col("place").cast("long").alias("place")).where("place >= 0").withColumn("bin", F.floor(F.col("place") / width))
    asked = wanted.join(at, "bin").where("place >= a and place < b").select("file", "a", "place")

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        found, name, source, held = [], None, None, None
        for file, start, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if file != name:
                if source is not None:
                    source.close()
                fs, path = store(file)
                name, source = file, fs.open_input_file(path)
                held = TokenFile(source)
            found.append(held.token(place - start))
        if source is not None:
            source.close()
        yield {"place": batch.column(2), "id": found}

    return per_batch(asked.sortWithinPartitions("file", "place"), make, "place long, id long")
