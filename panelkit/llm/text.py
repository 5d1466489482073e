"""Word hashing over UTF-8 bytes, and plumbing shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import new_folder

#: Bytes of text that one vectorised step takes at most (more only if a single document is longer).
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of plain words: ASCII other than letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Separators of normalised words: ASCII other than letters, digits and underscore.
NOT_WORD = np.array([b < 128 and not (chr(b).isalnum() or b == 0x5F) for b in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_runs(data: np.ndarray, separators: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (bytes) of each maximal run of bytes that are not separators."""

    edge = np.diff((~separators[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_runs(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the runs of bytes that follow one another in data."""

    if not len(sizes):
        return np.zeros(0, np.uint64)
    first = np.cumsum(sizes) - sizes
    position = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = _BYTE_CODES[data] * _powers(int(sizes.max()))[position]
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def hash_words(data: np.ndarray, separators: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and 64-bit hash of each maximal run of bytes that are not separators."""

    starts, ends = word_runs(data, separators)
    return starts, ends, hash_runs(data[~separators[data]], ends - starts)


def hash_ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len(words) - n + 1 of them)."""

    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k, weight in enumerate(_powers(n)):
        total += words[k : k + len(total)] * weight
    return mix(total)


def chunks(ids: list, texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Groups of (ids, UTF-8 texts) of about `limit` bytes; null texts are empty."""

    some, got, size = [], [], 0
    for key, text in zip(ids, texts, strict=True):
        raw = (text or "").encode()
        if got and size + len(raw) > limit:
            yield some, got
            some, got, size = [], [], 0
        some.append(key)
        got.append(raw)
        size += len(raw)
    if got:
        yield some, got


class Words:
    """The words of several documents: hashes, the document of each, byte ranges inside the joined text."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = WHITESPACE):
        self.raw = b"\n".join(texts)
        self.starts, self.ends, self.hashes = hash_words(np.frombuffer(self.raw, np.uint8), separators)
        sizes = np.array([len(t) + 1 for t in texts])
        self.base = np.cumsum(sizes) - sizes
        self.doc = np.searchsorted(self.base, self.starts, side="right") - 1
        #: Of each document, its first word and (at the end) the number of words.
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.position = np.arange(len(self.doc)) - self.first[self.doc]

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words inside one document."""

        grams = hash_ngrams(self.hashes, n)
        at = np.flatnonzero(self.doc[: len(grams)] == self.doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
        return at, grams[at]


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.lower() if t.isascii() else t.decode().lower().encode() for t in texts]


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over a function from a batch to dicts of column -> values (lists, numpy or Arrow arrays)."""

    target = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in df.sparkSession.createDataFrame([], schema).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in make(batch):
                arrays = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def document_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of the input can't clash with derived ones."""

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (null matches null), with all columns of docs as they are."""

    wanted = ids.select(F.col("doc_id").alias("_wanted_id"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_wanted_id"]), "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in ids (null matches null)."""

    dropped = ids.select(F.col("doc_id").alias("_dropped_id"))
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_dropped_id"]), "left_anti")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet under the folder that spark.checkpoint.dir names, and read it back.

    The files survive the loss of executors and keep column pruning; they go when that folder is cleared.
    """

    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
