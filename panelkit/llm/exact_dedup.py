"""Exact deduplication on a cuckoo-filter index of live digests.

An index holds short fingerprints in two candidate buckets per digest, and beside each fingerprint the stored digest it
stands for. A fingerprint hit is only a candidate: it counts once the stored digest in that bucket is equal. Entries can
be deleted, and a filter that overflows is rebuilt at twice the size from its stored keys.

In Spark, every map task keeps one index over the digests that it reads, so a text copied a million times leaves one row
per task. The surviving rows are shuffled by digest, sorted, and merged by a second index per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import keep_ids

SLOTS = 4
#: Displacements tried before a filter counts as full.
MAX_KICKS = 200
#: Keys after which an index is emptied at the next safe place; bounds a task's memory.
INDEX_KEYS = 100_000

_GROUPS = "text_sha256 string, keep_id long, group_size long"


class CuckooIndex:
    """Cuckoo filter over 32-byte digests, each with its stored key and a value."""

    def __init__(self, buckets: int = 1024):
        self._allot(1 << max(1, (buckets - 1).bit_length()))

    def _allot(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list = [None] * (buckets * SLOTS)

    def __len__(self) -> int:
        return self.size

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = self._print(key)
        first = int.from_bytes(key[:8], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _find(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[slot] == key:  # a hit, then its check against the stored content
                    return slot
        return -1

    def get(self, key: bytes, default=None):
        slot = self._find(key)
        return default if slot < 0 else self.values[slot]

    def put(self, key: bytes, value) -> None:
        """Insert a key, or replace the value of a live one."""

        slot = self._find(key)
        if slot >= 0:
            self.values[slot] = value
            return
        entry = (key, value)
        while entry := self._place(*entry):
            self._grow()
        self.size += 1

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)

    def _place(self, key: bytes, value) -> tuple[bytes, object] | None:
        """Store an entry; returns the entry left without a place when displacements run out."""

        mark, bucket, second = self._places(key)
        for kick in range(MAX_KICKS):
            for place in (bucket, second) if kick == 0 else (bucket,):
                for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                        return None
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            key, self.keys[slot] = self.keys[slot], key
            value, self.values[slot] = self.values[slot], value
            bucket = second = self._other(bucket, mark)
        return key, value

    def _grow(self) -> None:
        held, size = list(self.items()), self.size
        buckets = self.buckets
        while True:
            buckets *= 2
            self._allot(buckets)
            if all(self._place(*entry) is None for entry in held):
                self.size = size
                return


def normal_digest(raw: bytes | None) -> bytes:
    """SHA-256 of the text with A-Z lower-cased (bytes.lower() touches ASCII letters alone); null is empty."""

    return hashlib.sha256((raw or b"").lower()).digest()


def _largest(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def _merge(index: CuckooIndex, key: bytes, doc_id: int | None, count: int) -> None:
    """Add copies of a text: a newer copy takes the place of the one that stays so far."""

    held = index.get(key)
    if held is not None:
        index.delete(key)
        doc_id, count = _largest(held[0], doc_id), held[1] + count
    index.put(key, (doc_id, count))


def _rows(index: CuckooIndex) -> pa.RecordBatch:
    found = list(index.items())
    return pa.RecordBatch.from_arrays(
        [pa.array([k.hex() for k, _ in found], pa.string()), pa.array([v[0] for _, v in found], pa.int64()), pa.array([v[1] for _, v in found], pa.int64())],
        names=["text_sha256", "keep_id", "group_size"],
    )


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _merge(index, normal_digest(raw.as_py()), doc_id, 1)
        if len(index) >= INDEX_KEYS:
            yield _rows(index)
            index = CuckooIndex()
    yield _rows(index)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by digest: once the digest changes, no row of an earlier one can follow."""

    index, last = CuckooIndex(), None
    for batch in batches:
        for key, doc_id, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(index) >= INDEX_KEYS and key != last:
                yield _rows(index)
                index = CuckooIndex()
            _merge(index, bytes.fromhex(key), doc_id, count)
            last = key
    yield _rows(index)


def groups(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id (largest doc_id), group_size."""

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    partial = raw.mapInArrow(_combine, _GROUPS)
    return partial.repartition("text_sha256").sortWithinPartitions("text_sha256").mapInArrow(_settle, _GROUPS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal_digest(x.as_py()).hex() for x in batch.column(1)], pa.string())], names=["doc_id", "text_sha256"])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty, so null and empty texts
    form one group. Of equal texts the largest doc_id stays; a null doc_id is smaller than any other, and stays only
    where all are null. Rows that repeat both doc_id and text count one by one in group_size and share their decision.
    An empty table gives no rows. Other columns of docs are not read.
    """

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    rows = raw.mapInArrow(_digests, "doc_id long, text_sha256 string")
    return rows.join(groups(docs), "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates() doesn't keep; columns and texts as they are.

    Decisions go by doc_id. Rows without one can't be told apart: they all stay where one of them does.
    """

    return keep_ids(docs, groups(docs).select(F.col("keep_id").alias("doc_id")))
