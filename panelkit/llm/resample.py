"""Importance resampling towards a target: array-scored weights, and ranks by a distributed LSD radix sort.

Features are hashed into buckets. Counts of the buckets over all documents and over the target give a gain per bucket, an
array that the tasks look features up in; a document's weight is the sum of its features' gains. Adding Gumbel noise that
the doc_id fixes and keeping the highest scores draws documents in proportion to their weights, without replacement.

Scores are ranked digit by digit, from the lowest digit of the last key to the highest of the first. A pass counts the
digits of each block of places, adds the counts up over digits and blocks to offsets, and puts every row at its block's
offset for the digit plus its own order among equals: a stable counting sort whose blocks have a fixed size whatever the
keys are, so that no key, however frequent, gathers in one task.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.text import NOT_ALNUM, chunks, document_columns, per_batch, shared_table, word_runs

BUCKETS = 10_000
#: Percent of the eligible documents that are drawn, and the words a document needs to be eligible.
SHARE, LEAST_WORDS = 10, 20
SEED = 2024
#: Gains, weights and scores are in thousandths.
UNIT = 1000

#: Bits of a digit at most, and places in a block.
DIGIT_BITS, BLOCK = 11, 1 << 16

_CRC = np.zeros(256, np.uint32)
for _k in range(256):
    _c = _k
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_k] = _c
#: Words over so many bytes are hashed one by one.
_LONG = 64


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers (before the last inversion) after the bytes of one word each."""

    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    falling, from_, out = -sizes[order], starts[order], state[order]
    long = int(np.searchsorted(falling, -_LONG, side="left"))
    for k in range(min(_LONG, int(-falling[0]) if len(falling) else 0)):
        n = int(np.searchsorted(falling, -k, side="left"))
        out[long:n] = _CRC[(out[long:n] ^ data[from_[long:n] + k]) & 0xFF] ^ (out[long:n] >> np.uint32(8))
    for j in range(long):
        out[j] = ~np.uint32(zlib.crc32(data[from_[j] : from_[j] - falling[j]], int(~out[j])))
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: list[bytes], max_words: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and (text, bucket) of all runs of n words, for each n up to max_words.

    Words are runs of letters a-z, digits and non-ASCII characters of the text with A-Z lower-cased; a run's bucket is
    the CRC-32 of its words, joined by one space, modulo the number of buckets.
    """

    raw = b"\n".join(texts).lower()
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_runs(data, NOT_ALNUM)
    sizes = np.array([len(t) + 1 for t in texts])
    doc = np.searchsorted(np.cumsum(sizes) - sizes, starts, side="right") - 1
    state, found = np.full(len(starts), 0xFFFFFFFF, np.uint32), []
    for n in range(1, max_words + 1):
        if n > 1:
            state = state[:-1]
            state = _CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
        state = _crc_on(state, data, starts[n - 1 :], ends[n - 1 :])
        whole = doc[: len(state)] == doc[n - 1 :]
        found.append((doc[: len(state)][whole], (~state[whole] % np.uint32(buckets)).astype(np.int64)))
        if len(starts) <= n:
            break
    return np.bincount(doc, minlength=len(texts)), found


def bucket_counts(texts: DataFrame, max_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of the column `text` in each bucket. Tasks send their own sums: at most one row a bucket and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in chunks(range(batch.num_rows), batch.column(0).to_pylist()):
                for _, bucket in features(some, max_words, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    sums = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Of each bucket, the log ratio of its smoothed shares in the target and in the source, in whole thousandths."""

    t, s, n = int(target.sum()), int(source.sum()), len(target)
    return np.array([math.floor(UNIT * math.log((a + 1) * (s + n) / ((b + 1) * (t + n)))) for a, b in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, in whole thousandths; a missing id counts as an empty one."""

    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-UNIT * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, *, seed: int = SEED, max_words: int = 1) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, found = features(texts, max_words, len(gain))
            count, weight = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for doc, bucket in found:
                sums, edges = np.r_[0, np.cumsum(gain[bucket])], np.searchsorted(doc, np.arange(len(ids) + 1))
                count += np.diff(edges)
                weight += np.diff(sums[edges])
            yield {"doc_id": ids, "n_words": words, "n_features": count, "weight": weight, "score": weight + np.array([noise(i, seed) for i in ids], np.int64)}

    return per_batch(document_columns(docs), make, "doc_id long, n_words long, n_features long, weight long, score long")


def _digits(rows: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    """The digits of a composite key, lowest first; parts that are alike in all rows have none. Nulls come last in a key."""

    ends = rows.agg(*(f(k).alias(f"{k}{i}") for k, _ in keys for i, f in enumerate((F.min, F.max))), *(F.max(F.col(k).isNull()).alias(f"{k}2") for k, _ in keys)).first()
    out: list[Column] = []
    for key, ascending in reversed(keys):
        low, high, nulls = ends[f"{key}0"], ends[f"{key}1"], ends[f"{key}2"]
        if low is not None and low < high:
            if high - low < 1 << 63:
                value, bits = (F.col(key) - low if ascending else high - F.col(key)), (high - low).bit_length()
            else:  # as unsigned numbers
                flipped = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))
                value, bits = (flipped if ascending else F.bitwise_not(flipped)), 64
            width = -(-bits // -(-bits // DIGIT_BITS))
            out += [F.coalesce(F.shiftrightunsigned(value, k).bitwiseAND(F.lit((1 << width) - 1)), F.lit(0)) for k in range(0, bits, width)]
        if nulls and low is not None:
            out.append(F.col(key).isNull().cast("long"))
    return out


def radix_places(rows: DataFrame, keys: list[tuple[str, bool]], name: str = "radix") -> DataFrame:
    """rows with their place (long, from 0) in the order of keys, (column of longs, ascending?) from first to last.

    rows is a written table with a column `place` that holds any different number in each row (blocks are runs of BLOCK of
    them); rows with equal keys keep its order. Each pass is written to the shared folder.
    """

    mine, before = Window.partitionBy("_digit", "_block").orderBy("place"), Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    columns = rows.columns
    for digit in _digits(rows, keys) or [F.lit(0)]:
        cut = rows.withColumns({"_digit": digit, "_block": F.expr(f"place div {BLOCK}")})
        counts = cut.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
        # at most one row a digit: bounded by the digit's bits
        starts = counts.groupBy("_digit").agg(F.sum("_n").alias("_all")).select("_digit", F.coalesce(F.sum("_all").over(lower), F.lit(0)).alias("_first"))
        offsets = counts.join(F.broadcast(starts), "_digit").select("_digit", "_block", (F.col("_first") + F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_offset"))
        placed = cut.join(offsets, ["_digit", "_block"]).withColumn("place", F.col("_offset") + F.row_number().over(mine) - 1)
        rows = shared_table(placed.select(*columns), name)
    return rows


def resample(
    docs: DataFrame, target: DataFrame, *, share: int = SHARE, seed: int = SEED, max_words: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if it isn't drawn).

    Features are all runs of 1 to max_words words, repeats counted, of docs.text and target.text. Of the N documents with
    at least least_words words, the floor(share x N / 100) highest scores are drawn; rank counts them from 1, equal scores
    by ascending doc_id. Null and empty texts have no features and weight 0. A null doc_id comes after all others; rows
    that repeat a doc_id draw the same noise, count one by one, and stand next to each other where their scores are equal,
    with those of fewer features first. Either table may be empty. Other columns are not read.
    """

    gain = gains(bucket_counts(target, max_words, buckets), bucket_counts(docs, max_words, buckets))
    scored = shared_table(score(docs, gain, seed=seed, max_words=max_words).withColumn("place", F.monotonically_increasing_id()), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * share // 100
    ranked = radix_places(able.drop("n_words"), [("score", False), ("doc_id", True), ("n_features", True)])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = scored.where(F.col("n_words") < least_words).withColumn("place", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionAll(rest.select(*columns, F.col("place").alias("rank")))
