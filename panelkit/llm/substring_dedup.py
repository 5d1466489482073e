"""Removal of word sequences that occur more than once, by suffix automata of reference shards.

A window is a run of `window` words of one document. Every window is known by an anchor: the smallest hash among its
eight-word runs. Equal windows have equal anchors, and neighbouring windows mostly share one, so a document is cut into
contexts: the words of all windows that belong to one anchor. Only contexts whose anchor occurs elsewhere go on.

The contexts of one anchor form a reference shard. Its suffix automaton counts how often each of its word sequences
occurs; the documents' contexts are streamed through it, and where the longest suffix that occurs twice reaches the
window's length, the window is a repeat. A shard goes to the task that needs it by a shuffle and not by a broadcast,
since all shards together grow with the corpus. Equal contexts are folded into one with a count before anything is
shipped, and shards beyond SHARD_CONTEXTS differing contexts are split by window instead, counted by partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import Words, chunks, mix, per_batch, shared_table, signed

WINDOW = 35
ANCHOR_WORDS = 8
#: Differing contexts that one automaton holds at most.
SHARD_CONTEXTS = 256

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


class SuffixAutomaton:
    """Suffix automaton of several sequences, each with a number of copies."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _part(self, state: int, symbol: int, target: int) -> int:
        """The state of the sequence (state's longest + symbol), split off from target where that holds longer ones."""

        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: list[int], copies: int = 1) -> None:
        last = 0
        for symbol in sequence:
            target = self.next[last].get(symbol)
            if target is not None:
                last = self._part(last, symbol, target)
            else:
                new = self._new(self.length[last] + 1, {}, 0)
                state = last
                while state >= 0 and symbol not in self.next[state]:
                    self.next[state][symbol] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._part(state, symbol, self.next[state][symbol])
                last = new
            self.count[last] += copies

    def settle(self) -> None:
        """Sum the counts of ends over all suffixes, and find for each state its longest suffix that occurs twice."""

        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in reversed(order):
            self.count[self.link[state]] += self.count[state]
        self.repeated = [0] * len(self.link)
        for state in order:
            self.repeated[state] = self.length[state] if self.count[state] > 1 else self.repeated[self.link[state]]

    def statistics(self, sequence: list[int]) -> list[int]:
        """At each place, the length of the longest suffix of the sequence so far that the automaton saw twice or more."""

        state, depth, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                depth = self.length[state]
            if symbol in self.next[state]:
                state, depth = self.next[state][symbol], depth + 1
            # of the state's sequences the one of length depth occurs as often as the longest
            out.append(depth if self.count[state] > 1 and state else self.repeated[state])
        return out


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the (leftmost) minimum of each run of width values."""

    size, at = 1, np.arange(len(values))
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


class Contexts:
    """Anchors and contexts of the documents in a chunk: arrays with one entry per context."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = words = Words(texts)
        k = min(ANCHOR_WORDS, window)
        n = len(words.hashes)
        self.at = np.zeros(0, np.int64)
        if n >= window:
            code = mix(words.hashes)
            grams = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                grams = mix(grams + code[i : i + len(grams)])
            anchor = _sliding_argmin(grams, window - k + 1)
            self.at = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
            anchor = anchor[self.at]
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (words.doc[self.at[1:]] != words.doc[self.at[:-1]])]) if len(anchor) else np.zeros(0, np.int64)
            self.windows = np.diff(np.r_[new, len(anchor)])
            self.at = self.at[new]
            anchor = anchor[new]
            self.anchor = grams[anchor]
            powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
            unpowers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _UNBASE, np.uint64)])
            self._sums, self._unpowers = np.r_[np.uint64(0), np.cumsum(code * powers[:n])], unpowers
            ends = self.at + self.windows + window - 1
            self.key = self.hash_of(self.at, ends) ^ mix((anchor - self.at).astype(np.uint64) + np.uint64(1) + (ends - self.at).astype(np.uint64) * np.uint64(64))

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._unpowers[start])


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of both that tells rows with equal doc_id apart."""

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_key"), text.alias("text"))


def _occurrences(rows: DataFrame, window: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for some, texts in chunks(keys, batch.column(2).to_pylist()):
            found = Contexts(texts, window)
            if len(found.at):
                doc = found.words.doc[found.at]
                ids = pa.array([k[0] for k in some], pa.int64()).take(pa.array(doc))
                row_keys = pa.array([k[1] for k in some], pa.int64()).take(pa.array(doc))
                yield {"anchor": signed(found.anchor), "context": signed(found.key), "doc_id": ids, "row_key": row_keys, "first": found.words.position[found.at].astype(np.int32), "windows": found.windows.astype(np.int32)}

    return per_batch(rows, make, "anchor long, context long, doc_id long, row_key long, first int, windows int")


def _pending(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows with the contexts that are wanted of them: doc_id, row_key, text, list of (first, windows, anchor, n)."""

    lists = wanted.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "windows", "anchor", "n")).alias("wanted"))
    a, b = rows.alias("a"), lists.alias("b")
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_key") == F.col("b.row_key"))).select("a.doc_id", "a.row_key", "a.text", "b.wanted").dropDuplicates(["doc_id", "row_key"])


def _ship(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words (as hashes) of the wanted contexts."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc_id, row_key, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            code = (Words([text.encode()]).hashes >> np.uint64(33)).astype(np.int32)
            yield {
                "anchor": [w["anchor"] for w in asked], "n": [w["n"] for w in asked], "doc_id": [doc_id] * len(asked), "row_key": [row_key] * len(asked), "first": [w["first"] for w in asked],
                "words": [code[w["first"] : w["first"] + w["windows"] + window - 1] for w in asked],
            }

    return per_batch(_pending(rows, wanted), make, "anchor long, n long, doc_id long, row_key long, first int, words array<int>")


def _shard(window: int):
    def matched(group: list[tuple]) -> Iterator[tuple]:
        """Rows of one anchor -> (doc_id, row_key, start, end) of the repeats in contexts that occur once."""

        automaton = SuffixAutomaton()
        for row in group:
            automaton.add(row[5], row[1])
        automaton.settle()
        for row in group:
            if row[1] == 1:
                start = None
                lengths = automaton.statistics(row[5])
                for end, length in enumerate([*lengths, 0]):
                    if length >= window and start is None:
                        start = end
                    elif length < window and start is not None:
                        yield row[2], row[3], row[4] + start - window + 1, row[4] + end
                        start = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    out += matched(group)
                    group = []
                group.append(row)
            yield _spans(out)
        yield _spans(matched(group) if group else [])

    return run


_SPANS = "doc_id long, row_key long, start int, end int"


def _spans(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row_key", "start", "end"])


def _by_window(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Repeats in the contexts of crowded anchors: windows are counted one by one, with partial sums before the shuffle."""

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc_id, row_key, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = Contexts([text.encode()], window)
            size = np.array([w["windows"] for w in asked])
            start = np.repeat([w["first"] for w in asked], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield {
                "anchor": np.repeat([w["anchor"] for w in asked], size), "hash": signed(found.hash_of(start, start + window)), "n": np.repeat([w["n"] for w in asked], size),
                "doc_id": pa.array([doc_id] * len(start), pa.int64()), "row_key": [row_key] * len(start), "start": start.astype(np.int32),
            }

    seen = shared_table(per_batch(_pending(rows, wanted), make, "anchor long, hash long, n long, doc_id long, row_key long, start int"), "windows")
    often = shared_table(seen.groupBy("anchor", "hash").agg(F.sum("n").alias("total")).where("total > 1").drop("total"), "often")
    return seen.where("n = 1").join(often, ["anchor", "hash"]).select("doc_id", "row_key", "start", (F.col("start") + window).alias("end"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Word ranges that are covered by repeated windows: doc_id, row_key, start, end (words; ranges may overlap)."""

    rows = _rows(docs)
    every = _occurrences(rows, window)
    shared = shared_table(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    occurrences = shared_table(every.join(shared, "anchor"), "occurrences")
    folded = occurrences.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "first", "windows")).alias("one"))
    contexts = shared_table(folded.select("anchor", "context", "n", "one.*"), "contexts")
    mixed = contexts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds")
    mixed = contexts.join(shared_table(mixed, "mixed"), "anchor")
    shipped = _ship(rows, mixed.where(F.col("kinds") <= shard_contexts), window)
    matched = shipped.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shard(window), _SPANS)
    crowded = _by_window(rows, mixed.where(F.col("kinds") > shard_contexts), window)
    whole = occurrences.join(contexts.where("n > 1").select("anchor", "context"), ["anchor", "context"])
    whole = whole.select("doc_id", "row_key", F.col("first").alias("start"), (F.col("first") + F.col("windows") + (window - 1)).alias("end"))
    return whole.unionAll(matched).unionAll(crowded)


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are runs of characters other than space and U+0009 to U+000D. A word goes when it is covered by a window that
    also starts anywhere else, in the same document or another; all of its occurrences go, the first one too. Windows are
    judged on the input. Null texts have no words, like empty ones; documents shorter than the window lose nothing. A row
    that is repeated is another occurrence, so all its windows go in either copy. Rows with equal doc_id and different
    texts, and rows without doc_id, are told apart. An empty table gives no rows. Other columns aren't read.
    """

    rows = _rows(docs)
    lists = repeated_spans(docs, window, shard_contexts).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    a, b = rows.alias("a"), lists.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_key") == F.col("b.row_key")), "left").select("a.doc_id", "a.text", "b.spans")

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if spans:
                np.add.at(gone, [s["start"] for s in spans], 1)
                np.add.at(gone, [s["end"] for s in spans], -1)
            stays = (np.cumsum(gone)[:-1] == 0).tolist()
            kept = [w for w, s in zip(words, stays, strict=True) if s] if spans else words
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept).decode())
        yield {"doc_id": batch.column(0)} | out

    return per_batch(joined, make, "doc_id long, n_words long, n_removed long, kept string")
