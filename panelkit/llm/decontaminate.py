"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Edit distance is counted in words. A random walk copies a word sequence into one three times as long: at each step the
current word is written, and a random bit of (step, word) says whether to move on. Sequences at a small edit distance then
agree in most places, so sampling a few places, many times over, finds them as in Hamming space.

Windows as long as an item are embedded where one of the item's blocks occurs unchanged: an item cut into one block more
than it may have edits keeps at least one block intact, so no window within the allowed distance is passed over. Windows
that meet an item in a sample are verified by the exact edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import NOT_WORD, Words, chunks, document_columns, hash_ngrams, lowered, mix, per_batch

#: Edits allowed, as a share of the item's words (similarity 0.8 or more).
EDIT_SHARE = 0.2
#: Places that one sample reads, and the share of allowed windows that at least one sample should find.
SAMPLED, RECALL = 2, 0.999
#: Items with fewer words are too common to be told from chance and are matched without edits.
EXACT_BELOW = 8
#: Items that are sent to the tasks at once; larger benchmarks take several passes over the documents.
ITEMS_AT_ONCE = 20_000


def words_of(texts: list[bytes]) -> Words:
    return Words(lowered(texts), NOT_WORD)


def embed(sequences: np.ndarray, lengths: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """CGK embedding of each row (its first `lengths` hashes): steps values, 0 once the sequence is used up."""

    n, width = sequences.shape
    padded = np.concatenate([sequences, np.zeros((n, 1), np.uint64)], axis=1)
    place, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.zeros((n, steps), np.uint64)
    for step in range(steps):
        over = place >= lengths
        value = np.where(over, np.uint64(0), padded[rows, np.minimum(place, width)])
        out[:, step] = value
        place += ((mix(value ^ np.uint64((seed * 1_000_003 + step) * 2 + 1)) >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return out


def edit_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of words that is closest to item; of equal ones the first, then the shortest."""

    n, m = len(item), len(words)
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for k in range(n):
        change = np.where(words == item[k], 0, 1)
        best = np.empty(m + 1, np.int64)
        best[0], source = cost[0] + 1, np.empty(m + 1, np.int64)
        source[0] = origin[0]
        across, down = cost[:-1] + change, cost[1:] + 1
        best[1:] = np.minimum(across, down)
        source[1:] = np.where(across <= down, origin[:-1], origin[1:])
        # words of the text that the item lacks: running minimum of cost minus place
        lead = best - np.arange(m + 1)
        at = np.maximum.accumulate(np.where(lead == np.minimum.accumulate(lead), np.arange(m + 1), 0))
        at = np.where(lead[at] == np.minimum.accumulate(lead), at, np.arange(m + 1))
        origin, cost = source[at], np.minimum.accumulate(lead) + np.arange(m + 1)
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


@dataclass
class Items:
    """Benchmark items prepared for matching: word hashes, block seeds, and sampled embeddings."""

    ids: list[int]
    words: list[np.ndarray]
    edits: list[int]
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)
    samples: list[tuple[int, np.ndarray]] = field(default_factory=list)
    signatures: list[np.ndarray] = field(default_factory=list)
    #: The samples stay under the wanted recall: every seeded window is verified.
    verify_all: bool = False

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], share: float = EDIT_SHARE, recall: float = RECALL) -> Items:
        """Items without words are left out."""

        found = words_of([(t or "").encode() for _, t in rows])
        words = [found.hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        held = [(i, w) for (i, _), w in zip(rows, words, strict=True) if len(w)]
        self = cls([i for i, _ in held], [w for _, w in held], [int(share * len(w)) if len(w) >= EXACT_BELOW else 0 for _, w in held])
        for k, (w, edits) in enumerate(zip(self.words, self.edits, strict=True)):
            size = len(w) // (edits + 1)
            block = self.seeds.setdefault(size, defaultdict(list))
            for at in range(0, size * (edits + 1), size):
                block[int(hash_ngrams(w[at : at + size], size)[0])].append((k, at))
        self.keys = {size: np.array(sorted(block), np.uint64) for size, block in self.seeds.items()}
        self._sample(recall)
        return self

    @property
    def width(self) -> int:
        return max((len(w) for w in self.words), default=0)

    def _table(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(s) for s in sequences], np.int64)
        out = np.zeros((len(sequences), max(1, int(lengths.max(initial=0)))), np.uint64)
        for row, s in zip(out, sequences, strict=True):
            row[: len(s)] = s
        return out, lengths

    def _sample(self, recall: float) -> None:
        """Draw samples until copies of the items with as many random edits as allowed are found at the wanted recall."""

        if not self.words:
            return
        rng = np.random.default_rng(1)
        tried = [k for k in rng.permutation(len(self.words))[:300] for _ in range(4)]
        copies = [edited(self.words[k], self.edits[k], rng) for k in tried]
        table, lengths = self._table(self.words)
        copy_table, copy_lengths = self._table(copies)
        missed = np.ones(len(tried), bool)
        while missed.mean() > 1 - recall and len(self.samples) < 200:
            walk, per_walk = len(self.samples), 4
            steps = 3 * self.width
            own, other = embed(table, lengths, walk, steps), embed(copy_table, copy_lengths, walk, steps)
            for _ in range(per_walk):
                share = np.sort(rng.random(SAMPLED))
                self.samples.append((walk, share))
                keys = self._read(own, lengths, share)
                self.signatures.append(keys)
                # windows have the item's length: places are chosen by it
                missed &= self._read(other, lengths[tried], share) != keys[tried]
        self.verify_all = bool(missed.mean() > 1 - recall)

    @staticmethod
    def _read(embedded: np.ndarray, lengths: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Hash of the sampled places; they are a share of twice the item's length, which the walk takes on average."""

        rows, out = np.arange(len(embedded)), np.zeros(len(embedded), np.uint64)
        for part in share:
            place = (part * 2 * lengths).astype(np.int64)
            out = mix(out * np.uint64(3) + embedded[rows, np.minimum(place, embedded.shape[1] - 1)])
        return out

    def meet(self, windows: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Does each window fall into one bucket with its item, in some sample? Yes if samples don't reach the recall."""

        if self.verify_all:
            return np.ones(len(items), bool)
        lengths = np.array([len(w) for w in self.words], np.int64)[items]
        hit, walked, embedded = np.zeros(len(items), bool), -1, None
        for (walk, share), keys in zip(self.samples, self.signatures, strict=True):
            if walk != walked:
                embedded, walked = embed(windows, lengths, walk, 3 * self.width), walk
            hit |= self._read(embedded, lengths, share) == keys[items]
            if hit.all():
                break
        return hit

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start word, end word): the closest place of each item within its allowed distance."""

        found = words_of(texts)
        spots: set[tuple[int, int, int]] = set()
        for size, block in self.seeds.items():
            at, grams = found.ngrams(size)
            keys = self.keys[size]
            near = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            for place, gram in zip(at[keys[near] == grams].tolist(), grams[keys[near] == grams].tolist(), strict=True):
                text = int(found.doc[place])
                spots |= {(text, item, place - offset) for item, offset in block[gram]}
        if not spots:
            return
        ordered = sorted(spots)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for begin in range(0, len(ordered), 4096):
            part = ordered[begin : begin + 4096]
            windows = np.zeros((len(part), self.width), np.uint64)
            for row, (text, item, start) in zip(windows, part, strict=True):
                a, b = max(start, int(found.first[text])), min(start + len(self.words[item]), int(found.first[text + 1]))
                row[: b - a] = found.hashes[a:b]
            for (text, item, start), ok in zip(part, self.meet(windows, np.array([p[1] for p in part])), strict=True):
                if not ok or best.get((text, item), (1,))[0] == 0:
                    continue
                edits, length, first = self.edits[item], len(self.words[item]), int(found.first[text])
                a, b = max(start - edits, first), min(start + length + edits, int(found.first[text + 1]))
                if start >= first and np.array_equal(found.hashes[start : start + length], self.words[item]) and start + length <= found.first[text + 1]:
                    got = (0, start - first, start + length - first)
                else:
                    distance, s, e = edit_distance(self.words[item], found.hashes[a:b])
                    got = (distance, a + s - first, a + e - first)
                if got[0] <= edits:
                    best[text, item] = min(best.get((text, item), got), got)
        for (text, item), (distance, start, end) in sorted(best.items()):
            yield text, item, distance, start, end


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many random replacements, insertions and removals, and the original length of window."""

    out = list(words)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        new = rng.integers(1, 2**62, dtype=np.uint64)
        if kind == 0:
            out[at : at + 1] = [new]
        elif kind == 1:
            out.insert(at, new)
        else:
            del out[at : at + 1]
    return np.array(out[: len(words)], np.uint64)


def leaks(docs: DataFrame, benchmark: DataFrame, *, share: float = EDIT_SHARE, recall: float = RECALL, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, distance, item_words, start, end.

    A document holds an item when some run of its words is within share x (words of the item) edits of it; start and end
    count words of the closest such place. Words are runs of letters, digits, underscores and non-ASCII characters,
    lower-cased. Items under 8 words must occur unchanged; items without words, and null items, match nothing. Null and
    empty texts hold nothing. Repeated documents give repeated rows; of items with equal item_id each row is an item.
    Tables may be empty. Only doc_id, text and item_id, text are read.
    """

    out = None
    for ready in item_blocks(benchmark, share, recall, items_at_once):

        def make(batch: pa.RecordBatch, ready: Items = ready) -> Iterator[dict]:
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = list(ready.matches(texts)) if ready.words else []
                yield {
                    "doc_id": [ids[g[0]] for g in got], "item_id": [ready.ids[g[1]] for g in got], "distance": [g[2] for g in got],
                    "item_words": [len(ready.words[g[1]]) for g in got], "start": [g[3] for g in got], "end": [g[4] for g in got],
                }

        found = per_batch(document_columns(docs), make, "doc_id long, item_id long, distance int, item_words int, start int, end int")
        out = found if out is None else out.unionAll(found)
    return out


def item_blocks(benchmark: DataFrame, share: float, recall: float, items_at_once: int) -> Iterator[Items]:
    """The benchmark in prepared blocks of about items_at_once items: what one pass over the documents sends to its tasks."""

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // items_at_once))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield Items.of([(r["item_id"], r["text"]) for r in rows], share, recall)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, share: float = EDIT_SHARE, recall: float = RECALL, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """docs without the rows that hold a benchmark item, as leaks() finds them; no shuffle, columns as they are.

    Null and empty texts hold nothing and stay. Repeated rows stay or go together; rows without doc_id are judged like
    others. An empty table stays empty, and an empty benchmark drops nothing.
    """

    place = docs.columns.index("text")
    for ready in item_blocks(benchmark, share, recall, items_at_once):

        def run(batches: Iterator[pa.RecordBatch], ready: Items = ready) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, clean = pc.cast(batch.column(place), pa.string()).to_pylist(), np.ones(batch.num_rows, bool)
                for rows, some in chunks(range(batch.num_rows), texts):
                    clean[[rows[g[0]] for g in ready.matches(some)] if ready.words else []] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
