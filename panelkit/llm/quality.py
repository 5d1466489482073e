"""Quality classifier: a generalised additive model with pairwise interactions.

Training cycles over the features; each step fits a shallow tree to one feature's gradient histogram and adds it to
that feature's lookup table. The strongest pairs on what is left then get two-dimensional tables in the same way. A score
is the sum of one table entry per feature and pair, taken for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.text import Words, chunks, document_columns, per_batch

#: At most so many labelled documents are learned from, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: A document is predicted good from this score on.
THRESHOLD = 0.3
HELD_OUT_PARTS = 5

_CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": [0x20, 0x09], "stop": b".,;:", "mark": b"!?", "quote": b"'\"-()",
    "symbol": b"#$%&*@^~", "pipe": b"|", "code": b"<>=_/\\{}[]`+", "high": range(0x80, 0x100), "newline": b"\n", "control": [*range(9), *range(11, 32), 127],
}
_CLASS_OF = np.stack([np.isin(np.arange(256), list(v)) for v in _CLASSES.values()], axis=1).astype(float)

FEATURES = (
    *(f"share_{k}" for k in _CLASSES), "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "repeated_neighbours", "distinct_pairs",
    "lines", "distinct_lines", "mean_line", "byte_entropy", "upper_of_letters",
)


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros."""

    n = len(texts)
    counts = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]) if n else np.zeros((0, 256))
    size = counts.sum(1)
    share = (counts @ _CLASS_OF) / np.maximum(size, 1)[:, None]
    p = counts / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    words = Words(texts)
    total = np.bincount(words.doc, minlength=n).astype(float)
    some = np.maximum(total, 1)
    width = (words.ends - words.starts).astype(float)
    longest, top, distinct = np.zeros(n), np.zeros(n), np.zeros(n)
    np.maximum.at(longest, words.doc, width)

    def runs(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, copies) of each distinct value of a document."""
        order = np.lexsort((values, doc))
        d, v = doc[order], values[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])]) if len(d) else np.zeros(0, int)
        return d[first], np.diff(np.r_[first, len(d)])

    kinds, copies = runs(words.doc, words.hashes)
    distinct += np.bincount(kinds, minlength=n)
    np.maximum.at(top, kinds, copies.astype(float))
    at, grams = words.ngrams(2)
    pairs = np.bincount(words.doc[at], minlength=n)
    distinct_pairs = np.bincount(runs(words.doc[at], grams)[0], minlength=n)
    same = np.bincount(words.doc[at], weights=words.hashes[at] == words.hashes[at + 1], minlength=n) if len(at) else np.zeros(n)
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines], float)
    kept_lines = np.array([len(set(x)) for x in lines], float)
    letters = counts @ (_CLASS_OF[:, 0] + _CLASS_OF[:, 1])
    rest = [
        np.log1p(size), np.log1p(total), np.bincount(words.doc, weights=width, minlength=n) / some, longest, distinct / some, top / some, same / some, distinct_pairs / np.maximum(pairs, 1),
        np.log1p(n_lines), kept_lines / np.maximum(n_lines, 1), np.log1p(size / np.maximum(n_lines, 1)), entropy, (counts @ _CLASS_OF[:, 0]) / np.maximum(letters, 1),
    ]
    return np.column_stack([share, *rest]) * (size > 0)[:, None]


def _best_cut(g: np.ndarray, h: np.ndarray, weight: float) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of a histogram."""

    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + weight) + (all_g - left_g) ** 2 / (all_h - left_h + weight) - all_g**2 / (all_h + weight)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, weight: float) -> np.ndarray:
    """Step for each bin: a tree that splits its best leaf until it has so many."""

    parts = [(0, len(g))]
    cuts = {(0, len(g)): _best_cut(g, h, weight)}
    while len(parts) < leaves:
        part = max(parts, key=lambda p: cuts[p][0])
        gain, at = cuts[part]
        if gain <= 1e-9:
            break
        parts.remove(part)
        for new in ((part[0], part[0] + at), (part[0] + at, part[1])):
            parts.append(new)
            cuts[new] = _best_cut(g[new[0] : new[1]], h[new[0] : new[1]], weight)
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + weight)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """(gain, step for each cell) of the best cross cut of a two-dimensional histogram."""

    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def parts(c):
        a = c[:-1, :-1]
        top, left = c[:-1, -1:], c[-1:, :-1]
        return a, top - a, left - a, c[-1, -1] - top - left + a

    gain = sum(pg**2 / (ph + weight) for pg, ph in zip(parts(cg), parts(ch), strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + weight)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + weight)), out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AdditiveModel:
    """base + one table per feature + one table per pair; score() is the logistic of that sum."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, rounds: int = 150, rate: float = 0.15, leaves: int = 4, bins: int = 64, n_pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 40, weight: float = 1.0) -> AdditiveModel:
        """Cyclic boosting on the log loss. With no rows every score is 0.5; with one class it is near that class."""

        rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(float(np.log(rate_of_ones / (1 - rate_of_ones))), [cls._cuts(c, bins) for c in x.T], [], [], [cls._cuts(c, pair_bins) for c in x.T])
        binned = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        if not len(y) or y.min() == y.max():
            return model
        total = np.full(len(y), model.base)
        for _ in range(rounds):
            for b, t in zip(binned, model.tables, strict=True):
                p = _sigmoid(total)
                step = rate * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), leaves, weight)
                t += step
                total += step[b]
        coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
        size = [len(e) + 1 for e in model.pair_edges]

        def histograms(i, j, p):
            cell = coarse[i] * size[j] + coarse[j]
            return cell, *(np.bincount(cell, v, size[i] * size[j]).reshape(size[i], size[j]) for v in (y - p, p * (1 - p)))

        p = _sigmoid(total)
        gains = sorted(((-_quadrants(*histograms(i, j, p)[1:], weight)[0], i, j) for i in range(x.shape[1]) for j in range(i) if size[i] > 1 and size[j] > 1))
        model.pairs = [(i, j) for _, i, j in gains[:n_pairs]]
        model.pair_tables = [np.zeros((size[i], size[j])) for i, j in model.pairs]
        for _ in range(pair_rounds):
            for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
                cell, g, h = histograms(i, j, _sigmoid(total))
                step = rate * _quadrants(g, h, weight)[1]
                t += step
                total += step.ravel()[cell]
        return model

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            total += t[np.searchsorted(e, c, side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return _sigmoid(total)


def held_out(doc_id: Column) -> Column:
    """Is the document in the held-out part? Documents without doc_id are not."""

    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_PARTS == 0, F.lit(False))


def _features(batch: pa.RecordBatch) -> Iterator[dict]:
    for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield {"doc_id": ids, "features": list(text_features(texts))}


def train(docs: DataFrame, labels: DataFrame, *, target: str = "quality", max_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fit on at most max_rows labelled documents outside the held-out part, the same ones on every run.

    Labels without doc_id or target are not used; a doc_id that is labelled more than once counts once, with its largest
    label, and one with several texts with the text of the smallest features. Only doc_id, target and text are read.
    """

    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).dropna()
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = document_columns(docs).join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi")  # max_rows ids
    seen = per_batch(texts, _features, "doc_id long, features array<double>").groupBy("doc_id").agg(F.min("features").alias("features"))
    got = seen.join(F.broadcast(rows), "doc_id").toPandas().sort_values("doc_id")
    x = np.array(got.features.tolist()).reshape(-1, len(FEATURES))
    return AdditiveModel.fit(x, (got.label > 0).to_numpy(float))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts are scored like empty ones, by the model's tables for zero features. Texts are read whole. Rows are
    independent: repeated rows get the same score. An empty table gives no rows. Other columns are never inputs.
    """

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield {"doc_id": ids, "score": model.score(text_features(texts))}

    scored = per_batch(document_columns(docs), make, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores threshold or more, with all columns as they are and no shuffle.

    Null texts are scored like empty ones. Rows are independent, so repeated rows stay or go together; a score equal to the
    threshold stays. An empty table stays empty.
    """

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(place), pa.string()).to_pylist()
            scores = [model.score(text_features(some)) for _, some in chunks(texts, texts)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
