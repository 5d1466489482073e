"""Linear-chain conditional random field over named features, trained by gradient ascent and decoded in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOW = -1e30


def _padded(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, mask), sequences x longest: index of each item, and whether there is one."""

    steps = np.arange(int(lengths.max(initial=0)))
    mask = steps < lengths[:, None]
    return np.where(mask, starts[:, None] + steps, 0), mask


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Items:
    """Features of the items of several sequences: ids of item k are ids[at[k]:at[k + 1]] (at least one each)."""

    ids: np.ndarray
    at: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, sequences: list[list[list[str]]], names: dict[str, int]) -> Items:
        """Features that have no name are left out; the name "" is on every item."""

        ids: list[int] = []
        at = [0]
        for sequence in sequences:
            for features in sequence:
                ids.append(0)
                ids += [names[f] for f in features if f in names]
                at.append(len(ids))
        return cls(np.array(ids, np.int64), np.array(at, np.int64), np.array([len(s) for s in sequences], np.int64))


class LinearChainCrf:
    """Labels 0..n-1. Scores: sum of feature weights by label, of steps between labels, and of the first and last label."""

    def __init__(self, names: dict[str, int], n_labels: int):
        self.names = names
        self.weights = np.zeros((len(names), n_labels))
        self.steps = np.zeros((n_labels, n_labels))
        self.first = np.zeros(n_labels)
        self.last = np.zeros(n_labels)

    @classmethod
    def fit(cls, sequences: list[list[list[str]]], labels: list[list[int]], n_labels: int, *, rounds: int = 200, rate: float = 0.1, penalty: float = 1e-3, forbidden: tuple[tuple[int, int], ...] = ()) -> LinearChainCrf:
        """Maximum penalised likelihood by Adam on all sequences at once. forbidden: steps (from, to) that can't occur."""

        names = {"": 0}
        for sequence in sequences:
            for features in sequence:
                for f in features:
                    names.setdefault(f, len(names))
        model = cls(names, n_labels)
        kept = [(s, y) for s, y in zip(sequences, labels, strict=True) if s]
        if not kept:
            return model
        items = Items.of([s for s, _ in kept], names)
        gold = np.concatenate([np.array(y, np.int64) for _, y in kept])
        starts = np.cumsum(items.lengths) - items.lengths
        rows, mask = _padded(starts, items.lengths)
        ends = starts + items.lengths - 1
        inner = np.ones(len(gold), bool)
        inner[ends] = False
        before = np.flatnonzero(inner)
        of_item = np.repeat(np.arange(len(gold)), np.diff(items.at))
        parts = [model.weights, model.steps, model.first, model.last]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
        bar = np.zeros((n_labels, n_labels))
        for a, b in forbidden:
            bar[a, b] = _LOW
        scale = 1 / len(kept)
        for step in range(1, rounds + 1):
            single, pair = model._expected(items, rows, mask, bar)
            gap = -single
            gap[np.arange(len(gold)), gold] += 1
            grads = [np.zeros_like(p) for p in parts]
            np.add.at(grads[0], items.ids, gap[of_item])
            np.add.at(grads[1], (gold[before], gold[before + 1]), 1)
            grads[1] -= pair
            grads[2] += gap[starts].sum(0)
            grads[3] += gap[ends].sum(0)
            for part, grad, (m, v) in zip(parts, grads, moments, strict=True):
                g = grad * scale - penalty * part
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                part += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.steps = model.steps + bar
        return model

    def _emissions(self, items: Items) -> np.ndarray:
        if len(items.at) == 1:
            return np.zeros((0, self.weights.shape[1]))
        return np.add.reduceat(self.weights[items.ids], items.at[:-1], axis=0)

    def _expected(self, items: Items, rows: np.ndarray, mask: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each item and expected counts of steps, by forward and backward sums."""

        emit = self._emissions(items)[rows]
        n, width, k = emit.shape
        steps = self.steps + bar
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = self.first + emit[:, 0]
        for t in range(1, width):
            new = _logsumexp(forward[:, t - 1, :, None] + steps, 1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        backward[:, -1] = self.last
        for t in range(width - 2, -1, -1):
            new = _logsumexp(steps + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, self.last)
        total = _logsumexp(forward[:, -1] + self.last, 1)
        single = np.exp(forward + backward - total[:, None, None])
        pair = np.zeros((k, k))
        for t in range(1, width):
            joint = forward[:, t - 1, :, None] + steps + (emit[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            pair += (np.exp(joint) * mask[:, t, None, None]).sum(0)
        return single[mask], pair

    def decode(self, sequences: list[list[list[str]]], cells: int = 1 << 20) -> list[np.ndarray]:
        """Best labels of each sequence by Viterbi. Sequences of like length are decoded together, in bounded batches."""

        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((k for k, s in enumerate(sequences) if s), key=lambda k: len(sequences[k]))
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end - begin + 1) * len(sequences[order[end]]) * self.steps.shape[0] <= cells:
                end += 1
            some = order[begin:end]
            for k, path in zip(some, self._viterbi(Items.of([sequences[k] for k in some], self.names)), strict=True):
                out[k] = path
            begin = end
        return out

    def _viterbi(self, items: Items) -> list[np.ndarray]:
        rows, mask = _padded(np.cumsum(items.lengths) - items.lengths, items.lengths)
        emit = self._emissions(items)[rows]
        n, width, k = emit.shape
        score = self.first + emit[:, 0]
        came = np.zeros((n, width, k), np.int8)
        came[:] = np.arange(k)
        for t in range(1, width):
            ways = score[:, :, None] + self.steps
            best = ways.argmax(1)
            live = mask[:, t, None]
            came[:, t] = np.where(live, best, came[:, t])
            score = np.where(live, np.take_along_axis(ways, best[:, None], 1)[:, 0] + emit[:, t], score)
        label = (score + self.last).argmax(1)
        path = np.zeros((n, width), np.int64)
        for t in range(width - 1, -1, -1):
            path[:, t] = label
            label = came[np.arange(n), t, label]
        return [p[:m] for p, m in zip(path, items.lengths, strict=True)]
