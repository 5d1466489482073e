"""Sums over many views of a row as block products: a task multiplies matrices of its rows and sends one line a view.

A view is a function of a feature, or of a pair of features; there can be thousands per row. Rows carry their features as
arrays (value, z-score, rank), and a block of rows makes its views in numpy, never as rows or structs of Spark. The sums
of all views against one or many targets are additive, so Spark adds up the tasks' lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.session import new_folder

#: Rows that a task multiplies at once.
BLOCK = 512

Sums = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
"""Code of the kind of view, first and second feature of each view, and its sums of w x, w x x, w x y (one column a target)."""


def _direct(code: int, a: np.ndarray, b: np.ndarray, phi: np.ndarray, w: np.ndarray, wy: np.ndarray) -> Sums:
    return code, a, b, w @ phi, w @ (phi * phi), phi.T @ wy


def single_views(exprs: Sequence[Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]) -> Callable[..., Iterator[Sums]]:
    """Views of each feature by itself: functions of the matrices of values, z-scores and ranks."""

    def make(x: np.ndarray, z: np.ndarray, r: np.ndarray, w: np.ndarray, wy: np.ndarray) -> Iterator[Sums]:
        own, none = np.arange(x.shape[1]), np.full(x.shape[1], -1)
        for code, view in enumerate(exprs):
            yield _direct(code, own, none, view(x, z, r), w, wy)

    return make


def pair_views(kinds: Mapping[str, str]) -> Callable[..., Iterator[Sums]]:
    """Views of each pair of features: kind -> ``product``, ``difference`` or ``distance`` of the matrix it names after a colon."""

    def make(x: np.ndarray, z: np.ndarray, r: np.ndarray, w: np.ndarray, wy: np.ndarray) -> Iterator[Sums]:
        held = {"sign": np.sign(x), "z": z, "rank": r}
        p = x.shape[1]
        first, second = np.triu_indices(p, 1)
        for code, how in enumerate(kinds.values()):
            rule, _, name = how.partition(":")
            m = held[name]
            if rule == "product":
                square = m * m
                xy = [(m.T @ (m * wy[:, k : k + 1]))[first, second] for k in range(wy.shape[1])]
                yield code, first, second, (m.T @ (m * w[:, None]))[first, second], (square.T @ (square * w[:, None]))[first, second], np.column_stack(xy)
                continue
            # differences pair by pair: from p x p products, those of like features would be rounding errors
            for i in range(p - 1):
                phi = m[:, i : i + 1] - m[:, i + 1 :]
                rest = np.arange(i + 1, p)
                yield _direct(code, np.full(p - 1 - i, i), rest, np.abs(phi) if rule == "distance" else phi, w, wy)

    return make


def view_sums(rows: DataFrame, split: str, weight: str, targets: str, n_targets: int, make: Callable[..., Iterator[Sums]]) -> tuple[DataFrame, dict]:
    """Train (t) and validation (v) sums of every view, and those of the targets alone.

    rows has arrays ``x``, ``z`` and ``rank`` of the features and an array column of targets, all without nulls. Returns a
    written table ``code, a, b, {t,v}_swx, {t,v}_swxx, {t,v}_swxy`` (arrays over targets), and ``{t,v}_sw`` with arrays
    ``{t,v}_swy`` and ``{t,v}_swyy``.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(n_targets, make)
        for batch in batches:
            train, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            totals.add(train, w, *(matrix(batch.column(k), batch.num_rows) for k in range(2, 6)))
        yield from totals.lines()

    narrow = rows.select(F.col(split).cast("boolean"), S.dbl(weight).alias("w"), F.col(targets).alias("ys"), "x", "z", "rank")
    return added_up(narrow.mapInArrow(partial, LINE), n_targets)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


_NAMES = ("swx", "swxx", "swxy")
LINE = "code int, a int, b int, " + ", ".join(f"{t}_{n} {'array<double>' if n == 'swxy' else 'double'}" for t in "tv" for n in _NAMES)
_ARROW = pa.schema([("code", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), *((f"{t}_{n}", pa.list_(pa.float64()) if n == "swxy" else pa.float64()) for t in "tv" for n in _NAMES)])


class Totals:
    """Sums of all views over the rows that one task has seen."""

    def __init__(self, n_targets: int, make: Callable[..., Iterator[Sums]]) -> None:
        self.n, self.make = n_targets, make
        self.acc: dict[tuple[int, int], list] = {}
        self.alone = {t: [0.0, np.zeros(n_targets), np.zeros(n_targets)] for t in "tv"}

    def add(self, train: np.ndarray, w: np.ndarray, y: np.ndarray, x: np.ndarray, z: np.ndarray, r: np.ndarray) -> None:
        for at in range(0, len(w), BLOCK):
            part = slice(at, at + BLOCK)
            for t, mine in (("t", train[part]), ("v", ~train[part])):
                if not mine.any():
                    continue
                wt, yt = w[part][mine], y[part][mine]
                wy = wt[:, None] * yt
                alone = self.alone[t]
                alone[0] += wt.sum()
                alone[1] += wy.sum(axis=0)
                alone[2] += (wy * yt).sum(axis=0)
                for code, a, b, *sums in self.make(x[part][mine], z[part][mine], r[part][mine], wt, wy):
                    slot = self.acc.setdefault((code, int(a[0]) if b[0] >= 0 and len(a) and (a == a[0]).all() else -1), [a, b, {}])
                    kept = slot[2].setdefault(t, [np.zeros_like(s) for s in sums])
                    for total, s in zip(kept, sums, strict=True):
                        total += s

    def lines(self) -> Iterator[pa.RecordBatch]:
        for (code, _), (a, b, by) in self.acc.items():
            zero = [np.zeros(len(a)), np.zeros(len(a)), np.zeros((len(a), self.n))]
            got = {t: by.get(t, zero) for t in "tv"}
            columns = {"code": [code] * len(a), "a": a, "b": b}
            columns |= {f"{t}_{n}": (s.tolist() if n == "swxy" else s) for t in "tv" for n, s in zip(_NAMES, got[t], strict=True)}
            yield pa.RecordBatch.from_pydict(columns, schema=_ARROW)
        for t in "tv":
            sw, swy, swyy = self.alone[t]
            line = {"code": [-1], "a": [0 if t == "t" else 1], "b": [-1], "t_swx": [sw], "t_swxx": [0.0], "t_swxy": [swy.tolist()], "v_swx": [0.0], "v_swxx": [0.0], "v_swxy": [swyy.tolist()]}
            yield pa.RecordBatch.from_pydict(line, schema=_ARROW)


def added_up(lines: DataFrame, n_targets: int) -> tuple[DataFrame, dict]:
    """The tasks' lines added up: what ``view_sums`` returns."""

    plain = [F.sum(f"{t}_{n}").alias(f"{t}_{n}") for t in "tv" for n in _NAMES[:2]]
    wide = [F.array(*[F.sum(F.col(f"{t}_swxy")[k]) for k in range(n_targets)]).alias(f"{t}_swxy") for t in "tv"]
    path = new_folder(lines.sparkSession, "view-sums")
    lines.groupBy("code", "a", "b").agg(*plain, *wide).write.parquet(path)
    sums = lines.sparkSession.read.parquet(path)
    alone = {}
    for line in sums.where("code = -1").collect():
        t = "tv"[line["a"]]
        alone |= {f"{t}_sw": line["t_swx"], f"{t}_swy": list(line["t_swxy"]), f"{t}_swyy": list(line["v_swxy"])}
    return sums.where("code >= 0"), {f"{t}_{n}": 0.0 if n == "sw" else [0.0] * n_targets for t in "tv" for n in ("sw", "swy", "swyy")} | alone
