"""Prediction blends fitted from sums: convex pairs, grouped pairs and simplex mixes."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.calibrate import GroupModel, _bounded, _positive_rows, _sums, group_ratio
from panelkit.operators.core import assert_rows, join_groups
from panelkit.operators.stats import Normal, gram, normal_stats, solve
from panelkit.schema import TARGET, WEIGHT, number_tag


def pair_terms(left: Column, right: Column, target: str = TARGET, weight: str = WEIGHT) -> tuple[Column, Column]:
    """Numerator and denominator terms of the best weight of ``left`` against ``right``."""

    gap = left - right
    return S.dbl(weight) * gap * (S.dbl(target) - right), S.dbl(weight) * gap * gap


def convex(left: str, right: str, weight: Column | float) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w * S.dbl(left) + (F.lit(1.0) - w) * S.dbl(right)


def add_convex(df: DataFrame, left: str, right: str, weight: float, output: str = "blend_prediction") -> DataFrame:
    if not 0.0 <= weight <= 1.0:
        raise ValueError("the share of a blend lies between 0 and 1")
    return df.withColumn(output, convex(left, right, weight))


def fit_convex(df: DataFrame, left: str, right: str, *, target: str = TARGET, weight: str = WEIGHT) -> float:
    """Least-squares weight of ``left``, clipped to [0, 1]; 0 when the two never differ."""

    num, den = pair_terms(S.dbl(left), S.dbl(right), target, weight)
    sums = _sums(df, n=num, d=den)
    return _bounded(sums["n"], sums["d"], 0.0, 1.0, 0.0)


def fit_grouped_convex(df: DataFrame, groups: Sequence[str], left: str, right: str, *, target: str = TARGET, weight: str = WEIGHT, min_rows: int = 1_000) -> GroupModel:
    """Convex weight per group with the global weight as fallback."""

    _positive_rows(min_rows)
    fallback = fit_convex(df, left, right, target=target, weight=weight)
    if not groups:
        return GroupModel((), None, fallback)
    num, den = pair_terms(S.dbl(left), S.dbl(right), target, weight)
    return GroupModel(tuple(groups), group_ratio(df, num, den, groups, min_rows=min_rows, fallback=fallback, low=0.0, high=1.0), fallback)


def apply_convex(df: DataFrame, model: GroupModel, left: str, right: str, output: str = "blend_prediction") -> DataFrame:
    return model.apply(df, lambda w: convex(left, right, w), output)


def simplex_weights(stats: Normal) -> np.ndarray:
    """Non-negative weights that sum to 1 and minimise the loss, by an active set.

    Starts at the best single expert. The loss is minimised over the experts in use under the sum alone; a weight that would
    turn negative stops the step and leaves, and when none does, the expert whose use lowers the loss fastest comes in.
    Works on the k x k Gram matrix alone.
    """

    g, r, k = stats.g, stats.r, len(stats.r)
    if not (np.isfinite(g).all() and np.isfinite(r).all()):
        return np.full(k, 1.0 / k)
    small = 1e-11 * max(np.abs(g).max(), np.abs(r).max(), 1e-300)
    used = [int(np.argmin(np.diag(g) - 2.0 * r))]
    w = np.zeros(k)
    w[used] = 1.0
    for _ in range(20 * k + 20):
        while len(used) > 1:
            m = len(used)
            system = np.ones((m + 1, m + 1))
            system[:m, :m], system[m, m] = g[np.ix_(used, used)], 0.0
            goal = solve(system, np.append(r[used], 1.0))[:m]
            if not np.isfinite(goal).all():
                break
            here = w[used]
            falls = np.flatnonzero(goal < 0.0)
            if not len(falls):
                w[used] = goal
                break
            share = here[falls] / (here[falls] - goal[falls])
            first = int(share.argmin())
            w[used] = np.maximum(here + share[first] * (goal - here), 0.0)
            w[used.pop(int(falls[first]))] = 0.0
        if len(used) == 1:
            w[:] = 0.0
            w[used] = 1.0
        slope = g @ w - r
        gain = slope - slope[used] @ w[used]
        gain[used] = 0.0
        new = int(gain.argmin())
        if gain[new] >= -small:
            break
        used = sorted([*used, new])
    w = np.where(w < 1e-12, 0.0, w)
    return w / w.sum()


def fit_simplex(df: DataFrame, predictions: Sequence[str], *, target: str = TARGET, weight: str = WEIGHT) -> dict[str, float]:
    if not predictions:
        raise ValueError("there is nothing to blend")
    assert_rows(df, {"negative weights": S.dbl(weight) < 0})
    stats = normal_stats(df, predictions, target=target, weight=weight)
    if stats.weight_sum <= 0.0:
        raise ValueError("shares that add up to nothing can't be scaled to 1")
    return dict(zip(predictions, (float(v) for v in simplex_weights(stats))))


def add_simplex(df: DataFrame, weights: Mapping[str, float], output: str = "ensemble_prediction") -> DataFrame:
    if not weights:
        raise ValueError("a blend needs one share or more")
    if abs(sum(weights.values()) - 1.0) > 1e-6:
        raise ValueError("the shares of a blend add up to 1")
    if any(v < -1e-12 for v in weights.values()):
        raise ValueError("a share of a blend is 0 or more")
    return df.withColumn(output, S.total([S.dbl(c) * F.lit(float(v)) for c, v in weights.items()]))


@dataclass(frozen=True)
class GroupedSimplex:
    groups: tuple[str, ...]
    predictions: tuple[str, ...]
    parameters: DataFrame | None
    fallback: dict[str, float]

    def apply(self, df: DataFrame, output: str = "clock_simplex_prediction") -> DataFrame:
        if self.parameters is None:
            return add_simplex(df, self.fallback, output)
        joined = join_groups(df, self.parameters.drop("rows"), self.groups)
        terms = [F.coalesce(F.col(f"w_{c}"), F.lit(self.fallback[c])) * S.dbl(c) for c in self.predictions]
        return joined.withColumn(output, S.total(terms)).drop(*[f"w_{c}" for c in self.predictions])


def fit_grouped_simplex(df: DataFrame, groups: Sequence[str], predictions: Sequence[str], *, min_rows: int = 1_000, target: str = TARGET, weight: str = WEIGHT) -> GroupedSimplex:
    """Simplex weights per group: Spark sums the Gram entries, tasks solve the tiny systems."""

    _positive_rows(min_rows)
    fallback = fit_simplex(df, predictions, target=target, weight=weight)
    if not groups:
        return GroupedSimplex((), tuple(predictions), None, fallback)
    stats = gram(df, predictions, groups, target=target, weight=weight).where(F.col("rows") >= min_rows)
    names, keys, k = list(predictions), list(groups), len(predictions)

    def solve_batch(batches):
        for batch in batches:
            found = [simplex_weights(Normal.from_row(row, k)) for _, row in batch.iterrows()]
            out = batch[[*keys, "rows"]].copy()
            for i, c in enumerate(names):
                out[f"w_{c}"] = [float(f[i]) for f in found]
            yield out if len(out) else pd.DataFrame(columns=out.columns)

    schema = ", ".join([f"`{g}` {stats.schema[g].dataType.simpleString()}" for g in keys] + ["rows long"] + [f"`w_{c}` double" for c in names])
    return GroupedSimplex(tuple(groups), tuple(predictions), stats.mapInPandas(solve_batch, schema), fallback)


def fixed_blends(candidates: Sequence[str], weights: Sequence[float]) -> dict[str, Column]:
    """Every pair of candidates at every fixed weight."""

    pairs = enumerate(itertools.combinations(dict.fromkeys(candidates), 2))
    return {f"fixed_blend_{i}_w{number_tag(w)}_prediction": convex(a, b, w) for i, (a, b) in pairs for w in weights}
