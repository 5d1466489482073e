"""Composed studies: clock tournament, frozen rules, latent models and residual mining."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.blend import fit_grouped_simplex
from panelkit.operators.calibrate import abs_thresholds, fit_shrinkage, weight_thresholds
from panelkit.operators.core import distinct_sorted
from panelkit.operators.folds import date_blocks
from panelkit.operators.gates import CLOCKS, fit_clock_bins, fit_tail_advantage, tail_switch
from panelkit.operators.metrics import candidate_scores
from panelkit.operators.paths import operational_time
from panelkit.operators.screens import IS_TRAIN, VIEWS, base_views, fit_sums, transform_views, with_fit
from panelkit.operators.stats import Normal, gram, linear_expr, solve
from panelkit.operators.xsection import batch_state
from panelkit.plans.experts import pls_coefficients
from panelkit.schema import DATE, KEYS, TARGET, WEIGHT
from panelkit.session import stored


def clock_inputs(df: DataFrame, features: Sequence[str], *, windows: Sequence[int] = (64,), max_time_id: int = 967) -> DataFrame:
    """Operational clocks and batch state, the sources of every clock."""

    return batch_state(operational_time(df, features, windows, max_time_id))


# Fixed group columns of the tournament's shrinkage strategies.
SHRINKS = {"clock_shrink": ("clock_bucket",), "clock_weight_shrink": ("clock_bucket", "weight_bucket"), "clock_predabs_shrink": ("clock_bucket", "ensemble_abs_bucket")}
TAILS = {"clock_simplex_tail_q99_q100": ("q99_q100",), "clock_simplex_tail_q90_q100": ("q90_q99", "q99_q100")}


def clock_tournament(
    calibration: DataFrame, validation: DataFrame, experts: Sequence[str], base: str, *, clocks: Sequence[str] = tuple(CLOCKS), buckets: int = 8, min_rows: int = 2_000, max_time_id: int = 967
) -> DataFrame:
    """Score shrinkage, simplex and tail strategies under each clock on validation rows, by weight bucket.

    Both tables carry the clock inputs. Candidates are ``clock/strategy``.
    """

    unknown = sorted(set(clocks) - set(CLOCKS))
    if unknown:
        raise ValueError(f"unknown clocks: {unknown}")
    marks = {
        "weight_bucket": S.quantile_bucket(WEIGHT, weight_thresholds(calibration), S.WEIGHT_LABELS),
        "ensemble_abs_bucket": S.quantile_bucket(F.abs(S.dbl(base)), abs_thresholds(calibration, [base])[base]),
    }
    # read by every clock and strategy, so that what made the clock inputs runs once
    cal, val = stored(calibration.withColumns(marks), "calibration"), stored(validation.withColumns(marks), "validation")
    parts = [candidate_scores(val, {"base": base}, by=["weight_bucket"])]
    for clock in clocks:
        source, mode = CLOCKS[clock]
        bins = {"clock_bucket": fit_clock_bins(cal, source, mode=mode, buckets=buckets, max_time_id=max_time_id).column()}
        c, v = cal.withColumns(bins), val.withColumns(bins)
        outputs = {}
        for name, groups in SHRINKS.items():
            v = fit_shrinkage(c, groups, name=name, prediction=base, min_rows=min_rows).apply(v, base, f"__{name}")
            outputs[f"{clock}/{name}"] = f"__{name}"
        simplex = fit_grouped_simplex(c, ["clock_bucket"], experts, min_rows=min_rows)
        c, v = simplex.apply(c, "__simplex"), simplex.apply(v, "__simplex")
        outputs[f"{clock}/clock_simplex"] = "__simplex"
        for name, tail in TAILS.items():
            v = v.withColumn(f"__{name}", tail_switch(base, "__simplex", tail))
            outputs[f"{clock}/{name}"] = f"__{name}"
        policy = fit_tail_advantage(c, ["clock_bucket"], base=base, candidate="__simplex", min_rows=min_rows)
        v = policy.apply(v, "__advantage")
        outputs[f"{clock}/clock_simplex_tail_advantage_q90_q100"] = "__advantage"
        parts.append(candidate_scores(v, outputs, by=["weight_bucket"]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def frozen_rules(df: DataFrame, rules: Sequence[tuple[str, str]], *, windows: int = 5, min_train_windows: int = 1) -> DataFrame:
    """Fixed ``(feature, transform)`` rules refitted on earlier date blocks and scored on the next."""

    if len(distinct_sorted(df, DATE)) < windows + 1:
        raise ValueError("not enough dates for frozen walk-forward")
    blocks = date_blocks(df, windows)
    bounds = {r["block"]: (r["lo"], r["hi"]) for r in blocks.groupBy("block").agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).collect()}
    features = list(dict.fromkeys(f for f, _ in rules))
    views = list(dict.fromkeys(t for _, t in rules))
    wanted = reduce(lambda a, b: a | b, [(F.col("feature") == f) & (F.col("transform") == t) for f, t in rules])
    parts = []
    for i in range(min_train_windows, windows):
        rows = df.where(F.col(DATE) <= bounds[i][1]).withColumn(IS_TRAIN, F.col(DATE) < bounds[i][0])
        fits = with_fit(fit_sums(transform_views(rows, features, views).where(wanted), ["feature", "transform"]))
        named = fits.select(F.concat_ws("::", "feature", "transform").alias("rule"), "alpha", "valid_r2", "valid_corr")
        parts.append(named.withColumns({"window_index": F.lit(i), "train_end": F.lit(bounds[i - 1][1]), "valid_start": F.lit(bounds[i][0]), "valid_end": F.lit(bounds[i][1])}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _rank_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with one centred rank column per feature."""

    keep = [*KEYS, WEIGHT, TARGET, IS_TRAIN]
    long = base_views(df.select(*keep, *features), features)
    ranks = [F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f"rank_{f}") for f in features]
    return long.groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in (WEIGHT, TARGET, IS_TRAIN)], *ranks)


def latent_models(df: DataFrame, features: Sequence[str], *, alphas: Sequence[float] = (1.0, 10.0, 100.0, 1000.0, 10000.0), components: Sequence[int] = (1, 2, 4, 8)) -> tuple[list[dict], dict[str, np.ndarray], DataFrame]:
    """Ridge grid and PLS on centred ranks: fits and validation scores from one Gram pass.

    Returns the scores, the coefficients (intercept first) of each model and the rank table.
    """

    table = _rank_table(df, features)
    names = ["__one", *[f"rank_{f}" for f in features]]
    design = table.withColumns({"__one": F.lit(1.0), "__unit": F.lit(1.0)})
    p = len(names)
    weighted = {r[IS_TRAIN]: Normal.from_row(r, p) for r in gram(design, names, [IS_TRAIN]).collect()}
    plain = Normal.from_row(gram(design.where(F.col(IS_TRAIN)), names, weight="__unit").first(), p)
    train, valid = weighted[True], weighted[False]
    fitted: dict[str, np.ndarray] = {}
    for a in alphas:
        penalty = a * np.eye(p)
        penalty[0, 0] = 0.0
        fitted[f"ridge_rank_alpha{a:g}"] = solve(train.g + penalty, train.r)
    n = plain.g[0, 0]
    mean, y_mean = plain.g[0, 1:] / n, plain.r[0] / n
    xx, xy = plain.g[1:, 1:] - n * np.outer(mean, mean), plain.r[1:] - n * mean * y_mean
    for k in components:
        if k <= min(len(features), int(n)):
            beta = pls_coefficients(xx, xy, k)
            fitted[f"pls_rank_k{k}"] = np.concatenate([[y_mean - mean @ beta], beta])
    scores = [
        {"model": m, "family": "ridge_rank" if m.startswith("ridge") else "pls_rank_unweighted_fit", "valid_r2": 1.0 - valid.loss(b) / valid.yy if valid.yy > 0 else 0.0}
        for m, b in fitted.items()
    ]
    return sorted(scores, key=lambda s: -s["valid_r2"]), fitted, table


def residual_mining(df: DataFrame, features: Sequence[str], views: Sequence[str] = VIEWS, **options) -> DataFrame:
    """Univariate views fitted on the training residual of the best latent model."""

    scores, fitted, table = latent_models(df, features, **options)
    best = scores[0]
    beta = fitted[best["model"]]
    base = F.lit(float(beta[0])) + linear_expr([f"rank_{f}" for f in features], beta[1:])
    residual = table.select(*KEYS, (S.dbl(TARGET) - base).alias("__resid"))
    rows = stored(df.join(residual, list(KEYS)), "residuals")
    long = transform_views(rows, features, views)
    fits = with_fit(fit_sums(long, ["feature", "transform"], y="__resid"))
    valid = df.where(~F.col(IS_TRAIN))
    yy = valid.agg(F.sum(S.dbl(WEIGHT) * S.dbl(TARGET) * S.dbl(TARGET))).first()[0]
    # sums of the residual on validation rows give the loss of base + alpha phi
    numerator = F.col("v_swyy") - 2 * F.col("alpha") * F.col("v_swxy") + F.col("alpha") * F.col("alpha") * F.col("v_swxx")
    final = 1.0 - numerator / F.lit(float(yy))
    return fits.select(
        F.lit(best["model"]).alias("baseline_model"), F.col("feature").alias("residual_feature"), F.col("transform").alias("residual_transform"), "alpha",
        F.lit(float(best["valid_r2"])).alias("baseline_valid_r2"), final.alias("final_valid_r2"), (final - F.lit(float(best["valid_r2"]))).alias("delta_r2"),
    )


