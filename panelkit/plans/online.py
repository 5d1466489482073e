"""Day-by-day state replayed in batch: the state used on day D has seen days before D only.

Rows collapse to one line of sums per fold and day; the recurrences run on that calendar-sized table, and
the resulting coefficients are joined back by (fold, date).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.core import zsum
from panelkit.operators.metrics import R2, energy, loss, r2, valid_rows
from panelkit.operators.stats import MAX_GENERATED, Normal, gram, gram_exprs, solve
from panelkit.plans.walkforward import before, by_fold, fold_sums, folds_of, grams_before, pick_column, prior_beta
from panelkit.schema import DATE, FOLD, TARGET, WEIGHT
from panelkit.session import stored

DAY = (FOLD, DATE)


def _past_days():
    return Window.partitionBy(FOLD).orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)


def daily_sums(df: DataFrame, **sums: Column) -> DataFrame:
    """One row of sums per fold and date, with what was known before it."""

    daily = df.groupBy(*DAY).agg(F.count(F.lit(1)).alias("day_rows"), *[zsum(c).alias(n) for n, c in sums.items()])
    order = Window.partitionBy(FOLD).orderBy(DATE)
    return daily.withColumns({"update_source_date": F.lag(DATE).over(order), "update_rows": F.coalesce(F.lag("day_rows").over(order), F.lit(0))})


def with_decayed(daily: DataFrame, states: Mapping[str, tuple[Column, Column]], keep: float, gain: float = 1.0) -> DataFrame:
    """States ``s <- keep s + gain v`` over the earlier days of each fold: name -> (value of a day, start of the fold).

    Days are cut into blocks short enough that the powers of ``keep`` stay inside double range. Inside a block the state is
    a running sum of scaled values; what the days of a block do together is one affine map, and a block begins with the maps
    of the blocks before it (all but the last two have decayed below 1e-200). Linear in the days.
    """

    past = _past_days()
    if keep in (0.0, 1.0):
        seen = {n: F.lag(v).over(Window.partitionBy(FOLD).orderBy(DATE)) if keep == 0.0 else F.sum(v).over(past) for n, (v, _) in states.items()}
        return daily.withColumns({n: F.coalesce((0.0 if keep == 0.0 else s) + F.lit(gain) * seen[n], s) for n, (_, s) in states.items()})
    days = max(1, int(100 * math.log(10) / -math.log(keep)))
    i = F.row_number().over(Window.partitionBy(FOLD).orderBy(DATE)) - 1
    out = daily.withColumn("__i", i).withColumns({"__j": F.pmod("__i", F.lit(days)), "__b": F.floor(F.col("__i") / days)})
    inside, j, whole = Window.partitionBy(FOLD, "__b").orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1), F.col("__j"), keep**days
    ends = j == days - 1
    for n, (v, start) in states.items():
        s = start.cast("double")
        local = F.lit(gain) * F.pow(F.lit(keep), j - 1) * F.coalesce(F.sum(v * F.pow(F.lit(keep), -j)).over(inside), F.lit(0.0))
        out = out.withColumn("__local", local)
        out = out.withColumn("__end", F.when(ends, F.lit(keep) * F.col("__local") + F.lit(gain) * v))
        before = F.last("__end", ignorenulls=True).over(past)
        out = out.withColumn("__end", F.col("__end") + F.lit(whole) * F.coalesce(before, s))
        carried = F.last("__end", ignorenulls=True).over(past)
        out = out.withColumn(n, F.col("__local") + F.pow(F.lit(keep), j) * F.coalesce(carried, s))
    return out.drop("__i", "__j", "__b", "__local", "__end")


def _forgetting(value: float) -> None:
    if not 0.0 < value <= 1.0:
        raise ValueError("forgetting factor must be in (0, 1]")


def attach(df: DataFrame, daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.join(daily.select(*DAY, *columns), list(DAY))


def day_audit(daily: DataFrame) -> DataFrame:
    """Which day fed the state of which day."""

    past = F.col("update_source_date").isNull() | (F.col("update_source_date") < F.col(DATE))
    return daily.select(*DAY, F.col("day_rows").alias("predicted_rows"), "update_source_date", "update_rows", past.alias("update_is_strictly_past"))


# --------------------------------------------------------------------------- scalar calibrators


def daily_scale(df: DataFrame, prediction: str, *, prior: float, forgetting: float, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """Per-day multiplier inside each fold, starting at 1 with weight ``prior``."""

    _forgetting(forgetting)
    if prior < 0.0:
        raise ValueError("the strength of a prior is 0 or more")
    if low > high:
        raise ValueError("the bounds of the scale are the wrong way round")
    w, y, p = S.dbl(WEIGHT), S.dbl(TARGET), S.dbl(prediction)
    daily = daily_sums(df, py=w * p * y, pp=w * p * p)
    start = F.lit(float(prior))
    daily = with_decayed(daily, {"num": (F.col("py"), start), "den": (F.col("pp"), start)}, forgetting)
    return daily.withColumn("scale", S.clip(F.when(F.col("den") > 1e-18, F.col("num") / F.col("den")).otherwise(1.0), low, high))


def with_daily_scale(df: DataFrame, prediction: str, output: str, **options) -> DataFrame:
    daily = daily_scale(df, prediction, **options)
    return attach(df, daily, ["scale"]).withColumn(output, S.dbl(prediction) * F.col("scale")).drop("scale")


def daily_affine(df: DataFrame, prediction: str, *, prior: float, forgetting: float, low: float = 0.0, high: float = 2.0) -> DataFrame:
    """Per-day bias and scale from decayed 2 x 2 normal equations."""

    _forgetting(forgetting)
    if prior < 0.0:
        raise ValueError("the strength of a prior is 0 or more")
    if low > high:
        raise ValueError("the bounds of the scale are the wrong way round")
    w, y, p = S.dbl(WEIGHT), S.dbl(TARGET), S.dbl(prediction)
    daily = daily_sums(df, sw=w, sx=w * p, sxx=w * p * p, sy=w * y, sxy=w * p * y)
    a, zero = F.lit(float(prior)), F.lit(0.0)
    starts = {"sw": a, "sx": zero, "sxx": a, "sy": zero, "sxy": a}
    daily = with_decayed(daily, {f"c_{n}": (F.col(n), s) for n, s in starts.items()}, forgetting)
    det = F.col("c_sw") * F.col("c_sxx") - F.col("c_sx") * F.col("c_sx")
    empty = F.greatest(F.abs("c_sw"), F.abs("c_sx"), F.abs("c_sxx")) <= 1e-18
    # a singular system has the least-squares solution along its only direction
    trace = F.col("c_sw") + F.col("c_sxx")
    singular = F.abs(det) <= 1e-14 * F.col("c_sw") * F.col("c_sxx")
    norm = trace * trace
    flat_bias = F.try_divide(F.col("c_sw") * F.col("c_sy") + F.col("c_sx") * F.col("c_sxy"), norm)
    flat_scale = F.try_divide(F.col("c_sx") * F.col("c_sy") + F.col("c_sxx") * F.col("c_sxy"), norm)
    bias = F.when(singular, flat_bias).otherwise(F.try_divide(F.col("c_sxx") * F.col("c_sy") - F.col("c_sx") * F.col("c_sxy"), det))
    scale = F.when(singular, flat_scale).otherwise(F.try_divide(F.col("c_sw") * F.col("c_sxy") - F.col("c_sx") * F.col("c_sy"), det))
    return daily.withColumns(
        {
            "bias": F.when(empty, 0.0).otherwise(F.coalesce(bias, F.lit(0.0))),
            "scale": S.clip(F.when(empty, 1.0).otherwise(F.coalesce(scale, F.lit(1.0))), low, high),
        }
    )


def with_daily_affine(df: DataFrame, prediction: str, output: str, **options) -> DataFrame:
    daily = daily_affine(df, prediction, **options)
    return attach(df, daily, ["bias", "scale"]).withColumn(output, F.col("bias") + F.col("scale") * S.dbl(prediction)).drop("bias", "scale")


def dynamic_scale(df: DataFrame, prediction: str, *, alpha: float, forgetting: float, prior_scale: float = 1.0) -> DataFrame:
    """Per-day multiplier whose start holds the prior and every earlier fold undecayed."""

    if alpha <= 0.0:
        raise ValueError("alpha must be positive")
    _forgetting(forgetting)
    folds = folds_of(df)
    w, y, p = S.dbl(WEIGHT), S.dbl(TARGET), S.dbl(prediction)
    stats = fold_sums(df, py=w * p * y, pp=w * p * p)
    py, pp = before(folds, stats, "py"), before(folds, stats, "pp")
    daily = daily_sums(df, py=w * p * y, pp=w * p * p)
    starts = {"num": by_fold({f: alpha * prior_scale + py[f] for f in folds}), "den": by_fold({f: alpha + pp[f] for f in folds})}
    daily = with_decayed(daily, {"num": (F.col("py"), starts["num"]), "den": (F.col("pp"), starts["den"])}, forgetting)
    return daily.withColumn("scale", F.when(F.col("den") > 1e-12, F.col("num") / F.col("den")).otherwise(float(prior_scale)))


def with_dynamic_scale(df: DataFrame, prediction: str, output: str, **options) -> DataFrame:
    daily = dynamic_scale(df, prediction, **options)
    return attach(df, daily, ["scale"]).withColumn(output, F.col("scale") * S.dbl(prediction)).drop("scale")


# --------------------------------------------------------------------------- expert selection by loss


def _check_strategies(strategies: Mapping[str, str], default: str) -> None:
    if not strategies:
        raise ValueError("name one strategy or more to choose from")
    if default not in strategies:
        raise ValueError("default strategy must be one of the strategies")


def _loss_ratio(name: str) -> Column:
    return F.when(F.col("yy") > 1e-12, F.col(f"l_{name}") / F.col("yy")).otherwise(1.0)


def daily_losses(df: DataFrame, strategies: Mapping[str, str], *, default: str, decay: float) -> DataFrame:
    """EWMA of daily loss ratios before each day, one ``state_*`` column per strategy.

    A fold starts from the loss ratios of all earlier folds; the first fold slightly favours the default.
    """

    _check_strategies(strategies, default)
    if not 0.0 <= decay < 1.0:
        raise ValueError("the decay of the running loss is at least 0 and below 1")
    folds, names = folds_of(df), list(strategies)
    sums = {f"l_{n}": loss(c) for n, c in strategies.items()}
    stats = fold_sums(df, yy=energy(), **sums)
    yy = before(folds, stats, "yy")
    daily = daily_sums(df, yy=energy(), **sums)
    states = {}
    for n in names:
        past = before(folds, stats, f"l_{n}")
        start = {f: (0.0 if n == default else 1e-9) if i == 0 else (past[f] / yy[f] if yy[f] > 1e-12 else 1.0) for i, f in enumerate(folds)}
        states[f"state_{n}"] = (_loss_ratio(n), by_fold(start))
    return with_decayed(daily, states, decay, 1.0 - decay)


def argmin_name(columns: Mapping[str, Column]) -> Column:
    """Name of the smallest value; ties keep the earlier name."""

    entries = [F.struct(c.alias("v"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, c) in enumerate(columns.items())]
    return F.array_min(F.array(*entries))["name"]


def with_loss_selector(df: DataFrame, strategies: Mapping[str, str], *, default: str, decay: float, output: str = "selected_prediction") -> DataFrame:
    """Each day uses the strategy with the lowest loss state."""

    daily = daily_losses(df, strategies, default=default, decay=decay)
    daily = daily.withColumn("selected_strategy", argmin_name({n: F.col(f"state_{n}") for n in strategies}))
    rows = attach(df, daily, ["selected_strategy"])
    return rows.withColumn(output, pick_column(F.col("selected_strategy"), strategies))


def softmax(values: Mapping[str, Column]) -> dict[str, Column]:
    """Stable softmax across columns."""

    top = F.greatest(*values.values()) if len(values) > 1 else next(iter(values.values()))
    parts = {n: F.exp(v - top) for n, v in values.items()}
    return {n: p / S.total(list(parts.values())) for n, p in parts.items()}


def with_softmax_blend(df: DataFrame, strategies: Mapping[str, str], *, default: str, decay: float, eta: float, output: str = "softmax_prediction") -> DataFrame:
    """Each day blends the strategies by the softmax of their negative loss states."""

    if eta <= 0.0:
        raise ValueError("eta must be positive")
    daily = daily_losses(df, strategies, default=default, decay=decay)
    weights = softmax({n: F.lit(-float(eta)) * F.col(f"state_{n}") for n in strategies})
    daily = daily.withColumns({f"w_{n}": w for n, w in weights.items()})
    daily = daily.withColumn("selected_strategy", argmin_name({n: -F.col(f"w_{n}") for n in strategies}))
    rows = attach(df, daily, ["selected_strategy", *[f"w_{n}" for n in strategies]])
    blend = S.total([F.col(f"w_{n}") * S.dbl(c) for n, c in strategies.items()])
    return rows.withColumn(output, blend).drop(*[f"w_{n}" for n in strategies])


def with_model_average(df: DataFrame, experts: Sequence[str], *, eta: float, output: str = "bma_prediction") -> DataFrame:
    """Bayesian-style averaging: log weight of an expert is minus ``eta`` times its summed daily loss ratios."""

    if eta < 0.0:
        raise ValueError("eta must be non-negative")
    folds = folds_of(df)
    sums = {f"l_{c}": loss(c) for c in experts}
    stats = fold_sums(df, yy=energy(), **sums)
    yy = before(folds, stats, "yy")
    daily = daily_sums(df, yy=energy(), **sums)
    logs = {}
    for c in experts:
        past = before(folds, stats, f"l_{c}")
        start = by_fold({f: -eta * past[f] / yy[f] if yy[f] > 1e-12 else 0.0 for f in folds})
        ratio_today = F.when(F.col("yy") > 1e-12, F.col(f"l_{c}") / F.col("yy")).otherwise(0.0)
        daily = daily.withColumn(f"g_{c}", start - F.lit(float(eta)) * F.coalesce(F.sum(ratio_today).over(_past_days()), F.lit(0.0)))
        logs[c] = F.col(f"g_{c}")
    daily = daily.withColumns({f"w_{c}": w for c, w in softmax(logs).items()})
    rows = attach(df, daily, [f"w_{c}" for c in experts])
    return rows.withColumn(output, S.total([F.col(f"w_{c}") * S.dbl(c) for c in experts])).drop(*[f"w_{c}" for c in experts])


def with_daily_oracle(df: DataFrame, strategies: Mapping[str, str], output: str = "oracle_prediction") -> DataFrame:
    """Best strategy of the same day: an upper bound, not a forecast."""

    daily = df.groupBy(*DAY).agg(*[zsum(loss(c)).alias(f"l_{n}") for n, c in strategies.items()])
    daily = daily.withColumn("selected_strategy", argmin_name({n: F.col(f"l_{n}") for n in strategies}))
    return attach(df, daily, ["selected_strategy"]).withColumn(output, pick_column(F.col("selected_strategy"), strategies))


# --------------------------------------------------------------------------- recursive least squares


def _fold_totals(daily: DataFrame, p: int) -> dict[str, Normal]:
    names = [c for c in daily.columns if c not in DAY]
    return {r[FOLD]: Normal.from_row(r, p) for r in daily.groupBy(FOLD).agg(*[F.sum(c).alias(c) for c in names]).collect()}


def rls_states(
    df: DataFrame, features: Sequence[str], *, alpha: float, forgetting: float = 1.0, prior_feature: str | None = None, covariance: bool = False
) -> DataFrame:
    """Coefficients (and covariance) in force on each day of each fold.

    The fold starts at ``alpha I`` centred on the prior expert plus the undecayed Gram of earlier folds;
    every later day first takes in the day before. ``forgetting=1`` is the plain online ridge.
    """

    if alpha <= 0.0:
        raise ValueError("alpha must be positive")
    _forgetting(forgetting)
    folds, p = folds_of(df), len(features)
    daily = stored(gram(df, features, DAY), "daily")
    past = grams_before(folds, _fold_totals(daily, p), p)
    centre = alpha * prior_beta(features, prior_feature)
    starts = {f: (alpha * np.eye(p) + past[f].g, centre + past[f].r) for f in folds}

    def scan(day_rows: pd.DataFrame) -> pd.DataFrame:
        precision, rhs = starts[day_rows[FOLD].iloc[0]]
        pending, out = None, []
        for _, row in day_rows.sort_values(DATE).iterrows():
            if pending is not None:
                stats = Normal.from_row(pending, p)
                precision, rhs = forgetting * precision + stats.g, forgetting * rhs + stats.r
            beta = np.linalg.solve(precision, rhs)
            cov = np.linalg.inv(precision).ravel().tolist() if covariance else None
            source = None if pending is None else int(pending[DATE])
            out.append((row[FOLD], int(row[DATE]), beta.tolist(), cov, source, 0 if pending is None else int(pending["rows"]), int(row["rows"])))
            pending = row
        columns = [FOLD, DATE, "beta", "cov", "update_source_date", "update_rows", "day_rows"]
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({"update_source_date": "Int64"})

    kind = df.schema[DATE].dataType.simpleString()
    schema = f"{FOLD} string, {DATE} {kind}, beta array<double>, cov array<double>, update_source_date long, update_rows long, day_rows long"
    return daily.groupBy(FOLD).applyInPandas(scan, schema)  # one row per date of a fold


def _dot(features: Sequence[str]) -> Column:
    return S.total([F.col("beta")[i] * S.dbl(c) for i, c in enumerate(features)])


def _leverage(features: Sequence[str]) -> Column:
    p = len(features)
    terms = [F.col("cov")[i * p + j] * S.dbl(a) * S.dbl(b) for i, a in enumerate(features) for j, b in enumerate(features)]
    return F.greatest(S.total(terms), F.lit(0.0))


def with_rls(df: DataFrame, features: Sequence[str], output: str = "rls_prediction", **options) -> DataFrame:
    """Prediction of the day's recursive least-squares state."""

    return attach(df, rls_states(df, features, **options), ["beta"]).withColumn(output, _dot(features)).drop("beta")


def _strengths(strengths: Sequence[float]) -> None:
    if not strengths or any(s < 0 for s in strengths):
        raise ValueError("shrink strengths must be non-empty and non-negative")


def with_posterior_shrink(df: DataFrame, features: Sequence[str], strengths: Mapping[str, float], **options) -> DataFrame:
    """Predictions divided by ``sqrt(1 + s leverage)``; ``strengths`` maps output column to s."""

    _strengths(list(strengths.values()))
    rows = attach(df, rls_states(df, features, covariance=True, **options), ["beta", "cov"])
    rows = rows.withColumns({"__p": _dot(features), "__l": _leverage(features)})
    added = {n: F.col("__p") / F.sqrt(F.lit(1.0) + F.lit(float(s)) * F.col("__l")) for n, s in strengths.items()}
    return rows.withColumns(added).drop("beta", "cov", "__p", "__l")


@dataclass(frozen=True)
class Candidate:
    """One entry of a validation grid: its experts and the strength of its prior."""

    features: tuple[str, ...]
    alpha: float


def rls_grid(df: DataFrame, candidates: Mapping[str, Candidate], forgettings: Sequence[float], *, prior_feature: str | None = None) -> DataFrame:
    """Fold scores of every candidate under every forgetting factor, from one pass over the rows.

    All settings read the same daily Gram over the union of the experts: a candidate's states come from its rows and
    columns, and a day's loss under coefficients b is ``yy - 2 b'r + b'G b``, so no prediction is ever attached to a row.
    A group of the scan is one fold of one candidate, a line a day; its settings are solved side by side. Rows with a
    non-finite expert, target or weight don't count. Candidates without the prior expert start from zero.

    Returns candidate, forgetting, fold, rows, weight_sum, numerator, denominator, the score, days and
    update_source_date, the latest day that a state of the fold has learned from (earlier folds aside).
    """

    if not candidates or not forgettings:
        raise ValueError("a grid needs candidates and forgetting factors")
    for c in candidates.values():
        if c.alpha <= 0.0 or not c.features:
            raise ValueError("a candidate has experts and a positive alpha")
    for value in forgettings:
        _forgetting(value)
    union = list(dict.fromkeys(x for c in candidates.values() for x in c.features))
    if len(union) > MAX_GENERATED:
        raise ValueError(f"the candidates have more than {MAX_GENERATED} experts together")
    p = len(union)
    daily = stored(gram(df.where(valid_rows([*union, TARGET])), union, DAY), "daily")
    folds = folds_of(daily)
    past = grams_before(folds, _fold_totals(daily, p), p)
    places = {n: [union.index(x) for x in c.features] for n, c in candidates.items()}
    keep = np.array(forgettings, float)

    def scan(day_rows: pd.DataFrame) -> pd.DataFrame:
        name, fold = day_rows["candidate"].iloc[0], day_rows[FOLD].iloc[0]
        candidate, at = candidates[name], places[name]
        start = past[fold].take(at)
        precision = np.repeat((candidate.alpha * np.eye(len(at)) + start.g)[None], len(keep), 0)
        rhs = np.repeat((candidate.alpha * prior_beta(candidate.features, prior_feature) + start.r)[None], len(keep), 0)
        numerator, denominator, weight_sum, rows, source, seen = np.zeros(len(keep)), 0.0, 0.0, 0, None, None
        for _, row in day_rows.sort_values(DATE).iterrows():
            source = seen
            beta = np.linalg.solve(precision, rhs[..., None])[..., 0]
            day = Normal.from_row(row, p).take(at)
            numerator += day.yy - 2.0 * beta @ day.r + np.einsum("si,ij,sj->s", beta, day.g, beta)
            denominator, weight_sum, rows, seen = denominator + day.yy, weight_sum + day.weight_sum, rows + day.rows, row[DATE]
            precision = keep[:, None, None] * precision + day.g
            rhs = keep[:, None] * rhs + day.r
        return pd.DataFrame({
            "candidate": name, "forgetting": keep, FOLD: fold, "rows": int(rows), "weight_sum": weight_sum, "numerator": numerator,
            "denominator": denominator, "days": len(day_rows), "update_source_date": pd.array([source] * len(keep), dtype="Int64"),
        })

    settings = daily.withColumn("candidate", F.explode(F.array(*[F.lit(n) for n in candidates])))
    schema = f"candidate string, forgetting double, {FOLD} string, rows long, weight_sum double, numerator double, denominator double, days long, update_source_date long"
    return settings.groupBy("candidate", FOLD).applyInPandas(scan, schema).withColumn(R2, r2())


# Fixed risk profiles: which relative risks multiply the leverage.
RISK_PROFILES = {
    "disagreement": ("disagreement",),
    "abs_pred": ("abs_pred",),
    "weight": ("weight",),
    "disagreement_weight": ("disagreement", "weight"),
    "all": ("disagreement", "abs_pred", "weight"),
}


def with_risk_shrink(df: DataFrame, features: Sequence[str], strengths: Sequence[float], profiles: Sequence[str], prefix: str = "risk_rls", **options) -> DataFrame:
    """Posterior shrinkage whose leverage grows with disagreement, magnitude and weight."""

    _strengths(strengths)
    unknown = sorted(set(profiles) - set(RISK_PROFILES))
    if unknown or not profiles:
        raise ValueError(f"unknown risk profiles: {unknown}")
    rows = attach(df, rls_states(df, features, covariance=True, **options), ["beta", "cov"])
    rows = rows.withColumns({"__p": _dot(features), "__l": _leverage(features)})
    values = [S.dbl(c) for c in features]
    magnitude = S.row_mean([F.abs(v) for v in values])
    risks = {
        "disagreement": S.clip(S.row_std(values) / F.greatest(magnitude, F.lit(1e-8)), 0.0, 5.0),
        "abs_pred": S.clip(F.abs("__p"), 0.0, 5.0),
        "weight": S.clip(F.log1p(F.greatest(S.dbl(WEIGHT), F.lit(0.0))), 0.0, 5.0),
    }
    added = {}
    for profile in profiles:
        multiplier = S.total([F.lit(1.0), *[risks[r] for r in RISK_PROFILES[profile]]])
        for s in strengths:
            added[f"{prefix}_{profile}_s{f'{s:.6g}'.replace('.', 'p')}_prediction"] = F.col("__p") / F.sqrt(F.lit(1.0) + F.lit(float(s)) * F.col("__l") * multiplier)
    return rows.withColumns(added).drop("beta", "cov", "__p", "__l")


def expert_feature_sets(experts: Sequence[str], *, base: str, groups: Mapping[str, Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """Named expert subsets without repetitions: all, all with the base first, and the given groups."""

    candidates = {"experts": tuple(experts), "with_baseline": (base, *experts)}
    candidates |= {n: tuple(c for c in cols if c in experts) for n, cols in groups.items()}
    out: dict[str, tuple[str, ...]] = {}
    for name, columns in candidates.items():
        if columns and columns not in out.values():
            out[name] = columns
    return out


def chunk_online_ridge(
    df: DataFrame, features: Sequence[str], *, alpha: float, decay: float, chunk_days: int, means: Mapping[str, float], scales: Mapping[str, float], last_train_date: int
) -> tuple[DataFrame, np.ndarray]:
    """Intercept ridge updated chunk by chunk with decay over the training dates.

    Returns the chunk Gram table and the coefficients (intercept first) after the last training chunk.
    """

    p = len(features)
    train = df.where(F.col(DATE) <= last_train_date)
    values = [F.lit(1.0), *[(S.filled(c) - F.lit(means[c])) / F.lit(scales[c]) for c in features]]
    chunk = S.int_bucket(DATE, chunk_days).alias("chunk")
    chunks = train.groupBy(chunk).agg(*gram_exprs(values, S.dbl(TARGET), S.dbl(WEIGHT)))
    g, r = np.zeros((p + 1, p + 1)), np.zeros(p + 1)
    for row in chunks.orderBy("chunk").collect():  # one line per chunk of the calendar
        stats = Normal.from_row(row, p + 1)
        g, r = decay * g + stats.g, decay * r + stats.r
    penalty = alpha * np.eye(p + 1)
    penalty[0, 0] = 0.0
    return chunks, solve(g + penalty, r)


