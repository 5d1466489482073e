"""Causal features along the intraday path of one symbol.

Paths are partitioned by (date, symbol) and ordered by time; with the unique panel key a path is at most
as long as the day has time steps. Windows of one table share a single exchange on (date, symbol).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.core import with_ewm, with_halo
from panelkit.schema import DATE, PATH, SYMBOL, TIME, WEIGHT


def path_window():
    """Rows of one symbol's day in time order."""

    return Window.partitionBy(*PATH).orderBy(TIME)


def _positive(values: Sequence[int], what: str) -> None:
    if not values or any(v <= 0 for v in values):
        raise ValueError(f"{what} must be positive")


def _need(columns: Sequence[str]) -> None:
    if not columns:
        raise ValueError("columns must not be empty")


def _change(value: Column) -> Column:
    return F.coalesce(value - F.lag(value, 1).over(path_window()), F.lit(0.0))


def rolling_variation(df: DataFrame, columns: Sequence[str], windows: Sequence[int] = (5, 20)) -> DataFrame:
    """First difference, total and quadratic variation, roughness ``tv / (sqrt(qv) + 1e-6)``."""

    _need(columns)
    _positive(windows, "windows")
    out = df.withColumns({f"{c}_tg_diff1": _change(S.filled(c)).cast("float") for c in columns})
    added = {}
    for c in columns:
        step = S.dbl(f"{c}_tg_diff1")
        for n in windows:
            frame = path_window().rowsBetween(-(n - 1), 0)
            tv, qv = F.sum(F.abs(step)).over(frame), F.sum(step * step).over(frame)
            added[f"{c}_tg_tv_{n}"] = tv.cast("float")
            added[f"{c}_tg_qv_{n}"] = qv.cast("float")
            added[f"{c}_tg_rough_{n}"] = (tv / (F.sqrt(qv) + F.lit(1e-6))).cast("float")
    return out.withColumns(added)


def koopman_path(df: DataFrame, columns: Sequence[str], span: int = 16) -> DataFrame:
    """Square, step, value x step and value x EWM of each column."""

    _need(columns)
    _positive([span], "span")
    out = with_ewm(df, [(S.filled(c), span, f"__ewm_{c}") for c in columns], PATH, [TIME])
    out = out.withColumns({f"__step_{c}": _change(S.filled(c)) for c in columns})
    added = {}
    for c in columns:
        x = S.filled(c)
        added[f"{c}_kp_square"] = (x * x).cast("float")
        added[f"{c}_kp_delta"] = F.col(f"__step_{c}").cast("float")
        added[f"{c}_kp_value_delta"] = (x * F.col(f"__step_{c}")).cast("float")
        added[f"{c}_kp_value_ewm_{span}"] = (x * F.col(f"__ewm_{c}")).cast("float")
    return out.withColumns(added).drop(*[f"__{k}_{c}" for c in columns for k in ("ewm", "step")])


def ewm_bands(df: DataFrame, columns: Sequence[str], spans: Sequence[int] = (4, 16, 64)) -> DataFrame:
    """Differences of neighbouring EWMs, signed and absolute."""

    _need(columns)
    _positive(spans, "spans")
    if len(spans) < 2 or list(spans) != sorted(spans):
        raise ValueError("bands lie between two spans or more, the shorter first")
    out = with_ewm(df, [(S.filled(c), s, f"__ms_{c}_{s}") for c in columns for s in spans], PATH, [TIME])
    added = {}
    for c in columns:
        for fast, slow in zip(spans, spans[1:]):
            band = F.col(f"__ms_{c}_{fast}") - F.col(f"__ms_{c}_{slow}")
            added[f"{c}_ms_band_{fast}_{slow}"] = band.cast("float")
            added[f"{c}_ms_absband_{fast}_{slow}"] = F.abs(band).cast("float")
    return out.withColumns(added).drop(*[f"__ms_{c}_{s}" for c in columns for s in spans])


@dataclass(frozen=True)
class Projection:
    """Seeded linear projections; the weights end up as literals in the plan."""

    columns: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]

    @classmethod
    def gaussian(cls, columns: Sequence[str], n: int = 8, seed: int = 17) -> Projection:
        _need(columns)
        if n <= 0:
            raise ValueError("the number of projections must be positive")
        draw = np.random.default_rng(seed).normal(0.0, 1.0, size=(n, len(columns))) / np.sqrt(len(columns))
        return cls(tuple(columns), tuple(tuple(float(v) for v in row) for row in draw))

    def expressions(self) -> list[Column]:
        return [S.total([S.filled(c) * F.lit(w) for c, w in zip(self.columns, row)]) for row in self.weights]


def reservoir(df: DataFrame, projection: Projection, spans: Sequence[int] = (5, 20)) -> DataFrame:
    """EWM memory of squashed random projections."""

    _positive(spans, "spans")
    states = [F.tanh(e) for e in projection.expressions()]
    specs = [(x, s, f"reservoir_s{i:02d}_ewm_{s}") for i, x in enumerate(states) for s in spans]
    out = with_ewm(df, specs, PATH, [TIME])
    return out.withColumns({name: F.col(name).cast("float") for _, _, name in specs})


def operational_time(df: DataFrame, columns: Sequence[str], windows: Sequence[int] = (16, 64), max_time_id: int = 967) -> DataFrame:
    """Clock, tick count, cumulative weight, missingness and activity of each path so far."""

    _need(columns)
    _positive(windows, "windows")
    _positive([max_time_id], "max_time_id")
    n = float(len(columns))
    missing = S.missing_count(columns)
    fraction = F.col(TIME).cast("double") / F.lit(float(max_time_id))
    angle = fraction * F.lit(2.0 * math.pi)
    activity = S.total([F.abs(S.filled(c)) for c in columns]) / F.lit(n)
    running = path_window().rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns(
        {
            "ot_time_frac": fraction.cast("float"),
            "ot_time_sin": F.sin(angle).cast("float"),
            "ot_time_cos": F.cos(angle).cast("float"),
            "ot_symbol_tick_index": F.count(TIME).over(running).cast("float"),
            "ot_symbol_weight_cum": F.sum(S.filled(WEIGHT)).over(running).cast("float"),
            "ot_missing_count": missing.cast("float"),
            "ot_missing_frac": (missing / F.lit(n)).cast("float"),
            "ot_source_activity": activity.cast("float"),
        }
    )
    sources = (("weight", S.filled(WEIGHT)), ("source_activity", S.dbl("ot_source_activity")), ("missing_frac", S.dbl("ot_missing_frac")))
    specs = [(c, w, f"ot_symbol_{k}_ewm_{w}" if k == "weight" else f"ot_{k}_ewm_{w}") for w in windows for k, c in sources]
    out = with_ewm(out, specs, PATH, [TIME])
    return out.withColumns({name: F.col(name).cast("float") for _, _, name in specs})


def date_rolling_mean(df: DataFrame, column: str, window: int, output: str) -> DataFrame:
    """Trailing mean over the last ``window`` dates of the same time and symbol."""

    _positive([window], "window")
    over_dates = Window.partitionBy(TIME, SYMBOL).orderBy(DATE).rowsBetween(-(window - 1), 0)
    return df.withColumn(output, F.avg(S.dbl(column)).over(over_dates).cast("float"))


def auxiliary_targets(df: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """Derived targets of kind ``rolling_mean`` (window), ``abs``, ``clip`` (limit) or ``sign``."""

    for name, spec in specs.items():
        source, kind = spec["source"], spec["kind"]
        if kind == "rolling_mean":
            df = date_rolling_mean(df, source, int(spec["window"]), name)
        elif kind == "abs":
            df = df.withColumn(name, F.abs(S.dbl(source)).cast("float"))
        elif kind == "clip":
            df = df.withColumn(name, S.clip_abs(S.dbl(source), float(spec["limit"])).cast("float"))
        elif kind == "sign":
            df = df.withColumn(name, S.sign(source).cast("float"))
        else:
            raise ValueError(f"unknown derived target kind: {kind}")
    return df


def sequence_window(df: DataFrame, columns: Sequence[str], length: int, output: str = "sequence", *, dates_per_block: int = 8) -> DataFrame:
    """Last ``length`` rows of the symbol as an array of feature arrays, left-padded with zeros.

    A symbol's history is unbounded, so it is cut into date blocks that repeat the ``length - 1`` rows
    before them; no task has to hold one symbol.
    """

    _need(columns)
    _positive([length], "length")
    row = F.array(*[S.filled(c) for c in columns])
    if length == 1:
        return df.withColumn(output, F.array(row))
    cut = with_halo(df, [SYMBOL], [DATE, TIME], F.floor(F.col(DATE) / dates_per_block), length - 1)
    frame = Window.partitionBy(SYMBOL, "__block").orderBy(DATE, TIME).rowsBetween(-(length - 1), 0)
    seen = cut.withColumn("__seen", F.collect_list(row).over(frame)).where(~F.col("__halo"))
    zero = F.array(*[F.lit(0.0) for _ in columns])
    padded = F.concat(F.array_repeat(zero, F.lit(length) - F.size("__seen")), F.col("__seen"))
    return seen.withColumn(output, padded).drop("__seen", "__halo", "__block")


def batch_ids(df: DataFrame, output: str = "batch_id") -> DataFrame:
    """Dense zero-based id of each (date, time) batch.

    Numbered inside each date and shifted by the batches of earlier dates, so only the calendar passes
    through one window.
    """

    batches = df.select(DATE, TIME).distinct()
    within = batches.withColumn("__k", F.row_number().over(Window.partitionBy(DATE).orderBy(TIME)) - 1)
    before = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = batches.groupBy(DATE).agg(F.count(F.lit(1)).alias("__n")).select(DATE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = within.join(offsets, DATE).select(DATE, TIME, (F.col("__before") + F.col("__k")).cast("long").alias(output))
    return df.join(numbered, [DATE, TIME])
