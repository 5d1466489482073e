"""Previous-date lags and key joins of prediction tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.core import assert_rows, zsum
from panelkit.schema import BATCH, DATE, FOLD, KEYS, PATH, RESPONDERS, SYMBOL, TIME, clean_prefix, require_columns


def _positive(lag: int) -> None:
    if lag <= 0:
        raise ValueError("a lag is one date or more")


def lag_names(columns: Sequence[str] = RESPONDERS, lag: int = 1, *, daily: bool = False) -> tuple[str, ...]:
    _positive(lag)
    middle = "_daily_last_lag_" if daily else "_lag_"
    return tuple(f"{c}{middle}{lag}" for c in columns)


def lag_frame(df: DataFrame, columns: Sequence[str], lag: int = 1) -> DataFrame:
    """The same values stamped ``lag`` dates later."""

    names = lag_names(columns, lag)
    shifted = (F.col(DATE) + F.lit(lag)).cast(df.schema[DATE].dataType).alias(DATE)
    return df.select(shifted, TIME, SYMBOL, *[F.col(c).alias(n) for c, n in zip(columns, names)])


def with_lags(df: DataFrame, columns: Sequence[str] = RESPONDERS, lag: int = 1) -> DataFrame:
    """Value of the same time and symbol exactly ``lag`` dates ago; a missing date gives NULL.

    An equi-join on the full key, which is unique, so no key can be hot.
    """

    return df.join(lag_frame(df, columns, lag), list(KEYS), "left")


def gateway_lags(df: DataFrame, current_date: int, columns: Sequence[str] = RESPONDERS, lag: int = 1) -> DataFrame:
    """Lag table delivered with the first batch of ``current_date``."""

    _positive(lag)
    source = df.where(F.col(DATE) == F.lit(current_date - lag))
    return source.select(F.lit(current_date).alias(DATE), TIME, SYMBOL, *[F.col(c).alias(n) for c, n in zip(columns, lag_names(columns, lag))])


def daily_last_lags(df: DataFrame, columns: Sequence[str] = RESPONDERS, lag: int = 1) -> DataFrame:
    """Last observation of each symbol and date, stamped ``lag`` dates later."""

    last = F.max_by(F.struct(*columns), F.col(TIME)).alias("__last")
    names = lag_names(columns, lag, daily=True)
    daily = df.groupBy(*PATH).agg(last)
    shifted = (F.col(DATE) + F.lit(lag)).cast(df.schema[DATE].dataType).alias(DATE)
    return daily.select(shifted, SYMBOL, *[F.col(f"__last.{c}").alias(n) for c, n in zip(columns, names)])


def with_daily_last_lags(df: DataFrame, columns: Sequence[str] = RESPONDERS, lag: int = 1) -> DataFrame:
    return df.join(daily_last_lags(df, columns, lag), list(PATH), "left")


# --------------------------------------------------------------------------- prediction tables

# Fixed names of prediction columns that expert tables may carry.
KNOWN_EXPERTS = (
    "tabm_prediction",
    "ensemble_prediction",
    "ridge_calibrated_prediction",
    "xgboost_prediction",
    "lightgbm_prediction",
    "catboost_prediction",
    "latent_alpha_linear_stack",
    "ridge_rank_alpha10000",
    "pls_rank_k8",
)


def prefixed_experts(df: DataFrame, prefix: str, columns: Sequence[str] | None = None, keys: Sequence[str] = (FOLD, *KEYS)) -> DataFrame:
    """Keys and prefixed expert columns of an extra prediction table."""

    names = tuple(columns or [c for c in KNOWN_EXPERTS if c in df.columns])
    if not names:
        raise ValueError("no known prediction columns")
    tag = clean_prefix(prefix)
    return df.select(*keys, *names).withColumnsRenamed({c: f"{tag}_{c}" for c in names})


def join_experts(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str] = (FOLD, *KEYS), *, check: bool = True) -> DataFrame:
    """Inner join of expert tables on their keys; an empty result raises."""

    keys = [k for k in keys if k in base.columns]
    joined = reduce(lambda a, b: a.join(b, keys, "inner"), others, base)
    if check and joined.isEmpty():
        raise ValueError("joined prediction table is empty")
    return joined


def average_members(members: Sequence[DataFrame], prediction: str, keys: Sequence[str] = (FOLD, *KEYS), *, check: bool = True) -> DataFrame:
    """Mean prediction over seeds: one union and one aggregate instead of a chain of joins.

    Every key must occur in every member; ``check`` raises when rows would be lost.
    """

    if not members:
        raise ValueError("members must not be empty")
    together = reduce(lambda a, b: a.unionByName(b), [m.select(*keys, S.dbl(prediction).alias(prediction)) for m in members])
    mean = together.groupBy(*keys).agg(F.avg(prediction).alias(prediction), F.count(F.lit(1)).alias("members"))
    if check:
        assert_rows(mean, {"keys missing from a member": F.col("members") != len(members)})
    return mean


def enrich(df: DataFrame, raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join chosen raw columns by key."""

    names = tuple(dict.fromkeys(columns))
    require_columns(raw, [*KEYS, *names])
    return df.join(raw.select(*KEYS, *names), list(KEYS), "left")


def attach_required(df: DataFrame, values: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join that must find every row."""

    joined = df.join(values.select(*keys, *columns), list(keys), "left")
    assert_rows(joined, {f"no {c}": F.col(c).isNull() for c in columns})
    return joined


def batch_observability(rows: DataFrame, published: DataFrame, *, value: Column, column: str) -> DataFrame:
    """Recompute a batch statistic and compare it with the value a table carries."""

    own = rows.groupBy(*BATCH).agg(F.avg(value).cast("float").cast("double").alias("__own"), F.count(F.lit(1)).alias("batch_rows"))
    told = published.select(*BATCH, S.dbl(column).alias("__told")).distinct()
    gap = F.abs(F.col("__own") - F.col("__told"))
    return own.join(told, list(BATCH)).agg(
        F.count(F.lit(1)).alias("batches"),
        F.min("batch_rows").alias("batch_rows_min"),
        F.max("batch_rows").alias("batch_rows_max"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
    )


def weighted_sums(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[zsum(c).alias(n) for n, c in sums.items()])


