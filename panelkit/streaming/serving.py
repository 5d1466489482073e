"""Serving protocol on Structured Streaming: predict each batch, learn when the lags of a date arrive.

The input stream carries two kinds of rows: ``test`` rows (row id, keys, weight, experts) and ``lag`` rows
(keys stamped with the delivery date, and the target of one date earlier). A micro-batch may hold any
number of dates. Its rows are summed by Spark to one Gram line per delivery date; the recurrence runs over
those lines, and the day's coefficients are joined back to the rows.

State lives in versioned Parquet under a shared folder: batch n reads version n-1 and writes version n, and
writes predictions under its own batch id, so a repeated batch after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions import scalar as S
from panelkit.operators.stats import Normal, normal_stats, normal_stats_by
from panelkit.plans.walkforward import prior_beta
from panelkit.schema import DATE, KEYS, TARGET, WEIGHT

TARGET_LAG = f"{TARGET}_lag_1"
Predictor = Callable[[DataFrame], DataFrame]
"""Base expert: test rows with attached lags in, the same rows with expert columns out."""


@dataclass
class RlsState:
    """Precision, right-hand side and the last delivery date taken in."""

    features: tuple[str, ...]
    precision: np.ndarray
    rhs: np.ndarray
    forgetting: float = 1.0
    last_update: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        p = len(self.features)
        if p == 0:
            raise ValueError("features must not be empty")
        if self.precision.shape != (p, p) or self.rhs.shape != (p,):
            raise ValueError(f"a state of {p} features has a {p} x {p} precision and {p} right-hand sides")
        if not 0.0 < self.forgetting <= 1.0:
            raise ValueError("forgetting factor must be in (0, 1]")

    @classmethod
    def prior(cls, features: Sequence[str], *, alpha: float, forgetting: float = 1.0, prior_feature: str | None = None) -> RlsState:
        if alpha <= 0.0:
            raise ValueError("alpha must be positive")
        return cls(tuple(features), alpha * np.eye(len(features)), alpha * prior_beta(features, prior_feature), forgetting)

    @classmethod
    def from_oof(cls, df: DataFrame, features: Sequence[str], **options) -> RlsState:
        """Prior plus the Gram matrix of an out-of-fold table."""

        state = cls.prior(features, **options)
        stats = normal_stats(df, features)
        if stats.rows == 0:
            raise ValueError("no rows to build the prior state from")
        state.precision, state.rhs = state.precision + stats.g, state.rhs + stats.r
        return state

    @property
    def beta(self) -> np.ndarray:
        return np.linalg.solve(self.precision, self.rhs)

    def learn(self, stats: Normal | None, date: int) -> None:
        """Take in the rows of one delivery date; a date that isn't later than the last is ignored, one without rows only marked."""

        if self.last_update is not None and date <= self.last_update:
            return
        if stats is not None and stats.rows:
            self.precision = self.forgetting * self.precision + stats.g
            self.rhs = self.forgetting * self.rhs + stats.r
        self.last_update = date

    SCHEMA = T.StructType(
        [
            T.StructField("features", T.ArrayType(T.StringType())),
            T.StructField("precision", T.ArrayType(T.DoubleType())),
            T.StructField("rhs", T.ArrayType(T.DoubleType())),
            T.StructField("forgetting", T.DoubleType()),
            T.StructField("last_update", T.LongType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ]
    )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        row = (list(self.features), self.precision.ravel().tolist(), self.rhs.tolist(), self.forgetting, self.last_update, self.metadata)
        return spark.createDataFrame([row], self.SCHEMA)

    @classmethod
    def from_frame(cls, df: DataFrame) -> RlsState:
        r = df.first()
        p = len(r["features"])
        return cls(tuple(r["features"]), np.array(r["precision"]).reshape(p, p), np.array(r["rhs"]), r["forgetting"], r["last_update"], dict(r["metadata"] or {}))

    def save(self, spark: SparkSession, path: str) -> None:
        """State artifact as one Parquet row."""

        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RlsState:
        return cls.from_frame(spark.read.schema(cls.SCHEMA).parquet(path))


def attach_lags(test: DataFrame, lags: DataFrame | None, columns: Sequence[str] = (TARGET_LAG,)) -> DataFrame:
    """Left join of the delivered lags; NULL lags before the first delivery."""

    if lags is None:
        return test.withColumns({c: F.lit(None).cast("double") for c in columns})
    return test.join(lags.select(*KEYS, *columns), list(KEYS), "left")


def lag_updates(cached: DataFrame, lags: DataFrame, features: Sequence[str], lag_column: str = TARGET_LAG) -> DataFrame:
    """Training rows that a delivery makes available: features of exactly one date earlier with their target."""

    shifted = cached.select((F.col(DATE) + F.lit(1)).cast(cached.schema[DATE].dataType).alias(DATE), *KEYS[1:], WEIGHT, *features)
    return shifted.join(lags.select(*KEYS, F.col(lag_column).alias(TARGET)), list(KEYS))


class Server:
    """``foreachBatch`` sink implementing predict-then-learn with recoverable state."""

    def __init__(self, spark: SparkSession, root: str, state: RlsState, predictor: Predictor | None = None) -> None:
        self.spark, self.root, self.initial = spark, root.rstrip("/"), state
        self.features = list(state.features)
        self.predictor = predictor or (lambda rows: rows)

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _version(self, batch_id: int) -> str:
        return f"{self.root}/state/v={batch_id}"

    def predictions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/predictions")

    def state(self, batch_id: int) -> RlsState:
        return RlsState.load(self.spark, f"{self._version(batch_id)}/model") if batch_id >= 0 else self.initial

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Process one micro-batch. Safe to repeat with the same id."""

        before = self._version(batch_id - 1)
        has_state = batch_id > 0 and self._exists(f"{before}/model")
        state = RlsState.load(self.spark, f"{before}/model") if has_state else RlsState.from_frame(self.initial.to_frame(self.spark))
        batch = batch.persist()
        experts = None
        try:
            test = batch.where(F.col("kind") == "test")
            new_lags = batch.where(F.col("kind") == "lag").select(*KEYS, TARGET_LAG)
            lags = new_lags.unionByName(self.spark.read.parquet(f"{before}/lags")) if has_state else new_lags
            experts = self.predictor(attach_lags(test.drop("kind", TARGET_LAG), lags)).persist()
            cached = experts.select(*KEYS, WEIGHT, *self.features)
            known = cached.unionByName(self.spark.read.parquet(f"{before}/cache")) if has_state else cached
            days = self._replay(state, known, new_lags, experts)
            table = self.spark.createDataFrame(days, f"{DATE} {experts.schema[DATE].dataType.simpleString()}, beta array<double>")
            # one line per date of the micro-batch
            scored = experts.join(F.broadcast(table), DATE)
            dot = S.total([F.col("beta")[i] * S.dbl(c) for i, c in enumerate(self.features)])
            scored.select("row_id", *KEYS, dot.alias(TARGET)).write.mode("overwrite").parquet(f"{self.root}/predictions/batch_id={batch_id}")
            latest = known.agg(F.max(DATE)).first()[0]
            recent = lags.agg(F.max(DATE)).first()[0]
            after = self._version(batch_id)
            known.where(F.col(DATE) == F.lit(latest)).write.mode("overwrite").parquet(f"{after}/cache")
            lags.where(F.col(DATE) == F.lit(recent)).write.mode("overwrite").parquet(f"{after}/lags")
            state.save(self.spark, f"{after}/model")
        finally:
            if experts is not None:
                experts.unpersist()
            batch.unpersist()

    def _replay(self, state: RlsState, known: DataFrame, lags: DataFrame, experts: DataFrame) -> list[tuple[int, list[float]]]:
        """Advance the state over the dates of this micro-batch and return the coefficients of each date."""

        stats = normal_stats_by(lag_updates(known, lags, self.features), self.features, DATE)
        delivered = {r[0] for r in lags.select(DATE).distinct().collect()}
        dates = {r[0] for r in experts.select(DATE).distinct().collect()}
        out = []
        for d in sorted(delivered | dates):
            if d in delivered:
                state.learn(stats.get(d), d)
            out.append((d, state.beta.tolist()))
        return out


def serve(source: DataFrame, server: Server, checkpoint: str, **trigger):
    """Start the serving query; ``availableNow=True`` drains what is there and stops."""

    return source.writeStream.foreachBatch(server).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
