"""Sufficient statistics: weighted Gram matrices, moments, correlations, and small dense solves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelkit.functions import scalar as S
from panelkit.operators.core import ratio, zsum
from panelkit.operators.metrics import valid_rows
from panelkit.schema import TARGET, WEIGHT

# Above this width one generated sum per matrix entry would outgrow a codegen method.
MAX_GENERATED = 40


def gram_exprs(values: Sequence[Column], target: Column, weight: Column) -> list[Column]:
    """Upper triangle ``g_i_j``, right-hand side ``r_i``, target energy ``yy``, weight and rows."""

    p = len(values)
    sums = [zsum(weight * values[i] * values[j]).alias(f"g_{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [zsum(weight * values[i] * target).alias(f"r_{i}") for i in range(p)]
    return [*sums, zsum(weight * target * target).alias("yy"), zsum(weight).alias("weight_sum"), F.count(F.lit(1)).alias("rows")]


def gram(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), *, target: str = TARGET, weight: str = WEIGHT, fill: bool = False) -> DataFrame:
    """``X'WX`` and ``X'Wy`` as one aggregate of generated sums."""

    if not features:
        raise ValueError("feature columns must not be empty")
    values = [S.filled(c) if fill else S.dbl(c) for c in features]
    return df.groupBy(*by).agg(*gram_exprs(values, S.dbl(target), S.dbl(weight)))


@dataclass
class Normal:
    """A Gram matrix with its right-hand side; additive like the rows behind it."""

    g: np.ndarray
    r: np.ndarray
    yy: float = 0.0
    weight_sum: float = 0.0
    rows: int = 0

    @classmethod
    def zeros(cls, p: int) -> Normal:
        return cls(np.zeros((p, p)), np.zeros(p))

    @classmethod
    def from_row(cls, row, p: int) -> Normal:
        g = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
        return cls(g, np.array([row[f"r_{i}"] for i in range(p)]), row["yy"], row["weight_sum"], row["rows"])

    def __add__(self, other: Normal) -> Normal:
        return Normal(self.g + other.g, self.r + other.r, self.yy + other.yy, self.weight_sum + other.weight_sum, self.rows + other.rows)

    def take(self, idx: Sequence[int]) -> Normal:
        return Normal(self.g[np.ix_(idx, idx)], self.r[list(idx)], self.yy, self.weight_sum, self.rows)

    def loss(self, beta: np.ndarray) -> float:
        """``sum w (y - x beta)^2`` without another pass over the rows."""

        return float(self.yy - 2.0 * beta @ self.r + beta @ self.g @ beta)


def solve(system: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(system, rhs)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(system, rhs, rcond=None)[0]


def normal_stats(df: DataFrame, features: Sequence[str], *, target: str = TARGET, weight: str = WEIGHT, fill: bool = False) -> Normal:
    """Gram matrix of the whole table as numbers."""

    if len(features) > MAX_GENERATED:
        return _wide_stats(df, features, None, target, weight, fill).get(None, Normal.zeros(len(features)))
    return Normal.from_row(gram(df, features, target=target, weight=weight, fill=fill).first(), len(features))


def normal_stats_by(df: DataFrame, features: Sequence[str], key: str, *, target: str = TARGET, weight: str = WEIGHT, fill: bool = False) -> dict:
    """Gram matrix per value of a fold-like key."""

    if len(features) > MAX_GENERATED:
        return _wide_stats(df, features, key, target, weight, fill)
    return {r[key]: Normal.from_row(r, len(features)) for r in gram(df, features, [key], target=target, weight=weight, fill=fill).collect()}


def _weighted_products(z: np.ndarray, w: np.ndarray, seen: np.ndarray, weighed: np.ndarray) -> np.ndarray:
    """Sums of w * z_i * z_j over the rows where none of the three is NULL; NaN counts as a value."""

    z, w = np.where(seen, z, 0.0), np.where(weighed, w, 0.0)
    odd = ~(np.isfinite(z).all(1) & np.isfinite(w))
    out = z[~odd].T @ (z[~odd] * w[~odd, None])
    for k in np.flatnonzero(odd & weighed):  # a NULL beside a NaN or an infinity must not become 0 * NaN
        there = np.flatnonzero(seen[k])
        out[np.ix_(there, there)] += np.outer(z[k, there], z[k, there]) * w[k]
    return out


def _wide_stats(df: DataFrame, features: Sequence[str], key: str | None, target: str, weight: str, fill: bool) -> dict:
    """Partial Gram per task and key value in numpy, summed entry by entry by Spark (p^2 numbers per task and value)."""

    names = list(features)
    p = len(names)
    label = F.lit(None).cast("int") if key is None else F.col(key)
    narrow = df.select(label.alias("__key"), *[(S.filled(c) if fill else S.dbl(c)).alias(f"__z{i}") for i, c in enumerate(names)], S.dbl(target).alias("__y"), S.dbl(weight).alias("__w"))
    kind = narrow.schema["__key"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        for batch in batches:
            columns = batch.columns
            seen = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns[1:]])
            values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns[1:]])
            codes = columns[0].dictionary_encode()
            index = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k, value in [*enumerate(codes.dictionary.to_pylist()), (-1, None)]:
                mine = index == k
                if mine.any():
                    sums = acc.setdefault(value, np.zeros((p + 1, p + 2)))
                    z, w, ok = values[mine, :-1], values[mine, -1], seen[mine]
                    sums[:, : p + 1] += _weighted_products(z, w, ok[:, :-1], ok[:, -1])
                    sums[0, p + 1] += w[ok[:, -1]].sum()
                    sums[1, p + 1] += len(z)
        for value, sums in acc.items():
            yield pa.RecordBatch.from_pydict({"__key": pa.array([value] * sums.size, schema[0].type), "k": pa.array(range(sums.size), pa.int32()), "v": pa.array(sums.ravel())}, schema=schema)

    schema = to_arrow_schema(T._parse_datatype_string(f"__key {kind}, k int, v double"))
    entries = narrow.mapInArrow(partial, f"__key {kind}, k int, v double").groupBy("__key", "k").agg(F.sum("v").alias("v")).collect()
    found: dict = {}
    for e in entries:
        found.setdefault(e["__key"], np.zeros((p + 1) * (p + 2)))[e["k"]] = e["v"]
    out = {}
    for value, flat in found.items():
        acc = flat.reshape(p + 1, p + 2)
        out[value] = Normal(acc[:p, :p], acc[:p, p], float(acc[p, p]), float(acc[0, p + 1]), int(acc[1, p + 1]))
    return out


def linear_expr(features: Sequence[str], beta: Sequence[float], *, fill: bool = False) -> Column:
    """Dot product with literal coefficients."""

    return S.total([(S.filled(c) if fill else S.dbl(c)) * F.lit(float(b)) for c, b in zip(features, beta)])


def moments(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation after null -> 0; tiny deviations count as 1."""

    out = []
    for c in features:
        s = F.stddev_pop(S.filled(c))
        out += [F.avg(S.filled(c)).alias(f"mean_{c}"), F.when((s > 1e-12) & S.is_finite(s), s).otherwise(1.0).alias(f"scale_{c}")]
    return df.groupBy(*by).agg(*out)


def standardizer(df: DataFrame, features: Sequence[str], *, impute: str = "zero") -> tuple[dict[str, float], dict[str, float]]:
    """Means and scales as numbers. ``impute='mean'`` ignores non-finite values and fills them with the mean,
    so the squared deviations count finite rows only."""

    if impute == "zero":
        row = moments(df, features).first()
        return {c: row[f"mean_{c}"] for c in features}, {c: row[f"scale_{c}"] for c in features}
    finite = {c: F.when(S.is_finite(c), S.dbl(c)) for c in features}
    row = df.agg(*[F.avg(x).alias(f"m_{c}") for c, x in finite.items()], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in finite.items()]).first()
    means = {c: row[f"m_{c}"] if row[f"m_{c}"] is not None else 0.0 for c in features}
    scales = {c: row[f"s_{c}"] if row[f"s_{c}"] is not None and row[f"s_{c}"] > 1e-12 else 1.0 for c in features}
    return means, scales


def z_expr(column: str, mean: float, scale: float) -> Column:
    """z-score with non-finite values at the mean."""

    return (F.when(S.is_finite(column), S.dbl(column)).otherwise(mean) - F.lit(mean)) / F.lit(scale)


def weighted_scale(df: DataFrame, prediction: str, by: Sequence[str] = (), *, prior: float = 0.0, target: str = TARGET, weight: str = WEIGHT) -> DataFrame:
    """Least-squares multiplier of a prediction with an optional prior towards 1."""

    w, y, p = S.dbl(weight), S.dbl(target), S.dbl(prediction)
    lhs = zsum(w * p * p) + F.lit(max(prior, 0.0))
    return df.groupBy(*by).agg(F.when(lhs > 0, (zsum(w * p * y) + F.lit(max(prior, 0.0))) / lhs).otherwise(0.0).alias("scale"))


def corr_exprs(x: Column, y: Column, w: Column) -> list[Column]:
    """Sums behind a weighted centred correlation."""

    terms = {"sw": w, "swx": w * x, "swy": w * y, "swxx": w * x * x, "swyy": w * y * y, "swxy": w * x * y}
    return [zsum(e).alias(n) for n, e in terms.items()]


def corr_from_sums() -> Column:
    vx = F.col("swxx") - ratio(F.col("swx") * F.col("swx"), F.col("sw"))
    vy = F.col("swyy") - ratio(F.col("swy") * F.col("swy"), F.col("sw"))
    cov = F.col("swxy") - ratio(F.col("swx") * F.col("swy"), F.col("sw"))
    # centred energies below the rounding noise of their sums mean a constant side
    flat = (vx <= 1e-13 * F.col("swxx")) | (vy <= 1e-13 * F.col("swyy"))
    return F.when((F.col("sw") > 0) & ~flat, F.try_divide(cov, F.sqrt(vx * vy))).otherwise(0.0)


def weighted_corr(df: DataFrame, x: str, y: str = TARGET, by: Sequence[str] = (), *, weight: str = WEIGHT) -> DataFrame:
    """Weighted means and centred correlation over valid rows; 0 when a side is constant."""

    sums = df.where(valid_rows([x, y], weight)).groupBy(*by).agg(*corr_exprs(S.dbl(x), S.dbl(y), S.dbl(weight)))
    mean_x, mean_y = F.coalesce(ratio(F.col("swx"), F.col("sw")), F.lit(0.0)), F.coalesce(ratio(F.col("swy"), F.col("sw")), F.lit(0.0))
    return sums.select(*by, mean_x.alias("mean_x"), mean_y.alias("mean_y"), corr_from_sums().alias("corr"))
