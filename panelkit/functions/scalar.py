"""Row-wise column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Fixed bucket labels.
ABS_LABELS = ("p00_p50", "p50_p90", "p90_p99", "p99_p100")
WEIGHT_LABELS = ("q00_q50", "q50_q90", "q90_q99", "q99_q100")
MISSING_LABELS = ("m00", "m01_m05", "m06_m20", "m21_plus")
WEIGHT_CLOCK_LABELS = ("w_cum_000_010", "w_cum_010_050", "w_cum_050_100", "w_cum_100_plus")


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: ColumnLike) -> Column:
    return col(c).cast("double")


def filled(c: ColumnLike) -> Column:
    """Null to 0.0 in double precision, the rule applied before every statistic."""

    return F.coalesce(dbl(c), F.lit(0.0))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def is_finite(c: ColumnLike) -> Column:
    x = dbl(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def finite_or_zero(c: ColumnLike) -> Column:
    return F.when(is_finite(c), dbl(c)).otherwise(0.0)


def number_or_zero(c: ColumnLike) -> Column:
    """Null and NaN to 0.0, infinities kept."""

    return F.coalesce(F.nanvl(dbl(c), F.lit(None).cast("double")), F.lit(0.0))


def clip(c: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(float(low)))
    if high is not None:
        c = F.least(c, F.lit(float(high)))
    return c


def clip_abs(c: ColumnLike, limit: float | None) -> Column:
    if limit is None:
        return col(c)
    if limit <= 0.0:
        raise ValueError("clip_abs must be positive")
    x = col(c)
    return F.when(x.isNull(), x).otherwise(clip(x, -limit, limit))


def sign(c: ColumnLike) -> Column:
    x = dbl(c)
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def signed_square(c: ColumnLike) -> Column:
    return dbl(c) * F.abs(dbl(c))


def signed_sqrt(c: ColumnLike) -> Column:
    return sign(c) * F.sqrt(F.abs(dbl(c)))


def signed_log1p(c: ColumnLike) -> Column:
    return sign(c) * F.log1p(F.abs(dbl(c)))


def cube(c: ColumnLike) -> Column:
    x = dbl(c)
    return x * x * x


def cyclic(c: ColumnLike, period: float) -> tuple[Column, Column]:
    angle = dbl(c) * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def labelled_bucket(c: Column, edges: Sequence[float | Column], labels: Sequence[str]) -> Column:
    """First label whose upper edge is not below the value."""

    expr = F.when(c <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1]):
        expr = expr.when(c <= edge, label)
    return expr.otherwise(labels[-1])


def quantile_bucket(c: ColumnLike, thresholds: Mapping[str, float], labels: Sequence[str] = ABS_LABELS) -> Column:
    return labelled_bucket(col(c), [thresholds["q50"], thresholds["q90"], thresholds["q99"]], labels)


def missing_count(columns: Sequence[str], *, nan_is_missing: bool = False) -> Column:
    def flag(name: str) -> Column:
        x = F.col(name)
        bad = x.isNull() | F.isnan(x.cast("double")) if nan_is_missing else x.isNull()
        return F.coalesce(bad, F.lit(True)).cast("double")

    return total([flag(c) for c in columns])


def missing_bucket(count: ColumnLike) -> Column:
    return labelled_bucket(col(count), [0, 5, 20], MISSING_LABELS)


def tercile_code(c: ColumnLike, low: float | Column, high: float | Column) -> Column:
    """0/1/2 code of two inner edges; non-finite values count as the low edge."""

    low, high = (F.lit(e) if not isinstance(e, Column) else e for e in (low, high))
    x = F.when(is_finite(c), dbl(c)).otherwise(low)
    return (x >= low).cast("long") + (x >= high).cast("long")


def int_bucket(c: ColumnLike, size: int) -> Column:
    if size <= 0:
        raise ValueError("bucket size must be positive")
    return F.floor(col(c) / F.lit(size)).cast("long")


def radix_code(parts: Sequence[tuple[Column, int]]) -> Column:
    """Mixed-radix integer code; each part is (value, cardinality)."""

    code = F.lit(0).cast("long")
    for value, cardinality in parts:
        code = code * F.lit(int(cardinality)) + value.cast("long")
    return code


def clock_bin(c: ColumnLike, thresholds: Sequence[float]) -> Column:
    """Number of thresholds the value exceeds."""

    return total([F.coalesce((dbl(c) > F.lit(t)).cast("int"), F.lit(0)) for t in thresholds])


def edge_code(c: ColumnLike, edges: Sequence[float]) -> Column:
    """Number of sorted edges not above the value."""

    return total([F.lit(0), *[(dbl(c) >= F.lit(float(e))).cast("int") for e in edges]])


def fixed_time_bin(c: ColumnLike, *, max_time_id: int, buckets: int, inclusive: bool = True) -> Column:
    size = max((max_time_id + (1 if inclusive else 0)) // buckets, 1)
    return F.least(F.greatest(int_bucket(c, size), F.lit(0)), F.lit(buckets - 1)).cast("int")


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the non-null values of a row."""

    n = total([c.isNotNull().cast("double") for c in columns])
    return F.try_divide(total([F.coalesce(c, F.lit(0.0)) for c in columns]), n)


def row_std(columns: Sequence[Column]) -> Column:
    """Population standard deviation across columns of one row."""

    mean = row_mean(columns)
    return F.sqrt(row_mean([(c - mean) * (c - mean) for c in columns]))


def row_range(columns: Sequence[Column]) -> Column:
    return F.greatest(*columns) - F.least(*columns)


def category_code(c: ColumnLike, minimum: int, maximum: int) -> Column:
    """Offset code with every unseen or null value sent to one unknown index."""

    x = col(c).cast("long")
    return F.when(x.between(minimum, maximum), x - F.lit(minimum)).otherwise(F.lit(maximum - minimum + 1))


def final_digit(c: ColumnLike, decimals: int = 6) -> Column:
    if decimals <= 0:
        raise ValueError("decimals must be positive")
    return F.pmod(F.rint(F.abs(dbl(c)) * F.lit(float(10**decimals))).cast("long"), F.lit(10)).cast("int")


def report_category(name: ColumnLike, rules: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """First category one of whose substrings occurs in the lower-cased report name."""

    text = F.lower(col(name))
    expr = None
    for label, needles in rules:
        hit = reduce(lambda a, b: a | b, [text.contains(n) for n in needles])
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return F.lit(default) if expr is None else expr.otherwise(default)


def risk_shrink(prediction: ColumnLike, risk: ColumnLike, mean_risk: float | Column, strength: float, *, root: bool) -> Column:
    """Shrink a prediction by its risk relative to the mean risk of the fitting rows."""

    mean_risk = mean_risk if isinstance(mean_risk, Column) else F.lit(float(mean_risk))
    relative = clip(F.greatest(dbl(risk), F.lit(0.0)) / F.greatest(mean_risk, F.lit(1e-12)), 0.0, 10.0)
    denominator = F.lit(1.0) + F.lit(float(strength)) * relative
    return dbl(prediction) / (F.sqrt(denominator) if root else denominator)
