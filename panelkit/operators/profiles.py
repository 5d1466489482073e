"""Panel profiles: grids, clocks, features, drift and errors. Each is one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.core import ratio, zsum
from panelkit.operators.metrics import R2, components, energy, r2
from panelkit.operators.paths import operational_time
from panelkit.schema import DATE, SYMBOL, TARGET, TIME, WEIGHT


def _behaviour(missing: Column) -> list[Column]:
    return [
        zsum(S.dbl(WEIGHT)).alias("weight_sum"),
        zsum(energy()).alias("target_energy"),
        F.avg(F.abs(S.dbl(TARGET))).alias("target_abs_mean"),
        F.avg(missing).alias("feature_null_frac"),
    ]


def missing_fraction(features: Sequence[str]) -> Column:
    return S.missing_count(features) / F.lit(float(len(features)))


def date_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Grid shape, energy and completeness of each date."""

    out = df.groupBy(DATE).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(TIME).alias("n_time_ids"),
        F.count_distinct(SYMBOL).alias("n_symbols"),
        F.min(TIME).alias("min_time_id"),
        F.max(TIME).alias("max_time_id"),
        *_behaviour(missing_fraction(features)),
    )
    out = out.withColumn("date_symbol_time_completeness", F.col("rows") / (F.col("n_time_ids") * F.col("n_symbols")))
    return out.withColumn("rows_per_time_id", F.col("rows") / F.col("n_time_ids"))


def key_profile(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """The same by time or by symbol."""

    other = {TIME: (SYMBOL, "n_symbols_seen"), SYMBOL: (TIME, "n_time_ids_seen")}
    if key not in other:
        raise ValueError("key must be the time or symbol column")
    column, name = other[key]
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(DATE).alias("n_dates"),
        F.count_distinct(column).alias(name),
        *_behaviour(missing_fraction(features)),
    )


def operational_profile(df: DataFrame, features: Sequence[str], *, max_time_id: int, buckets: int, windows: Sequence[int] = (16, 64)) -> DataFrame:
    """Rows by clock bucket, tick bucket and cumulative-weight bucket."""

    size = max(max_time_id // buckets, 1)
    timed = operational_time(df, features, windows, max_time_id)

    def bucket(c: Column) -> Column:
        return S.clip(F.floor(c / F.lit(size)).cast("double"), 0, buckets - 1).cast("int")

    keyed = timed.withColumns(
        {
            "clock_bucket": bucket(F.col(TIME)),
            "symbol_tick_bucket": bucket(F.col("ot_symbol_tick_index") - 1),
            "symbol_weight_clock_bucket": S.labelled_bucket(F.col("ot_symbol_weight_cum"), [10.0, 50.0, 100.0], S.WEIGHT_CLOCK_LABELS),
        }
    )
    return keyed.groupBy("clock_bucket", "symbol_tick_bucket", "symbol_weight_clock_bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(DATE).alias("n_dates"),
        F.count_distinct(SYMBOL).alias("n_symbols"),
        zsum(S.dbl(WEIGHT)).alias("weight_sum"),
        zsum(energy()).alias("target_energy"),
        F.avg(F.abs(S.dbl(TARGET))).alias("target_abs_mean"),
        F.avg(S.dbl("ot_missing_frac")).alias("missing_frac_mean"),
        F.avg(S.dbl("ot_source_activity")).alias("source_activity_mean"),
    )


def top_energy_times(profile: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` time steps with most target energy."""

    return profile.orderBy(F.desc("target_energy"), TIME).limit(k)


def target_behaviour(df: DataFrame, by: Sequence[str], *, date_bucket: int = 1, time_bucket: int = 1) -> DataFrame:
    """Target moments by date and time bucket, and by further columns."""

    if date_bucket <= 0 or time_bucket <= 0:
        raise ValueError("bucket sizes must be positive")
    keyed = df.withColumns({"date_bucket": S.int_bucket(DATE, date_bucket) * date_bucket, "time_bucket": S.int_bucket(TIME, time_bucket)})
    y, w = S.dbl(TARGET), S.dbl(WEIGHT)
    return keyed.groupBy("date_bucket", "time_bucket", *by).agg(
        F.count(F.lit(1)).alias("rows"),
        zsum(w).alias("weight_sum"),
        F.avg(y).alias("target_mean"),
        F.stddev_samp(y).alias("target_std"),
        F.sqrt(F.avg(y * y)).alias("target_rms"),
        ratio(zsum(w * y), zsum(w)).alias("weighted_target_mean"),
    )


def clock_quality(df: DataFrame, clocks: Mapping[str, str]) -> DataFrame:
    """How evenly each clock spreads rows and target energy over its buckets, and how stable by date.

    ``clocks`` maps a clock name to its bucket column. Rows are expanded to (clock, bucket) inside
    codegen and collapse again in the map-side aggregate by date.
    """

    entries = [F.struct(F.lit(n).alias("clock"), F.col(c).cast("long").alias("bucket")) for n, c in clocks.items()]
    long = df.select(DATE, energy().alias("e"), F.abs(S.dbl(TARGET)).alias("a"), F.explode(F.array(*entries)).alias("k"))
    daily = long.groupBy("k.clock", "k.bucket", DATE).agg(F.count(F.lit(1)).alias("rows"), zsum(F.col("e")).alias("e"), zsum(F.col("a")).alias("a"))
    bucket = daily.groupBy("clock", "bucket").agg(
        F.sum("rows").alias("rows"),
        zsum(F.col("e")).alias("energy"),
        ratio(zsum(F.col("a")), F.sum("rows")).alias("abs_mean"),
        F.when(F.avg("e") > 0, F.try_divide(F.stddev_pop("e"), F.avg("e"))).alias("date_cv"),
    )

    def cv(c: str) -> Column:
        return F.when(F.avg(c) > 0, F.try_divide(F.stddev_pop(c), F.avg(c)))

    return bucket.groupBy("clock").agg(
        F.count(F.lit(1)).alias("buckets"),
        cv("rows").alias("row_cv"),
        cv("energy").alias("energy_cv"),
        F.try_divide(F.max("energy"), F.sum("energy")).alias("energy_share_max"),
        (F.max("abs_mean") - F.min("abs_mean")).alias("target_abs_mean_spread"),
        F.avg("date_cv").alias("date_bucket_energy_cv_mean"),
    )


def unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features to rows ``(feature, value)``."""

    entries = [F.struct(F.lit(c).alias("feature"), S.dbl(c).alias("value")) for c in features]
    return df.select(*keep, F.explode(F.array(*entries)).alias("__e")).select(*keep, "__e.*")


def feature_profile(df: DataFrame, features: Sequence[str], *, approximate: bool = False) -> DataFrame:
    """Missing, unique and zero shares, mean and population deviation of each feature.

    Distinct values are counted in two steps (by feature and value, then by feature), so a feature with
    very many values is spread over tasks.
    """

    finite = unpivot(df, features).withColumn("value", F.when(S.is_finite("value"), F.col("value")))
    sums = [
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("finite_rows"),
        F.count_if(F.col("value") == 0).alias("zero_rows"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    ]
    if approximate:
        out = finite.groupBy("feature").agg(*sums, F.approx_count_distinct("value").alias("unique_count"))
    else:
        uniques = finite.where("value is not null").groupBy("feature", "value").count().groupBy("feature").agg(F.count(F.lit(1)).alias("unique_count"))
        out = finite.groupBy("feature").agg(*sums).join(uniques, "feature", "left")
    unique = F.coalesce("unique_count", F.lit(0))
    return out.select(
        "feature",
        "rows",
        (1.0 - F.col("finite_rows") / F.col("rows")).alias("missing_fraction"),
        unique.alias("unique_count"),
        (unique / F.greatest(F.col("finite_rows"), F.lit(1))).alias("unique_fraction"),
        F.coalesce(F.try_divide(F.col("zero_rows"), F.col("finite_rows")), F.lit(0.0)).alias("zero_fraction"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce("std", F.lit(0.0)).alias("std"),
    )


def drift_profile(
    df: DataFrame, features: Sequence[str], groups: Mapping[str, Column], target_group: str,
    *, means: Mapping[str, float], scales: Mapping[str, float], coefficients: Mapping[str, float],
) -> DataFrame:
    """Mean shift, null-rate and linear-contribution differences of one slice against reference slices.

    Slices may overlap: each row is tagged with every slice it belongs to and all are profiled at once.
    """

    tags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda x: x.isNotNull())
    tagged = unpivot(df.withColumn("__g", tags).where(F.size("__g") > 0), features, ["__g"])
    profile = tagged.select(F.explode("__g").alias("slice"), "feature", "value").groupBy("feature", "slice").agg(
        F.avg(F.coalesce("value", F.lit(0.0))).alias("mean"),
        F.greatest(F.coalesce(F.stddev_samp(F.coalesce("value", F.lit(0.0))), F.lit(0.0)), F.lit(1e-12)).alias("std"),
        F.avg(F.col("value").isNull().cast("double")).alias("null_rate"),
    )
    spark = df.sparkSession
    model = F.broadcast(spark.createDataFrame([(c, float(means[c]), float(scales[c]), float(coefficients[c])) for c in features], "feature string, model_mean double, model_scale double, coefficient double"))
    target = profile.where(F.col("slice") == target_group).drop("slice").withColumnsRenamed({"mean": "target_mean", "std": "target_std", "null_rate": "target_null_rate"})
    reference = profile.where(F.col("slice") != target_group).withColumnRenamed("slice", "reference")
    z = (F.col("target_mean") - F.col("model_mean")) / F.col("model_scale")
    shift = F.col("target_mean") - F.col("mean")
    return (
        target.join(model, "feature")
        .join(reference, "feature")
        .select(
            "feature", "reference", "coefficient", "target_mean", "target_std", "target_null_rate",
            z.alias("z_vs_global_train"),
            (F.col("coefficient") * z).alias("target_linear_contribution"),
            (shift / F.col("std")).alias("z_vs_reference"),
            (F.col("target_null_rate") - F.col("null_rate")).alias("null_rate_diff"),
            (F.col("coefficient") * shift / F.col("model_scale")).alias("contribution_diff"),
        )
    )


def error_summary(df: DataFrame, prediction: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Moments of target, prediction and error, worst weighted error and missingness."""

    y, p = S.dbl(TARGET), S.dbl(prediction)
    error, missing = y - p, S.missing_count(features)
    out = df.groupBy(*by).agg(
        *components(prediction),
        F.avg(y).alias("target_mean"),
        F.stddev_samp(y).alias("target_std"),
        F.avg(p).alias("prediction_mean"),
        F.stddev_samp(p).alias("prediction_std"),
        F.avg(error).alias("error_mean"),
        F.stddev_samp(error).alias("error_std"),
        F.max(S.dbl(WEIGHT) * error * error).alias("max_weighted_squared_error"),
        F.avg(missing).alias("missing_mean"),
        F.max(missing).alias("missing_max"),
    )
    return out.withColumn(R2, F.when(F.col("denominator") > 0, r2()))
