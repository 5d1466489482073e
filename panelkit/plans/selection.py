"""Candidate pools, scoreboards and tail studies on score tables (a few rows per fold and candidate)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.core import zsum
from panelkit.operators.metrics import R2, r2
from panelkit.plans.walkforward import TARGET_FOLD, calibration_copies, folds_of
from panelkit.schema import FOLD

# Fixed report categories: first match wins.
REPORT_CATEGORIES = (
    ("historical", ("hist", "max1398")),
    ("smoke", ("smoke",)),
    ("stage3", ("stage3",)),
    ("sampled", ("family_artifacts", "stride")),
)

HISTORY_METRICS = ("global_r2", "mean_fold_r2", "min_fold_r2")


def nested_select(scores: DataFrame, *, first: str, metric: str = "global_r2", min_history: int = 1, candidates: Sequence[str] = ()) -> DataFrame:
    """Per fold, the candidate with the best metric on earlier folds; ties go to the smaller id.

    Folds with less than ``min_history`` earlier folds take ``first``.
    """

    if metric not in HISTORY_METRICS:
        raise ValueError(f"unknown selection metric: {metric}")
    if min_history < 1:
        raise ValueError("min_history must be at least 1")
    pool = scores.where(F.col("candidate_id").isin(list(candidates))) if candidates else scores
    folds = folds_of(pool)
    past = calibration_copies(pool, folds).groupBy(TARGET_FOLD, "candidate_id").agg(
        F.count(F.lit(1)).alias("history_folds"),
        (1.0 - F.try_divide(F.sum("numerator"), F.sum("denominator"))).alias("global_r2"),
        F.avg(R2).alias("mean_fold_r2"),
        F.min(R2).alias("min_fold_r2"),
    )
    late = F.col(TARGET_FOLD).isin(folds[min_history:])
    usable = past.where(late & (F.col("history_folds") >= min_history)).withColumn("selection_score", F.col(metric))
    best = usable.groupBy(TARGET_FOLD).agg(F.min_by(F.struct("candidate_id", "selection_score", "history_folds"), F.struct(-F.col("selection_score"), F.col("candidate_id"))).alias("b"))
    every = pool.select(FOLD).distinct()
    chosen = every.join(best, every[FOLD] == best[TARGET_FOLD], "left").select(
        FOLD,
        F.coalesce("b.candidate_id", F.lit(first)).alias("candidate_id"),
        F.col("b.selection_score").alias("selection_score"),
        F.coalesce("b.history_folds", F.lit(0)).alias("history_folds"),
    )
    return chosen.join(pool, [FOLD, "candidate_id"], "left").withColumn("uses_current_fold_for_selection", F.lit(False))


def sort_scoreboard(board: DataFrame) -> DataFrame:
    return board.orderBy(F.desc("global_r2"), F.desc("min_fold_r2"), F.desc("mean_fold_r2"))


def filter_scoreboard(board: DataFrame, *, min_rows: int = 0, categories: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    out = board.where(F.col("rows") >= min_rows) if min_rows > 0 else board
    for column, wanted, keep in (("category", categories, True), ("report", include, True), ("report", exclude, False)):
        if wanted:
            hit = F.col(column).isin(list(wanted))
            out = out.where(hit if keep else ~hit)
    return out


def top_candidates(board: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows: a per-task heap and one merge, never a full sort."""

    if k <= 0:
        raise ValueError("top_k must be positive")
    return sort_scoreboard(board).limit(k)


def top_by_category(board: DataFrame, k: int) -> DataFrame:
    if k <= 0:
        raise ValueError("top_k must be positive")
    order = Window.partitionBy("category").orderBy(F.desc("global_r2"), F.desc("min_fold_r2"), F.desc("mean_fold_r2"))
    return board.withColumn("category_rank", F.row_number().over(order)).where(F.col("category_rank") <= k)


def top_features(screen: DataFrame, n: int) -> DataFrame:
    """First ``n`` distinct features in score order."""

    best = screen.groupBy("feature").agg(F.max_by(F.struct("valid_r2", "valid_corr"), F.struct("valid_r2", "valid_corr")).alias("b"))
    return best.select("feature", "b.valid_r2", "b.valid_corr").orderBy(F.desc("valid_r2"), F.desc("valid_corr"), "feature").limit(n)


def tail_variants_by_fold(slices: DataFrame, variants: Mapping[str, Sequence[str]], *, base: str, candidate: str, key: str = "strategy") -> DataFrame:
    """Score of switching to the candidate in the buckets of each variant, from slice numerators alone."""

    if not variants or any(not b for b in variants.values()):
        raise ValueError("tail buckets must not be empty")
    own = slices.where(F.col(key) == base)
    other = slices.where(F.col(key) == candidate).select(FOLD, "weight_bucket", F.col("numerator").alias("other"))
    both = own.join(other, [FOLD, "weight_bucket"], "left")
    entries = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(",".join(b)).alias("tail_buckets"), F.col("weight_bucket").isin(list(b)).alias("use")) for n, b in variants.items()])
    rows = both.select("*", F.explode(entries).alias("v")).select("*", "v.*")
    chosen = F.when(F.col("use"), F.coalesce("other", "numerator")).otherwise(F.col("numerator"))
    out = rows.groupBy("variant", "tail_buckets", FOLD).agg(
        F.sum("rows").alias("rows"), zsum(chosen).alias("numerator"), zsum(F.col("denominator")).alias("denominator"), zsum(rows["numerator"]).alias("base_numerator")
    )
    out = out.withColumns({R2: r2(), "base_r2": r2("base_numerator"), "numerator_improvement": F.col("base_numerator") - F.col("numerator")})
    return out.withColumn("delta_r2", F.col(R2) - F.col("base_r2")).drop("base_numerator")


def tail_variants(slices: DataFrame, variants: Mapping[str, Sequence[str]], **options) -> DataFrame:
    """Fold scores of each variant summarised."""

    return tail_variants_by_fold(slices, variants, **options).groupBy("variant", "tail_buckets").agg(
        F.count(F.lit(1)).alias("folds"),
        F.sum("rows").alias("validation_rows"),
        F.avg(R2).alias("mean_r2"),
        F.coalesce(F.stddev_samp(R2), F.lit(0.0)).alias("std_r2"),
        F.min(R2).alias("min_r2"),
        F.max(R2).alias("max_r2"),
        (1.0 - F.try_divide(F.sum("numerator"), F.sum("denominator"))).alias("global_r2"),
        F.min("delta_r2").alias("min_delta_r2"),
        F.max("delta_r2").alias("max_delta_r2"),
        F.sum("numerator_improvement").alias("numerator_improvement"),
    )
