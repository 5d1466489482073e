"""Scores, profiles, scalar functions, folds and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import EPANEL, OOF, PANEL, epanel, oof, panel, query, table
from panelkit.functions import scalar as S
from panelkit.operators import folds as fo
from panelkit.operators import metrics as M
from panelkit.operators import profiles as P
from panelkit.operators import screens, stats
from panelkit.plans import selection
from panelkit.sources import fixtures as fx
from panelkit.sources import io

KEYS = ["date_id", "time_id", "symbol_id"]
FEATURES = ["feature_00", "feature_01", "feature_02", "feature_03"]
EXPERTS = {c.removesuffix("_prediction"): c for c in fx.EXPERTS}
STRATEGIES = dict(EXPERTS)
Y, W = "responder_6", "weight"


def sq(p: str, y: str = "responder_6") -> str:
    """Weighted squared error in SQL."""
    return f"weight * ({y} - {p}) * ({y} - {p})"


def comp(p: str) -> str:
    return f"""count(*) AS "rows", sum(weight) AS weight_sum, sum({sq(p)}) AS numerator, sum(weight*responder_6*responder_6) AS denominator"""


LONG_SCORES = "scores AS (" + " UNION ALL ".join(
    f"""SELECT fold, '{n}' AS candidate, {comp(c)}, 1 - sum({sq(c)})/sum(weight*responder_6*responder_6) AS r2 FROM oof GROUP BY 1""" for n, c in EXPERTS.items()
) + ")"
SUM3 = dict(numerator=3, denominator=3)


def scores_of(spark, sf):
    return M.candidate_scores(oof(spark, sf), EXPERTS)


# --------------------------------------------------------------------------- metrics


@query("weighted_r2", f"SELECT *, 1 - numerator/denominator AS weighted_zero_mean_r2 FROM (SELECT {comp('trail_prediction')} FROM oof) --d:weight_sum numerator denominator weighted_zero_mean_r2", ctes=(PANEL, OOF), **SUM3)
def weighted_r2(spark, sf):
    """Weighted zero-mean R2 and its components."""
    return M.score_table(oof(spark, sf), "trail_prediction")


@query(
    "weighted_r2_drop",
    f"""SELECT *, 1 - numerator/denominator AS weighted_zero_mean_r2 FROM (SELECT {comp('feature_03')} FROM oof WHERE feature_03 IS NOT NULL) --d:weight_sum numerator denominator weighted_zero_mean_r2""",
    ctes=(PANEL, OOF), **SUM3,
)
def weighted_r2_drop(spark, sf):
    """The same with invalid rows dropped (a null-bearing column as prediction)."""
    return M.score_table(oof(spark, sf), "feature_03", on_invalid="drop")


FOLD_ROWS = "folds AS (SELECT 'rw_0' || CAST(k+1 AS VARCHAR) AS fold, CAST(3+10*k AS INT) AS train_start, CAST(32+10*k AS INT) AS train_end, CAST(33+10*k AS INT) AS valid_start, CAST(42+10*k AS INT) AS valid_end FROM range(5) t(k))"


@query(
    "const_baseline",
    f"""SELECT f.fold, any_value(train_start) AS train_start, any_value(train_end) AS train_end, any_value(valid_start) AS valid_start, any_value(valid_end) AS valid_end,
          30 AS train_days, 10 AS valid_days, count(DISTINCT date_id) AS valid_days_present, min(date_id) AS observed_valid_start, max(date_id) AS observed_valid_end,
          {comp('1.5e0')}, 1 - sum({sq('1.5e0')})/sum(weight*responder_6*responder_6) AS weighted_zero_mean_r2
        FROM folds f JOIN panel p ON p.date_id BETWEEN valid_start AND valid_end GROUP BY 1 --d:weight_sum numerator denominator weighted_zero_mean_r2""",
    ctes=(PANEL, FOLD_ROWS), **SUM3,
)
def const_baseline(spark, sf):
    """Constant prediction per validation fold."""
    return M.constant_baseline(panel(spark, sf), fo.rolling_folds(0, 82, n_folds=5, train_window=30, valid_window=10), 1.5)


@query("fold_score", f"""SELECT fold, {comp('base_prediction')}, 1 - sum({sq('base_prediction')})/sum(weight*responder_6*responder_6) AS weighted_zero_mean_r2 FROM oof GROUP BY 1 --d:weight_sum numerator denominator weighted_zero_mean_r2""", ctes=(PANEL, OOF), **SUM3)
def fold_score(spark, sf):
    """Components per fold."""
    return M.fold_scores(oof(spark, sf), "base_prediction")


@query(
    "fold_summary",
    """SELECT candidate, count(*) AS folds, CAST(sum("rows") AS BIGINT) AS "rows", sum(weight_sum) AS weight_sum, sum(numerator) AS numerator, sum(denominator) AS denominator, avg(r2) AS mean_fold_r2,
         stddev_samp(r2) AS std_fold_r2, min(r2) AS min_fold_r2, max(r2) AS max_fold_r2, 1 - sum(numerator)/sum(denominator) AS global_r2
       FROM scores GROUP BY 1 --d:weight_sum numerator denominator mean_fold_r2 std_fold_r2 min_fold_r2 max_fold_r2 global_r2""",
    ctes=(PANEL, OOF, LONG_SCORES), **SUM3,
)
def fold_summary(spark, sf):
    """One row per candidate over folds."""
    return M.summarize(scores_of(spark, sf), ["candidate"])


@query(
    "score_stats",
    f"""SELECT fold, {comp('trail_prediction')}, avg(trail_prediction) AS prediction_mean, stddev_samp(trail_prediction) AS prediction_std,
          1 - sum({sq('trail_prediction')})/sum(weight*responder_6*responder_6) AS weighted_zero_mean_r2 FROM oof GROUP BY 1
        --d:weight_sum numerator denominator prediction_mean prediction_std weighted_zero_mean_r2""",
    ctes=(PANEL, OOF), **SUM3,
)
def score_stats(spark, sf):
    """Scores with prediction moments."""
    return M.score_stats(oof(spark, sf), "trail_prediction", ["fold"])


@query(
    "slice_r2",
    f"""SELECT symbol_id, time_id, {comp('trail_prediction')}, avg(responder_6) AS target_mean, avg(trail_prediction) AS prediction_mean,
          1 - sum({sq('trail_prediction')})/nullif(sum(weight*responder_6*responder_6), 0) AS weighted_zero_mean_r2 FROM oof GROUP BY 1, 2
        --d:weight_sum numerator denominator target_mean prediction_mean weighted_zero_mean_r2""",
    ctes=(PANEL, OOF), numerator=4, denominator=4,
)
def slice_r2(spark, sf):
    """Components by symbol and time."""
    return M.slice_scores(oof(spark, sf), ["symbol_id", "time_id"], prediction="trail_prediction")


@query("slice_combine", f"""SELECT symbol_id, {comp('trail_prediction')}, 1 - sum({sq('trail_prediction')})/sum(weight*responder_6*responder_6) AS weighted_zero_mean_r2 FROM oof GROUP BY 1 --d:weight_sum numerator denominator weighted_zero_mean_r2""", ctes=(PANEL, OOF), numerator=4, denominator=4)
def slice_combine(spark, sf):
    """Partial slice scores merged by sums."""
    df = oof(spark, sf)
    parts = [M.slice_scores(df.where(c), "symbol_id", prediction="trail_prediction") for c in ("date_id < 50", "date_id >= 50")]
    return M.combine_slices(parts, "symbol_id")


@query(
    "slice_pair_delta",
    f"""SELECT symbol_id, count(*) AS "rows", sum(weight) AS weight_sum, sum(weight*responder_6*responder_6) AS denominator, sum({sq('base_prediction')}) AS baseline_numerator, sum({sq('trail_prediction')}) AS candidate_numerator,
          1 - sum({sq('base_prediction')})/sum(weight*responder_6*responder_6) AS baseline_r2, 1 - sum({sq('trail_prediction')})/sum(weight*responder_6*responder_6) AS candidate_r2,
          sum({sq('base_prediction')}) - sum({sq('trail_prediction')}) AS numerator_improvement, (sum({sq('base_prediction')}) - sum({sq('trail_prediction')}))/sum(weight*responder_6*responder_6) AS delta_r2
        FROM oof GROUP BY 1 --d:weight_sum denominator baseline_numerator candidate_numerator baseline_r2 candidate_r2 numerator_improvement delta_r2""",
    ctes=(PANEL, OOF), denominator=4, baseline_numerator=4, candidate_numerator=4, numerator_improvement=4,
)
def slice_pair_delta(spark, sf):
    """Candidate against baseline by symbol."""
    return M.pair_delta(oof(spark, sf), ["symbol_id"], baseline="base_prediction", candidate="trail_prediction")


@query(
    "multi_strategy_slices",
    " UNION ALL ".join(f"""SELECT '{n}' AS candidate, time_id, {comp(c)}, 1 - sum({sq(c)})/sum(weight*responder_6*responder_6) AS weighted_zero_mean_r2 FROM oof GROUP BY 2""" for n, c in EXPERTS.items())
    + " --d:weight_sum numerator denominator weighted_zero_mean_r2",
    ctes=(PANEL, OOF), **SUM3,
)
def multi_strategy_slices(spark, sf):
    """Every strategy by time slice in one pass."""
    return M.candidate_scores(oof(spark, sf), EXPERTS, by=["time_id"])


@query(
    "subset_summary",
    """SELECT subset, candidate, count(*) AS folds, CAST(sum("rows") AS BIGINT) AS "rows", 1 - sum(numerator)/sum(denominator) AS global_r2, min(r2) AS min_fold_r2 FROM scores JOIN (
         SELECT 'full' AS subset, 'rw_0' || CAST(k AS VARCHAR) AS fold FROM range(1, 6) t(k) UNION ALL SELECT 'early_rw_01_rw_03', 'rw_0' || CAST(k AS VARCHAR) FROM range(1, 4) t(k)
         UNION ALL SELECT 'late_rw_04_rw_05', 'rw_0' || CAST(k AS VARCHAR) FROM range(4, 6) t(k) UNION ALL SELECT 'last_rw_05', 'rw_05') s USING (fold) GROUP BY 1, 2 --d:global_r2 min_fold_r2""",
    ctes=(PANEL, OOF, LONG_SCORES),
)
def subset_summary(spark, sf):
    """Candidates over named fold subsets."""
    subsets = M.default_subsets([f"rw_0{k}" for k in range(1, 6)])
    return M.subset_summary(scores_of(spark, sf), subsets).select("subset", "candidate", "folds", "rows", "global_r2", "min_fold_r2")


@query("weighted_scale", "SELECT symbol_id, (sum(weight*trail_prediction*responder_6) + 5e0)/(sum(weight*trail_prediction*trail_prediction) + 5e0) AS scale FROM oof GROUP BY 1 --d:scale", ctes=(PANEL, OOF))
def weighted_scale(spark, sf):
    """Least-squares multiplier with a prior."""
    return stats.weighted_scale(oof(spark, sf), "trail_prediction", ["symbol_id"], prior=5.0)


@query(
    "gram",
    "SELECT fold, " + ", ".join(f"sum(weight*{a}*{b}) AS g_{i}_{j}" for i, a in enumerate(fx.EXPERTS) for j, b in enumerate(fx.EXPERTS) if j >= i) + ", "
    + ", ".join(f"sum(weight*{a}*responder_6) AS r_{i}" for i, a in enumerate(fx.EXPERTS)) + """, sum(weight*responder_6*responder_6) AS yy, sum(weight) AS weight_sum, count(*) AS "rows" FROM oof GROUP BY 1
    --d:g_0_0 g_0_1 g_0_2 g_1_1 g_1_2 g_2_2 r_0 r_1 r_2 yy weight_sum""",
    ctes=(PANEL, OOF), digits=3,
)
def gram(spark, sf):
    """Weighted Gram matrix per fold."""
    return stats.gram(oof(spark, sf), list(fx.EXPERTS), ["fold"])


@query(
    "feature_moments",
    "SELECT " + ", ".join(f"avg(coalesce({c},0e0)) AS mean_{c}, CASE WHEN stddev_pop(coalesce({c},0e0)) > 1e-12 THEN stddev_pop(coalesce({c},0e0)) ELSE 1e0 END AS scale_{c}" for c in FEATURES)
    + " FROM panel --d:" + " ".join(f"mean_{c} scale_{c}" for c in FEATURES),
    ctes=(PANEL,),
)
def feature_moments(spark, sf):
    """Mean and population deviation after null -> 0."""
    return stats.moments(panel(spark, sf), FEATURES)


@query(
    "weighted_mean_corr",
    """SELECT symbol_id, sum(weight*feature_03)/sum(weight) AS mean_x, sum(weight*responder_6)/sum(weight) AS mean_y,
         coalesce((sum(weight*feature_03*responder_6) - sum(weight*feature_03)*sum(weight*responder_6)/sum(weight)) / sqrt((sum(weight*feature_03*feature_03) - sum(weight*feature_03)*sum(weight*feature_03)/sum(weight))
           * (sum(weight*responder_6*responder_6) - sum(weight*responder_6)*sum(weight*responder_6)/sum(weight))), 0e0) AS corr
       FROM panel WHERE feature_03 IS NOT NULL GROUP BY 1 --d:mean_x mean_y corr""",
    ctes=(PANEL,),
)
def weighted_mean_corr(spark, sf):
    """Weighted means and correlation by symbol."""
    return stats.weighted_corr(panel(spark, sf), "feature_03", by=["symbol_id"])


@query(
    "tail_spread",
    """SELECT sum(CASE WHEN feature_00 <= lo THEN weight*responder_6 END)/sum(CASE WHEN feature_00 <= lo THEN weight END) AS tail_low_mean,
         sum(CASE WHEN feature_00 >= hi THEN weight*responder_6 END)/sum(CASE WHEN feature_00 >= hi THEN weight END) AS tail_high_mean,
         sum(CASE WHEN feature_00 >= hi THEN weight*responder_6 END)/sum(CASE WHEN feature_00 >= hi THEN weight END) - sum(CASE WHEN feature_00 <= lo THEN weight*responder_6 END)/sum(CASE WHEN feature_00 <= lo THEN weight END) AS tail_spread
       FROM panel, (SELECT quantile_cont(feature_00, 0.05) AS lo, quantile_cont(feature_00, 0.95) AS hi FROM panel) --d:tail_low_mean tail_high_mean tail_spread""",
    ctes=(PANEL,),
)
def tail_spread(spark, sf):
    """Weighted target means in the tails of a feature."""
    return screens.tail_spread(panel(spark, sf), "feature_00")


@query(
    "feature_profile",
    " UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) AS "rows", 1 - count({c})/CAST(count(*) AS DOUBLE) AS missing_fraction, count(DISTINCT {c}) AS unique_count, count(DISTINCT {c})/CAST(greatest(count({c}),1) AS DOUBLE) AS unique_fraction,
       count(CASE WHEN {c}=0 THEN 1 END)/CAST(count({c}) AS DOUBLE) AS zero_fraction, avg({c}) AS mean, stddev_pop({c}) AS std FROM panel""" for c in FEATURES)
    + " --d:missing_fraction unique_fraction zero_fraction mean std",
    ctes=(PANEL,),
)
def feature_profile(spark, sf):
    """Missing, unique and zero shares and moments per feature."""
    return P.feature_profile(panel(spark, sf), FEATURES)


def _drift_sql() -> str:
    prof = {"target": "symbol_id = 7 AND date_id >= 60", "same_symbol": "symbol_id = 7 AND date_id < 60", "recent": "date_id BETWEEN 50 AND 59"}
    parts = []
    for c, (m, s, b) in DRIFT_MODEL.items():
        t = f"(SELECT avg(coalesce({c},0e0)) AS m, stddev_samp(coalesce({c},0e0)) AS s, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS n FROM panel WHERE {prof['target']})"
        for r in ("same_symbol", "recent"):
            q = f"(SELECT avg(coalesce({c},0e0)) AS m, stddev_samp(coalesce({c},0e0)) AS s, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) AS n FROM panel WHERE {prof[r]})"
            parts.append(
                f"SELECT '{c}' AS feature, '{r}' AS reference, {b}e0 AS coefficient, t.m AS target_mean, t.s AS target_std, t.n AS target_null_rate, (t.m-{m}e0)/{s}e0 AS z_vs_global_train, {b}e0*(t.m-{m}e0)/{s}e0 AS target_linear_contribution,"
                f" (t.m-q.m)/q.s AS z_vs_reference, t.n-q.n AS null_rate_diff, {b}e0*(t.m-q.m)/{s}e0 AS contribution_diff FROM {t} t, {q} q"
            )
    return " UNION ALL ".join(parts) + " --d:coefficient target_mean target_std target_null_rate z_vs_global_train target_linear_contribution z_vs_reference null_rate_diff contribution_diff"


DRIFT_MODEL = {"feature_00": (4.0, 2.0, 0.5), "feature_03": (20.0, 10.0, -0.25)}


@query("drift_profile", _drift_sql(), ctes=(PANEL,))
def drift_profile(spark, sf):
    """One slice against two reference slices."""
    groups = {"target": F.expr("symbol_id = 7 AND date_id >= 60"), "same_symbol": F.expr("symbol_id = 7 AND date_id < 60"), "recent": F.expr("date_id BETWEEN 50 AND 59")}
    m, s, b = ({c: v[i] for c, v in DRIFT_MODEL.items()} for i in range(3))
    return P.drift_profile(panel(spark, sf), list(DRIFT_MODEL), groups, "target", means=m, scales=s, coefficients=b)


@query(
    "error_summary",
    f"""SELECT fold, {comp('trail_prediction')}, avg(responder_6) AS target_mean, stddev_samp(responder_6) AS target_std, avg(trail_prediction) AS prediction_mean, stddev_samp(trail_prediction) AS prediction_std,
          avg(responder_6-trail_prediction) AS error_mean, stddev_samp(responder_6-trail_prediction) AS error_std, max({sq('trail_prediction')}) AS max_weighted_squared_error,
          avg(CASE WHEN feature_03 IS NULL THEN 1e0 ELSE 0e0 END) AS missing_mean, max(CASE WHEN feature_03 IS NULL THEN 1e0 ELSE 0e0 END) AS missing_max,
          1 - sum({sq('trail_prediction')})/sum(weight*responder_6*responder_6) AS weighted_zero_mean_r2 FROM oof GROUP BY 1
        --d:weight_sum numerator denominator target_mean target_std prediction_mean prediction_std error_mean error_std max_weighted_squared_error missing_mean missing_max weighted_zero_mean_r2""",
    ctes=(PANEL, OOF), **SUM3,
)
def error_summary(spark, sf):
    """Error moments per fold."""
    return P.error_summary(oof(spark, sf), "trail_prediction", FEATURES, ["fold"])


NULLS = "(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END" for c in FEATURES) + ") / 4e0"
BEHAVIOUR = f"sum(weight) AS weight_sum, sum(weight*responder_6*responder_6) AS target_energy, avg(abs(responder_6)) AS target_abs_mean, avg({NULLS}) AS feature_null_frac"
BD = "weight_sum target_energy target_abs_mean feature_null_frac"


@query(
    "date_profile",
    f"""SELECT date_id, count(*) AS "rows", count(DISTINCT time_id) AS n_time_ids, count(DISTINCT symbol_id) AS n_symbols, min(time_id) AS min_time_id, max(time_id) AS max_time_id, {BEHAVIOUR},
          count(*)/CAST(count(DISTINCT time_id)*count(DISTINCT symbol_id) AS DOUBLE) AS date_symbol_time_completeness, count(*)/CAST(count(DISTINCT time_id) AS DOUBLE) AS rows_per_time_id
        FROM panel GROUP BY 1 --d:{BD} date_symbol_time_completeness rows_per_time_id""",
    ctes=(PANEL,), target_energy=3,
)
def date_profile(spark, sf):
    """Grid of each date."""
    return P.date_profile(panel(spark, sf), FEATURES)


@query("time_profile", f"""SELECT time_id, count(*) AS "rows", count(DISTINCT date_id) AS n_dates, count(DISTINCT symbol_id) AS n_symbols_seen, {BEHAVIOUR} FROM panel GROUP BY 1 --d:{BD}""", ctes=(PANEL,), target_energy=3)
def time_profile(spark, sf):
    """Profile by time."""
    return P.key_profile(panel(spark, sf), "time_id", FEATURES)


@query("symbol_profile", f"""SELECT symbol_id, count(*) AS "rows", count(DISTINCT date_id) AS n_dates, count(DISTINCT time_id) AS n_time_ids_seen, {BEHAVIOUR} FROM panel GROUP BY 1 --d:{BD}""", ctes=(PANEL,), target_energy=3)
def symbol_profile(spark, sf):
    """Profile by symbol."""
    return P.key_profile(panel(spark, sf), "symbol_id", FEATURES)


@query(
    "operational_profile",
    """SELECT CAST(least(greatest(floor(time_id/900), 0), 15) AS INT) AS clock_bucket, CAST(least(greatest(floor((tick-1)/900), 0), 15) AS INT) AS symbol_tick_bucket,
         CASE WHEN wcum <= 10 THEN 'w_cum_000_010' WHEN wcum <= 50 THEN 'w_cum_010_050' WHEN wcum <= 100 THEN 'w_cum_050_100' ELSE 'w_cum_100_plus' END AS symbol_weight_clock_bucket,
         count(*) AS "rows", count(DISTINCT date_id) AS n_dates, count(DISTINCT symbol_id) AS n_symbols, sum(weight) AS weight_sum, sum(weight*responder_6*responder_6) AS target_energy,
         avg(abs(responder_6)) AS target_abs_mean, avg(CASE WHEN feature_01 IS NULL THEN 0.5e0 ELSE 0e0 END) AS missing_frac_mean, avg((abs(feature_00) + abs(coalesce(feature_01, 0e0)))/2e0) AS source_activity_mean
       FROM (SELECT *, count(*) OVER w AS tick, sum(weight) OVER w AS wcum FROM epanel WINDOW w AS (PARTITION BY date_id, symbol_id ORDER BY time_id)) GROUP BY 1, 2, 3
       --d:weight_sum target_energy target_abs_mean missing_frac_mean source_activity_mean""",
    ctes=(EPANEL,), digits=5,
)
def operational_profile(spark, sf):
    """Rows by clock, tick and cumulative-weight buckets."""
    return P.operational_profile(epanel(spark, sf), ["feature_00", "feature_01"], max_time_id=14400, buckets=16)


@query(
    "target_behaviour",
    """SELECT CAST(floor(date_id/10)*10 AS BIGINT) AS date_bucket, CAST(floor(time_id/2) AS BIGINT) AS time_bucket, symbol_id, count(*) AS "rows", sum(weight) AS weight_sum, avg(responder_6) AS target_mean, stddev_samp(responder_6) AS target_std,
         sqrt(avg(responder_6*responder_6)) AS target_rms, sum(weight*responder_6)/sum(weight) AS weighted_target_mean FROM panel GROUP BY 1, 2, 3 --d:weight_sum target_mean target_std target_rms weighted_target_mean""",
    ctes=(PANEL,),
)
def target_behaviour(spark, sf):
    """Target moments by date, time and symbol buckets."""
    return P.target_behaviour(panel(spark, sf), ["symbol_id"], date_bucket=10, time_bucket=2)


CLOCK_PARTS = {"clock_time": "time_id", "weight_level": "CAST(floor(weight/20) AS BIGINT)", "symbol_group": "symbol_id % 5"}


@query(
    "clock_quality",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS clock, count(*) AS buckets, stddev_pop(r)/avg(r) AS row_cv, stddev_pop(e)/avg(e) AS energy_cv, max(e)/sum(e) AS energy_share_max, max(a)-min(a) AS target_abs_mean_spread, avg(d) AS date_bucket_energy_cv_mean FROM (
              SELECT b, sum(r) AS r, sum(e) AS e, sum(a)/sum(r) AS a, stddev_pop(e)/avg(e) AS d FROM (SELECT date_id, {x} AS b, CAST(count(*) AS DOUBLE) AS r, sum(weight*responder_6*responder_6) AS e, sum(abs(responder_6)) AS a FROM panel GROUP BY 1, 2) GROUP BY 1)"""
        for n, x in CLOCK_PARTS.items()
    ) + " --d:row_cv energy_cv energy_share_max target_abs_mean_spread date_bucket_energy_cv_mean",
    ctes=(PANEL,),
)
def clock_quality(spark, sf):
    """Evenness of three clocks."""
    df = panel(spark, sf).withColumns({"__w": F.floor(F.col("weight") / 20), "__s": F.col("symbol_id") % 5})
    return P.clock_quality(df, {"clock_time": "time_id", "weight_level": "__w", "symbol_group": "__s"})


@query(
    "choice_counts",
    """SELECT fold, CASE WHEN abs(responder_6-base_prediction) <= abs(responder_6-trail_prediction) THEN 'base' ELSE 'trail' END AS selected_strategy, count(*) AS "rows", sum(weight) AS weight_sum FROM oof GROUP BY 1, 2 --d:weight_sum""",
    ctes=(PANEL, OOF),
)
def choice_counts(spark, sf):
    """Rows and weight per chosen strategy."""
    nearer = F.abs(F.col(Y) - F.col("base_prediction")) <= F.abs(F.col(Y) - F.col("trail_prediction"))
    return M.choice_counts(oof(spark, sf).withColumn("choice", F.when(nearer, "base").otherwise("trail")), "choice")


# --------------------------------------------------------------------------- scalar functions


@query("clip_abs", "SELECT date_id, time_id, symbol_id, least(greatest(responder_6, -2e0), 2e0) AS clipped FROM panel --d:clipped", ctes=(PANEL,))
def clip_abs(spark, sf):
    """Symmetric clip."""
    return panel(spark, sf).select(*KEYS, S.clip_abs("responder_6", 2.0).alias("clipped"))


@query(
    "signed_power",
    """SELECT date_id, time_id, symbol_id, x*abs(x) AS signed_square, sign(x)*sqrt(abs(x)) AS signed_sqrt, sign(x)*ln(1e0+abs(x)) AS signed_log1p, x*x*x AS cube, CAST(sign(x) AS DOUBLE) AS sgn FROM (SELECT *, responder_6 AS x FROM panel)
       --d:signed_square signed_sqrt signed_log1p cube sgn""",
    ctes=(PANEL,),
)
def signed_power(spark, sf):
    """Signed square, root, logarithm, cube and sign."""
    exprs = {"signed_square": S.signed_square, "signed_sqrt": S.signed_sqrt, "signed_log1p": S.signed_log1p, "cube": S.cube, "sgn": S.sign}
    return panel(spark, sf).select(*KEYS, *[f("responder_6").alias(n) for n, f in exprs.items()])


@query(
    "cyclic_time",
    "SELECT date_id, time_id, symbol_id, sin(time_id*2*pi()/967) AS s967, cos(time_id*2*pi()/967) AS c967, sin(time_id*2*pi()/483) AS s483, cos(time_id*2*pi()/483) AS c483, sin(date_id*2*pi()/20) AS s20, cos(date_id*2*pi()/20) AS c20 FROM epanel --d:s967 c967 s483 c483 s20 c20",
    ctes=(EPANEL,),
)
def cyclic_time(spark, sf):
    """Sine and cosine clocks."""
    cols = []
    for source, period in (("time_id", 967), ("time_id", 483), ("date_id", 20)):
        s, c = S.cyclic(source, period)
        cols += [s.alias(f"s{period}"), c.alias(f"c{period}")]
    return epanel(spark, sf).select(*KEYS, *cols)


def nearest(expr: str, q: float, source: str = "panel") -> str:
    """Nearest-rank quantile in SQL."""
    return f"(SELECT list_sort(list({expr}))[CAST(floor({q}e0 * (count({expr})-1) + 0.5e0) AS BIGINT) + 1] FROM {source})"


@query(
    "quantile_bucket4",
    f"""SELECT date_id, time_id, symbol_id, CASE WHEN weight <= {nearest('weight', 0.5)} THEN 'q00_q50' WHEN weight <= {nearest('weight', 0.9)} THEN 'q50_q90' WHEN weight <= {nearest('weight', 0.99)} THEN 'q90_q99' ELSE 'q99_q100' END AS weight_bucket,
          CASE WHEN a <= {nearest('abs(responder_6)', 0.5)} THEN 'p00_p50' WHEN a <= {nearest('abs(responder_6)', 0.9)} THEN 'p50_p90' WHEN a <= {nearest('abs(responder_6)', 0.99)} THEN 'p90_p99' ELSE 'p99_p100' END AS abs_bucket
        FROM (SELECT *, abs(responder_6) AS a FROM panel)""",
    ctes=(PANEL,),
)
def quantile_bucket4(spark, sf):
    """Four-way labels by weight and magnitude quantiles."""
    from panelkit.operators.calibrate import abs_thresholds, weight_thresholds

    df = panel(spark, sf)
    return df.select(
        *KEYS,
        S.quantile_bucket("weight", weight_thresholds(df), S.WEIGHT_LABELS).alias("weight_bucket"),
        S.quantile_bucket(F.abs("responder_6"), abs_thresholds(df, ["responder_6"])["responder_6"]).alias("abs_bucket"),
    )


@query(
    "missing_bucket",
    "SELECT CASE WHEN n = 0 THEN 'm00' WHEN n <= 5 THEN 'm01_m05' WHEN n <= 20 THEN 'm06_m20' ELSE 'm21_plus' END AS bucket, count(*) AS k FROM (SELECT date_id, symbol_id, sum(CASE WHEN feature_03 IS NULL THEN 1 ELSE 0 END) * 3 AS n FROM panel GROUP BY 1, 2) GROUP BY 1",
    ctes=(PANEL,),
)
def missing_bucket(spark, sf):
    """Missing-count labels."""
    counted = panel(spark, sf).groupBy("date_id", "symbol_id").agg((F.count_if(F.col("feature_03").isNull()) * 3).alias("n"))
    return counted.groupBy(S.missing_bucket("n").alias("bucket")).agg(F.count(F.lit(1)).alias("k"))


TERCILES = "t AS (SELECT quantile_cont(weight, 1e0/3) AS wl, quantile_cont(weight, 2e0/3) AS wh, quantile_cont(abs(base_prediction), 1e0/3) AS al, quantile_cont(abs(base_prediction), 2e0/3) AS ah, quantile_cont(abs(base_prediction-trail_prediction), 1e0/3) AS dl, quantile_cont(abs(base_prediction-trail_prediction), 2e0/3) AS dh FROM oof)"


def terciles(spark, sf):
    from panelkit.operators.core import exact_quantiles, tercile_edges

    df = oof(spark, sf)
    values = {"w": F.col("weight"), "a": F.abs("base_prediction"), "d": F.abs(F.col("base_prediction") - F.col("trail_prediction"))}
    found = exact_quantiles(df, values, [0.0, 1 / 3, 2 / 3, 1.0])[0]
    edges = {n: tercile_edges(q[1:3], q[0], q[3]) for n, q in found.items()}
    return df, {n: S.tercile_code(values[n], *edges[n]) for n in values}


@query("tercile_code", "SELECT date_id, time_id, symbol_id, CAST(CASE WHEN weight >= wl THEN 1 ELSE 0 END + CASE WHEN weight >= wh THEN 1 ELSE 0 END AS BIGINT) AS code FROM oof, t", ctes=(PANEL, OOF, TERCILES))
def tercile_code(spark, sf):
    """Code of two inner edges."""
    df, codes = terciles(spark, sf)
    return df.select(*KEYS, codes["w"].alias("code"))


@query(
    "regime_code",
    """SELECT date_id, time_id, symbol_id, CAST(floor(time_id/2)*27 + 9*(CASE WHEN weight >= wl THEN 1 ELSE 0 END + CASE WHEN weight >= wh THEN 1 ELSE 0 END) + 3*(CASE WHEN a >= al THEN 1 ELSE 0 END + CASE WHEN a >= ah THEN 1 ELSE 0 END)
         + CASE WHEN d >= dl THEN 1 ELSE 0 END + CASE WHEN d >= dh THEN 1 ELSE 0 END AS BIGINT) AS code FROM (SELECT *, abs(base_prediction) AS a, abs(base_prediction-trail_prediction) AS d FROM oof), t""",
    ctes=(PANEL, OOF, TERCILES),
)
def regime_code(spark, sf):
    """Mixed-radix regime code."""
    df, codes = terciles(spark, sf)
    return df.select(*KEYS, S.radix_code([(S.int_bucket("time_id", 2), 4), (codes["w"], 3), (codes["a"], 3), (codes["d"], 3)]).alias("code"))


@query(
    "context_code",
    """SELECT CAST(floor(time_id/3) AS BIGINT) AS time_bucket, CAST(CASE WHEN weight >= wl THEN 1 ELSE 0 END + CASE WHEN weight >= wh THEN 1 ELSE 0 END AS BIGINT) AS weight_code,
         CAST((base_prediction >= 0) = (trail_prediction >= 0) AS INT) AS sign_agree, count(*) AS n FROM oof, t GROUP BY 1, 2, 3""",
    ctes=(PANEL, OOF, TERCILES),
)
def context_code(spark, sf):
    """Context as plain group columns."""
    df, codes = terciles(spark, sf)
    agree = ((F.col("base_prediction") >= 0) == (F.col("trail_prediction") >= 0)).cast("int")
    return df.groupBy(S.int_bucket("time_id", 3).alias("time_bucket"), codes["w"].alias("weight_code"), agree.alias("sign_agree")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "clock_bin_apply",
    "SELECT date_id, time_id, symbol_id, CAST(least(greatest(floor(time_id/2), 0), 3) AS INT) AS fixed_bin, CAST(CASE WHEN weight > 20 THEN 1 ELSE 0 END + CASE WHEN weight > 40 THEN 1 ELSE 0 END + CASE WHEN weight > 60 THEN 1 ELSE 0 END AS INT) AS weight_bin FROM panel",
    ctes=(PANEL,),
)
def clock_bin_apply(spark, sf):
    """Fixed-time and threshold bins."""
    return panel(spark, sf).select(*KEYS, S.fixed_time_bin("time_id", max_time_id=7, buckets=4).alias("fixed_bin"), S.clock_bin("weight", [20, 40, 60]).alias("weight_bin"))


@query(
    "row_reduce",
    """SELECT date_id, time_id, symbol_id, (a+b+c)/3e0 AS row_mean, greatest(a,b,c)-least(a,b,c) AS row_range, sqrt((pow(a-(a+b+c)/3e0,2)+pow(b-(a+b+c)/3e0,2)+pow(c-(a+b+c)/3e0,2))/3e0) AS row_std
       FROM (SELECT *, base_prediction AS a, trail_prediction AS b, linear_prediction AS c FROM oof) --d:row_mean row_range row_std""",
    ctes=(PANEL, OOF),
)
def row_reduce(spark, sf):
    """Mean, range and deviation across experts."""
    cols = [F.col(c) for c in fx.EXPERTS]
    return oof(spark, sf).select(*KEYS, S.row_mean(cols).alias("row_mean"), S.row_range(cols).alias("row_range"), S.row_std(cols).alias("row_std"))


@query("category_encode", "SELECT date_id, time_id, symbol_id, CASE WHEN symbol_id BETWEEN 10 AND 60 THEN CAST(symbol_id-10 AS BIGINT) ELSE CAST(51 AS BIGINT) END AS code FROM panel", ctes=(PANEL,))
def category_encode(spark, sf):
    """Offset code with an unknown index."""
    return panel(spark, sf).select(*KEYS, S.category_code("symbol_id", 10, 60).alias("code"))


@query(
    "stacker_columns",
    """SELECT date_id, time_id, symbol_id, base_prediction-trail_prediction AS gap, abs(linear_prediction) AS ensemble_abs, abs(base_prediction-trail_prediction) AS abs_gap,
         CASE WHEN weight <= 25 THEN 0 WHEN weight <= 50 THEN 1 WHEN weight <= 75 THEN 2 ELSE 3 END AS weight_bucket_code FROM oof --d:gap ensemble_abs abs_gap""",
    ctes=(PANEL, OOF),
)
def stacker_columns(spark, sf):
    """Expert gaps and bucket codes for a stacker."""
    from panelkit.plans.experts import stacker_columns as build

    df = oof(spark, sf).withColumn("weight_bucket", S.quantile_bucket("weight", {"q50": 25, "q90": 50, "q99": 75}, S.WEIGHT_LABELS))
    out = build(df, "base_prediction", "trail_prediction", "linear_prediction")
    return out.select(*KEYS, "gap", "ensemble_abs", "abs_gap", "weight_bucket_code")


@query("final_digit", "SELECT CAST(CAST(round(abs(l_extendedprice)*100) AS BIGINT) % 10 AS INT) AS digit, count(*) AS n FROM lineitem GROUP BY 1")
def final_digit(spark, sf):
    """Last cent digit of prices."""
    return table(spark, sf, "lineitem").groupBy(S.final_digit("l_extendedprice", 2).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- folds


def fold_count_sql(rows: str) -> str:
    return f"SELECT fold, count(*) AS n, min(date_id) AS lo, max(date_id) AS hi FROM panel JOIN ({rows}) f ON date_id BETWEEN s AND e GROUP BY 1"


def count_folds(df, folds, part="valid"):
    return fo.assign_folds(df, folds, part).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("date_id").alias("lo"), F.max("date_id").alias("hi"))


@query("expanding_folds", fold_count_sql("SELECT 'wf_0' || CAST(k+1 AS VARCHAR) AS fold, 0 AS s, 43+10*k-3 AS e FROM range(4) t(k)"), ctes=(PANEL,))
def expanding_folds(spark, sf):
    """Training rows of expanding folds with a gap."""
    return count_folds(panel(spark, sf), fo.expanding_folds(0, 82, n_folds=4, valid_window=10, gap=2), "train")


@query("rolling_folds", fold_count_sql("SELECT 'rw_0' || CAST(k+1 AS VARCHAR) AS fold, 33+10*k AS s, 42+10*k AS e FROM range(5) t(k)"), ctes=(PANEL,))
def rolling_folds(spark, sf):
    """Validation rows of rolling folds."""
    return count_folds(panel(spark, sf), fo.rolling_folds(0, 82, n_folds=5, train_window=30, valid_window=10))


@query("tail_folds", fold_count_sql("SELECT 'otf_0' || CAST(k+1 AS VARCHAR) AS fold, 53+10*k-1-8 AS s, 53+10*k-1-1 AS e FROM range(3) t(k)"), ctes=(PANEL,))
def tail_folds(spark, sf):
    """Selection rows of train / selection / validation folds."""
    return count_folds(panel(spark, sf), fo.tail_folds(0, 82, n_folds=3, train_window=20, selection_window=8, valid_window=10, gap=1), "selection")


@query("inner_oof_folds", fold_count_sql("SELECT 'rw_05_oof_0' || CAST(k+1 AS VARCHAR) AS fold, 43+10*k AS s, 52+10*k AS e FROM range(3) t(k)"), ctes=(PANEL,))
def inner_oof_folds(spark, sf):
    """Inner folds at the end of the last training range."""
    outer = fo.rolling_folds(0, 82, n_folds=5, train_window=50, valid_window=5, gap=0)[-1]
    outer = fo.Fold("rw_05", 23, 72, outer.valid_start, outer.valid_end)
    return count_folds(panel(spark, sf), fo.inner_folds(outer, n_folds=3, valid_window=10))


@query("temporal_split", "SELECT d AS first_valid_date, count(*) AS valid_rows FROM panel, (SELECT list_sort(list(DISTINCT date_id))[CAST(floor(count(DISTINCT date_id)*0.75e0) AS BIGINT)+1] AS d FROM panel) WHERE date_id >= d GROUP BY 1", ctes=(PANEL,))
def temporal_split(spark, sf):
    """First validation date of the last quarter of the dates."""
    df = panel(spark, sf)
    first = fo.split_date(df, 0.25)
    return df.where(F.col("date_id") >= first).groupBy(F.lit(first).alias("first_valid_date")).agg(F.count(F.lit(1)).alias("valid_rows"))


@query("date_blocks", "SELECT date_id, CAST(ntile(5) OVER (ORDER BY date_id) - 1 AS INT) AS block FROM (SELECT DISTINCT date_id FROM panel)", ctes=(PANEL,))
def date_blocks(spark, sf):
    """Five equal date blocks."""
    return fo.date_blocks(panel(spark, sf), 5)


@query("fold_causality_check", """SELECT fold, train_end + 1 < valid_start AS is_causal, count(*) AS "rows" FROM folds JOIN panel ON date_id BETWEEN valid_start AND valid_end GROUP BY 1, 2""", ctes=(PANEL, FOLD_ROWS))
def fold_causality_check(spark, sf):
    """Train ranges end before validation (with a demanded gap of one)."""
    folds = fo.rolling_folds(0, 82, n_folds=5, train_window=30, valid_window=10)
    checked = fo.check_fold_causality(fo.fold_frame(spark, folds), gap=1)
    return fo.assign_folds(panel(spark, sf), folds).groupBy("fold").agg(F.count(F.lit(1)).alias("rows")).join(checked, "fold").select("fold", "is_causal", "rows")


@query("leakage_check", 'SELECT count(*) AS "rows", 4 AS features, true AS target_rejected FROM panel', ctes=(PANEL,))
def leakage_check(spark, sf):
    """Feature list checked for target and responder columns, then profiled."""
    from panelkit.schema import feature_columns, reject_target_columns

    df = panel(spark, sf)
    features = feature_columns(df)
    reject_target_columns(features)
    try:
        reject_target_columns([*features, "responder_6"])
        rejected = False
    except ValueError:
        rejected = True
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(features)).alias("features"), F.lit(rejected).alias("target_rejected"))


# --------------------------------------------------------------------------- top-k

BOARD = """board AS (SELECT 's' || CAST(symbol_id AS VARCHAR) AS candidate, CASE WHEN symbol_id % 3 = 0 THEN 'stage3' WHEN symbol_id % 3 = 1 THEN 'smoke' ELSE 'other' END AS category,
  count(*) AS folds, CAST(sum(n) AS BIGINT) AS "rows", 1 - sum(a)/sum(b) AS global_r2, min(1-a/b) AS min_fold_r2, avg(1-a/b) AS mean_fold_r2 FROM (
    SELECT symbol_id, fold, count(*) AS n, sum(weight*(responder_6-trail_prediction)*(responder_6-trail_prediction)) AS a, sum(weight*responder_6*responder_6) AS b FROM oof GROUP BY 1, 2) GROUP BY symbol_id)"""


def board(spark, sf):
    """A scoreboard with one candidate per symbol."""
    scores = M.fold_scores(oof(spark, sf), "trail_prediction", by=["symbol_id", "fold"])
    named = scores.withColumn("candidate", F.concat(F.lit("s"), F.col("symbol_id").cast("string")))
    named = named.withColumn("category", F.when(F.col("symbol_id") % 3 == 0, "stage3").when(F.col("symbol_id") % 3 == 1, "smoke").otherwise("other"))
    return M.summarize(named, ["candidate", "category"]).select("candidate", "category", "folds", "rows", "global_r2", "min_fold_r2", "mean_fold_r2")


@query("scoreboard_sort", "SELECT candidate, global_r2, min_fold_r2, mean_fold_r2 FROM board WHERE \"rows\" >= 200 AND category IN ('stage3', 'smoke') --d:global_r2 min_fold_r2 mean_fold_r2", ctes=(PANEL, OOF, BOARD))
def scoreboard_sort(spark, sf):
    """Filtered scoreboard in score order."""
    kept = selection.filter_scoreboard(board(spark, sf), min_rows=200, categories=["stage3", "smoke"])
    return selection.sort_scoreboard(kept).select("candidate", "global_r2", "min_fold_r2", "mean_fold_r2")


@query("top_k", "SELECT candidate, global_r2 FROM board ORDER BY global_r2 DESC, min_fold_r2 DESC, mean_fold_r2 DESC LIMIT 10 --d:global_r2", ctes=(PANEL, OOF, BOARD))
def top_k(spark, sf):
    """Best ten candidates."""
    return selection.top_candidates(board(spark, sf), 10).select("candidate", "global_r2")


TOP_GROUP = "SELECT candidate, category, CAST(r AS INT) AS category_rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY global_r2 DESC, min_fold_r2 DESC, mean_fold_r2 DESC) AS r FROM board) WHERE r <= {k}"


@query("top_k_per_group", TOP_GROUP.format(k=4), ctes=(PANEL, OOF, BOARD))
def top_k_per_group(spark, sf):
    """Best four candidates of each category."""
    return selection.top_by_category(board(spark, sf), 4).select("candidate", "category", "category_rank")


@query("category_rank", TOP_GROUP.format(k=1000000), ctes=(PANEL, OOF, BOARD))
def category_rank(spark, sf):
    """Ordinal rank of every candidate in its category."""
    return selection.top_by_category(board(spark, sf), 1_000_000).select("candidate", "category", "category_rank")


@query("top_energy_times", "SELECT time_id, sum(weight*responder_6*responder_6) AS target_energy, avg(abs(responder_6)) AS target_abs_mean FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5 --d:target_energy target_abs_mean", ctes=(PANEL,), target_energy=3)
def top_energy_times(spark, sf):
    """Five times with most target energy."""
    return P.top_energy_times(P.key_profile(panel(spark, sf), "time_id", FEATURES), 5).select("time_id", "target_energy", "target_abs_mean")


@query(
    "nested_select",
    """SELECT c.fold, c.candidate_id, c.history_folds, c.selection_score, s.r2 AS weighted_zero_mean_r2 FROM (
         SELECT f.fold, CASE WHEN f.fold = 'rw_01' THEN 'run/base' ELSE arg_max('run/' || h.candidate, h.g) END AS candidate_id,
                CASE WHEN f.fold = 'rw_01' THEN 0 ELSE max(h.k) END AS history_folds, max(h.g) AS selection_score
         FROM (SELECT DISTINCT fold FROM oof) f LEFT JOIN (
           SELECT a.fold, b.candidate, 1 - sum(b.numerator)/sum(b.denominator) AS g, count(*) AS k FROM (SELECT DISTINCT fold FROM scores) a JOIN scores b ON b.fold < a.fold GROUP BY 1, 2) h ON h.fold = f.fold
         GROUP BY 1) c JOIN scores s ON s.fold = c.fold AND 'run/' || s.candidate = c.candidate_id --d:selection_score weighted_zero_mean_r2""",
    ctes=(PANEL, OOF, LONG_SCORES),
)
def nested_select(spark, sf):
    """Candidate per fold by the global R2 of earlier folds."""
    scores = io.name_scores(scores_of(spark, sf).withColumn("family", F.lit("naive")), "run")
    out = selection.nested_select(scores, first="run/base", metric="global_r2")
    return out.select("fold", "candidate_id", F.col("history_folds").cast("long").alias("history_folds"), "selection_score", "weighted_zero_mean_r2")
