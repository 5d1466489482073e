"""Signal screens, model experts and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import OOF, PANEL, oof, panel, query, table
from catalog.walkforward import TRIO, dot3, gram3, ridge3, solved3
from panelkit.functions import scalar as S
from panelkit.operators import folds as fo
from panelkit.operators import metrics as M
from panelkit.operators import screens as SC
from panelkit.operators.gates import CLOCKS
from panelkit.operators.sampling import grid_sample, row_index
from panelkit.plans import experts as E
from panelkit.plans import selection, studies
from panelkit.sources import fixtures as fx
from panelkit.sources.io import union_all

KEYS = ["date_id", "time_id", "symbol_id"]
K = "date_id, time_id, symbol_id"
FEATURES = ["feature_00", "feature_01", "feature_02", "feature_03"]


def split(spark, sf, first: int = 60):
    return SC.split_frame(panel(spark, sf), first)


# --------------------------------------------------------------------------- screens


@query("univariate_screen")
def univariate_screen(spark, sf):
    """Nine views of each feature: fit, scores, tails and information."""
    return SC.univariate_screen(split(spark, sf), FEATURES)


def _univariate_sql() -> str:
    """The z and sign views of one null-bearing feature in SQL."""
    base = "SELECT *, date_id < 60 AS t, coalesce(feature_03, m) AS x, (coalesce(feature_03, m)-m)/s AS z FROM panel, (SELECT m, stddev_pop(coalesce(feature_03, m)) AS s FROM panel, (SELECT avg(feature_03) AS m FROM panel WHERE date_id < 60) WHERE date_id < 60 GROUP BY 1)"
    views = {"z": "z", "sign": "CAST(sign(x) AS DOUBLE)", "abs_z": "abs(z)", "square_z": "z*z", "positive_indicator": "CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END"}
    long = " UNION ALL ".join(f"SELECT '{n}' AS transform, t, weight AS w, responder_6 AS y, {e} AS phi FROM ({base})" for n, e in views.items())
    return f"""SELECT 'feature_03' AS feature, transform, a AS alpha, 1 - sum(CASE WHEN NOT t THEN w*(y-a*phi)*(y-a*phi) END)/sum(CASE WHEN NOT t THEN w*y*y END) AS valid_r2 FROM ({long}) JOIN (
      SELECT transform, sum(w*phi*y)/sum(w*phi*phi) AS a FROM ({long}) WHERE t GROUP BY 1) USING (transform) GROUP BY 2, 3 --d:alpha valid_r2"""


@query("univariate_fit", _univariate_sql(), ctes=(PANEL,))
def univariate_fit(spark, sf):
    """Fit and validation score of five views."""
    out = SC.univariate_screen(split(spark, sf), ["feature_03"], ["z", "sign", "abs_z", "square_z", "positive_indicator"], details=False)
    return out.select("feature", "transform", "alpha", "valid_r2")


EDGES9 = ", ".join(f"quantile_cont(feature_00, {i}/10e0) AS x{i}, quantile_cont(responder_6, {i}/10e0) AS y{i}" for i in range(1, 10))


def bin10(c: str, p: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} >= {p}{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + ")"


@query(
    "binned_mi",
    f"SELECT sum(n/t*ln(n*t/(a*b))) AS binned_mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY xb) AS a, sum(n) OVER (PARTITION BY yb) AS b FROM (SELECT {bin10('feature_00', 'x')} AS xb, {bin10('responder_6', 'y')} AS yb, CAST(count(*) AS DOUBLE) AS n FROM panel, (SELECT {EDGES9} FROM panel) GROUP BY 1, 2)) --d:binned_mi",
    ctes=(PANEL,),
)
def binned_mi(spark, sf):
    """Mutual information over decile bins."""
    return SC.binned_information(panel(spark, sf), "feature_00", "responder_6")


@query(
    "reference_rank",
    f"""SELECT {K}, CASE WHEN date_id < 60 THEN (rank() OVER (PARTITION BY date_id < 60 ORDER BY feature_00) + (count(*) OVER (PARTITION BY date_id < 60, feature_00) - 1)/2e0 - 1)/CAST(nt - 1 AS DOUBLE) - 0.5e0
          ELSE count(CASE WHEN date_id < 60 THEN 1 END) OVER (ORDER BY feature_00)/CAST(nt AS DOUBLE) - 0.5e0 END AS reference_rank FROM panel, (SELECT count(*) AS nt FROM panel WHERE date_id < 60) --d:reference_rank""",
    ctes=(PANEL,), digits=8,
)
def reference_rank(spark, sf):
    """Rank of each value in the training distribution."""
    return SC.reference_rank(split(spark, sf), "feature_00").select(*KEYS, "reference_rank")


@query("permutation_null")
def permutation_null(spark, sf):
    """Best view under permuted targets: all features and views, four kinds of null, ten runs each."""
    return SC.null_screen(split(spark, sf), FEATURES)


@query(
    "null_targets",
    " UNION ALL ".join(f"SELECT '{k}' AS null_kind, count(*) AS \"rows\", count(*) AS positions, 0 AS lo, count(*) - 1 AS hi, sum(responder_6) AS total FROM panel" for k in SC.NULL_KINDS) + " --d:total",
    ctes=(PANEL,),
)
def null_targets(spark, sf):
    """Four kinds of permuted targets keep the multiset of target values."""
    df = panel(spark, sf)
    indexed, n = row_index(df, KEYS, "i"), df.count()
    out = None
    for kind in SC.NULL_KINDS:
        part = SC.null_targets(indexed, kind, seed=17, rows=n).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("i").alias("positions"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum("null_y").alias("total"))
        part = part.withColumn("null_kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def _interaction_sql() -> str:
    """All pairs of imputed features: signs, z-scores and ranks from train rows."""
    filled = "SELECT *, date_id < 60 AS t, " + ", ".join(f"coalesce({c}, (SELECT avg({c}) FROM panel WHERE date_id < 60)) AS x{i}" for i, c in enumerate(FEATURES)) + " FROM panel"
    own = "(rank() OVER (PARTITION BY t ORDER BY x{i}) + (count(*) OVER (PARTITION BY t, x{i}) - 1)/2e0 - 1)/(nt - 1) - 0.5e0"
    marks = ", ".join(
        f"(x{i} - avg(x{i}) FILTER (t) OVER ())/stddev_pop(x{i}) FILTER (t) OVER () AS z{i}, CASE WHEN t THEN {own.format(i=i)} ELSE count(*) FILTER (t) OVER (ORDER BY x{i})/CAST(nt AS DOUBLE) - 0.5e0 END AS k{i}, CAST(sign(x{i}) AS DOUBLE) AS s{i}"
        for i in range(len(FEATURES))
    )
    base = f"(SELECT *, {marks} FROM ({filled}), (SELECT CAST(count(*) AS DOUBLE) AS nt FROM panel WHERE date_id < 60))"
    forms = {"sign_product": "s{i}*s{j}", "rank_diff": "k{i} - k{j}", "z_diff": "z{i} - z{j}", "abs_z_diff": "abs(z{i} - z{j})", "z_product": "z{i}*z{j}", "rank_product": "k{i}*k{j}"}
    views = " UNION ALL ".join(
        f"SELECT '{FEATURES[i]}' AS l, '{FEATURES[j]}' AS r, '{n}' AS interaction, t, weight AS w, responder_6 AS y, {e.format(i=i, j=j)} AS phi FROM base"
        for i in range(len(FEATURES)) for j in range(i + 1, len(FEATURES)) for n, e in forms.items()
    )
    fits = "SELECT l, r, interaction, sum(w*phi*y) FILTER (t)/sum(w*phi*phi) FILTER (t) AS alpha, " + ", ".join(f"sum({e}) FILTER (NOT t) AS {n}" for n, e in {"vw": "w", "vx": "w*phi", "vy": "w*y", "vxx": "w*phi*phi", "vyy": "w*y*y", "vxy": "w*phi*y"}.items()) + " FROM views GROUP BY 1, 2, 3"
    return base, views, f"""SELECT l AS "left", r AS "right", interaction, alpha, 1 - (vyy - 2*alpha*vxy + alpha*alpha*vxx)/vyy AS valid_r2, CASE WHEN vxx - vx*vx/vw <= 1e-13*vxx OR vyy - vy*vy/vw <= 1e-13*vyy THEN 0e0 ELSE (vxy - vx*vy/vw)/sqrt((vxx - vx*vx/vw)*(vyy - vy*vy/vw)) END AS valid_corr FROM ({fits}) --d:alpha valid_r2 valid_corr"""


_BASE, _VIEWS, _FITS = _interaction_sql()


@query("interaction_screen", _FITS, ctes=(PANEL, f"base AS {_BASE}", f"views AS ({_VIEWS})"))
def interaction_screen(spark, sf):
    """Six views of every feature pair."""
    return SC.interaction_screen(split(spark, sf), FEATURES)


@query("interaction_nulls")
def interaction_nulls(spark, sf):
    """Best interaction of all pairs under four kinds of null, ten runs each."""
    return SC.null_screen(split(spark, sf), FEATURES, pairs=True)


def _xs_sql() -> str:
    z = "(x - avg(x) OVER g)/CASE WHEN stddev_samp(x) OVER g > 0 THEN stddev_samp(x) OVER g ELSE 1e0 END"
    rank = "CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY {p} ORDER BY x) + (count(*) OVER (PARTITION BY {p}, x) - 1)/2e0 - 1e0)/CASE WHEN count(*) OVER g > 1 THEN count(*) OVER g - 1 ELSE 1 END - 0.5e0 END"
    parts = []
    for feature in FEATURES:
        for name, p in (("date", "date_id"), ("date_time", "date_id, time_id")):
            for t, e in (("cs_z", z), ("cs_rank", rank.format(p=p))):
                rows = f"SELECT date_id < 60 AS t, weight AS w, responder_6 AS y, coalesce({e}, 0e0) AS phi FROM (SELECT *, {feature} AS x FROM panel) WINDOW g AS (PARTITION BY {p})"
                parts.append(f"SELECT '{feature}' AS feature, '{name}' AS grouping, '{t}' AS transform, a AS alpha, 1 - sum(w*(y-a*phi)*(y-a*phi))/sum(w*y*y) AS valid_r2 FROM ({rows}), (SELECT sum(w*phi*y)/sum(w*phi*phi) AS a FROM ({rows}) WHERE t) WHERE NOT t GROUP BY a")
    return " UNION ALL ".join(parts) + " --d:alpha valid_r2"


@query("xs_screen", _xs_sql(), ctes=(PANEL,))
def xs_screen(spark, sf):
    """Cross-sectional z-scores and ranks of all features as views."""
    out = SC.xs_screen(split(spark, sf), FEATURES, {"date": ["date_id"], "date_time": ["date_id", "time_id"]})
    return out.select("feature", "grouping", "transform", "alpha", "valid_r2")


INDEXED = f"idx AS (SELECT *, row_number() OVER (ORDER BY {K}) - 1 AS i FROM panel)"


@query(
    "modulo_screen",
    """SELECT modulo, CASE WHEN count(*) < modulo THEN 0 ELSE min(n) END AS min_train_bucket_rows, max(abs(m)) AS max_abs_bucket_mean, 1 - sum(vyy - 2*m*vy + m*m*vw)/sum(vyy) AS valid_r2 FROM (
         SELECT modulo, c, n, vyy, vy, vw, CASE WHEN n > 0 THEN twy/tw ELSE g END AS m FROM (SELECT k AS modulo, i % k AS c, count(CASE WHEN date_id < 60 THEN 1 END) AS n, sum(CASE WHEN date_id < 60 THEN weight*responder_6 END) AS twy, sum(CASE WHEN date_id < 60 THEN weight END) AS tw,
           coalesce(sum(CASE WHEN date_id >= 60 THEN weight*responder_6*responder_6 END), 0e0) AS vyy, coalesce(sum(CASE WHEN date_id >= 60 THEN weight*responder_6 END), 0e0) AS vy, coalesce(sum(CASE WHEN date_id >= 60 THEN weight END), 0e0) AS vw
           FROM idx, (SELECT unnest(range(2, 65) || [89, 97, 127]) AS k) GROUP BY 1, 2), (SELECT sum(weight*responder_6)/sum(weight) AS g FROM panel WHERE date_id < 60)) GROUP BY 1 --d:max_abs_bucket_mean valid_r2""",
    ctes=(PANEL, INDEXED),
)
def modulo_screen(spark, sf):
    """Row-position periodicity for 66 moduli."""
    return SC.modulo_screen(row_index(split(spark, sf), KEYS, "row_index")).withColumn("modulo", F.col("modulo").cast("long"))


@query("latent_models")
def latent_models(spark, sf):
    """Ridge grid and PLS on centred ranks."""
    scores, _, _ = studies.latent_models(split(spark, sf), FEATURES)
    return spark.createDataFrame([(s["model"], s["family"], float(s["valid_r2"])) for s in scores], "model string, family string, valid_r2 double")


@query("residual_mining")
def residual_mining(spark, sf):
    """All views on the residual of the best latent model."""
    return studies.residual_mining(split(spark, sf), FEATURES)


@query("frozen_rule_wf")
def frozen_rule_wf(spark, sf):
    """Fixed rules over date blocks."""
    return studies.frozen_rules(panel(spark, sf), [("feature_00", "z"), ("feature_03", "rank"), ("feature_03", "signed_tail05")])


def _top_sql() -> str:
    parts = []
    for c in FEATURES:
        ms = f"(SELECT m, stddev_pop(coalesce({c}, m)) AS s FROM panel, (SELECT avg({c}) AS m FROM panel WHERE date_id < 60) WHERE date_id < 60 GROUP BY 1)"
        for e in ("z", "abs(z)"):
            rows = f"(SELECT date_id < 60 AS t, weight AS w, responder_6 AS y, {e} AS phi FROM (SELECT *, (coalesce({c}, m) - m)/s AS z FROM panel, {ms}))"
            parts.append(f"SELECT '{c}' AS feature, 1 - sum(w*(y-a*phi)*(y-a*phi))/sum(w*y*y) AS valid_r2 FROM {rows}, (SELECT sum(w*phi*y)/sum(w*phi*phi) AS a FROM {rows} WHERE t) WHERE NOT t")
    return "SELECT feature, max(valid_r2) AS valid_r2 FROM (" + " UNION ALL ".join(parts) + ") GROUP BY 1 ORDER BY 2 DESC LIMIT 2 --d:valid_r2"


@query("top_features", _top_sql(), ctes=(PANEL,))
def top_features(spark, sf):
    """Two best features by their best view."""
    screen = SC.univariate_screen(split(spark, sf), FEATURES, ["z", "abs_z"], details=False)
    return selection.top_features(screen, 2).select("feature", "valid_r2")


@query("correlation_spectrum")
def correlation_spectrum(spark, sf):
    """Correlation eigenvalues against noise bounds."""
    found = SC.correlation_spectrum(panel(spark, sf), [*FEATURES, "responder_0", "weight"])
    rows = [(i, float(v), found["lambda_minus"], found["lambda_plus"]) for i, v in enumerate(found["eigenvalues"])]
    return spark.createDataFrame(rows, "k int, eigenvalue double, lambda_minus double, lambda_plus double")


@query(
    "acf",
    """SELECT symbol_id, CAST(lag AS INT) AS lag, sum(CASE WHEN lag = 1 THEN c*l1 WHEN lag = 2 THEN c*l2 ELSE c*l5 END)/sum(c*c) AS acf FROM (SELECT *, lag(c, 1) OVER w AS l1, lag(c, 2) OVER w AS l2, lag(c, 5) OVER w AS l5 FROM (
         SELECT *, responder_6 - avg(responder_6) OVER (PARTITION BY symbol_id) AS c FROM panel) WINDOW w AS (PARTITION BY symbol_id ORDER BY date_id, time_id)), (SELECT unnest([1, 2, 5]) AS lag) GROUP BY 1, 2 --d:acf""",
    ctes=(PANEL,),
)
def acf(spark, sf):
    """Autocorrelation of each symbol."""
    return SC.acf(panel(spark, sf), [1, 2, 5], dates_per_block=8)


@query(
    "acf_global",
    f"""SELECT CAST(k AS INT) AS lag, sum(CASE k WHEN 1 THEN c*l1 WHEN 2 THEN c*l2 ELSE c*l10 END)/sum(c*c) AS acf FROM (SELECT *, lag(c, 1) OVER w AS l1, lag(c, 2) OVER w AS l2, lag(c, 10) OVER w AS l10 FROM (SELECT *, responder_6 - avg(responder_6) OVER () AS c FROM panel) WINDOW w AS (ORDER BY {K})),
          (SELECT unnest([1, 2, 10]) AS k) GROUP BY 1 --d:acf""",
    ctes=(PANEL,),
)
def acf_global(spark, sf):
    """Autocorrelation of the whole table in key order."""
    return SC.global_acf(panel(spark, sf), [1, 2, 10])


def _periodogram_sql(series: str, order: str, top: int) -> str:
    return f"""SELECT symbol_id, CAST(k AS INT) AS frequency_index, CAST(k AS DOUBLE)/n AS frequency, CAST(n AS DOUBLE)/k AS period_rows, power, power/total AS power_share FROM (
      SELECT *, sum(power) OVER (PARTITION BY symbol_id) AS total, row_number() OVER (PARTITION BY symbol_id ORDER BY power DESC, k) AS r FROM (
        SELECT symbol_id, k, n, (pow(sum(c*cos(2*pi()*k*j/n)), 2) + pow(sum(c*sin(2*pi()*k*j/n)), 2))/n AS power FROM (
          SELECT symbol_id, x - avg(x) OVER g AS c, count(*) OVER g AS n, row_number() OVER (PARTITION BY symbol_id ORDER BY {order}) - 1 AS j FROM ({series}) WINDOW g AS (PARTITION BY symbol_id)), LATERAL (SELECT unnest(range(1, n//2 + 1)) AS k) GROUP BY 1, 2, 3)) WHERE r <= {top} --d:frequency period_rows power power_share"""


@query("periodogram", _periodogram_sql("SELECT symbol_id, date_id, avg(responder_6) AS x FROM panel GROUP BY 1, 2", "date_id", 3), ctes=(PANEL,))
def periodogram(spark, sf):
    """Strongest frequencies of each symbol's daily mean."""
    return SC.periodogram(panel(spark, sf), top_k=3)


@query("periodogram_rows", _periodogram_sql("SELECT symbol_id, date_id, time_id, responder_6 AS x FROM panel", "date_id, time_id", 2), ctes=(PANEL,))
def periodogram_rows(spark, sf):
    """Strongest frequencies of each symbol's raw rows, added up over blocks of rows."""
    return SC.periodogram(panel(spark, sf), top_k=2, order=["date_id", "time_id"], block=64, dates_per_part=16)


@query("hill_tail", "SELECT 100e0/sum(ln(x/e)) AS hill_index FROM (SELECT x, min(x) OVER () AS e FROM (SELECT abs(responder_6) AS x FROM panel WHERE responder_6 <> 0 ORDER BY 1 DESC LIMIT 101)) --d:hill_index", ctes=(PANEL,))
def hill_tail(spark, sf):
    """Hill index of the 100 largest magnitudes."""
    return SC.hill_table(panel(spark, sf), 100)


DIGITS = {"l_extendedprice": "l_extendedprice", "l_discount": "l_discount"}


@query(
    "digit_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS total_digits, " + ", ".join(f"count(CASE WHEN d = {i} THEN 1 END) AS digit_{i}" for i in range(10))
        + ", (" + " + ".join(f"pow(count(CASE WHEN d = {i} THEN 1 END) - count(*)/10e0, 2)" for i in range(10)) + ")/(count(*)/10e0) AS chi_square_vs_uniform, greatest(" + ", ".join(f"count(CASE WHEN d = {i} THEN 1 END)" for i in range(10))
        + f")/CAST(count(*) AS DOUBLE) AS max_digit_share FROM (SELECT CAST(round(abs({c})*100) AS BIGINT) % 10 AS d FROM lineitem)" for c in DIGITS
    ) + " --d:chi_square_vs_uniform max_digit_share",
)
def digit_audit(spark, sf):
    """Last-digit histograms of prices and discounts."""
    return SC.digit_audit(table(spark, sf, "lineitem"), list(DIGITS), 2)


# --------------------------------------------------------------------------- experts


LAYOUT = dict(n_folds=2, train_window=40, valid_window=12)


def fold_list(spark, sf):
    """Two rolling folds up to the panel's last date."""
    low, high = panel(spark, sf).agg(F.min("date_id"), F.max("date_id")).first()
    return fo.rolling_folds(low, high, **LAYOUT)


def _ridge_sql() -> str:
    parts, last = [], "(SELECT max(date_id) FROM panel)"
    for f in fo.rolling_folds(-10_000, 0, **LAYOUT):  # dates counted back from the last one
        tr, va = f"date_id - {last} BETWEEN {f.train_start} AND {f.train_end}", f"date_id - {last} BETWEEN {f.valid_start} AND {f.valid_end}"
        for a in ("10", "1000"):
            parts.append(
                f"""SELECT '{f.name}' AS fold, 'ridge_alpha{a}' AS candidate, count(*) AS "rows", sum(weight) AS weight_sum, sum(weight*pow(responder_6 - (b0 + b1*(coalesce(feature_03,0e0)-m)/s), 2)) AS numerator, sum(weight*responder_6*responder_6) AS denominator FROM panel, (
                SELECT m, s, (zz*sy - z*zy)/(sw*zz - z*z) AS b0, (sw*zy - z*sy)/(sw*zz - z*z) AS b1 FROM (SELECT m, s, sum(weight) AS sw, sum(weight*(x-m)/s) AS z, sum(weight*pow((x-m)/s, 2)) + {a}e0 AS zz, sum(weight*responder_6) AS sy, sum(weight*responder_6*(x-m)/s) AS zy
                  FROM (SELECT *, coalesce(feature_03, 0e0) AS x FROM panel WHERE {tr}), (SELECT avg(coalesce(feature_03,0e0)) AS m, stddev_pop(coalesce(feature_03,0e0)) AS s FROM panel WHERE {tr}) GROUP BY 1, 2)) WHERE {va}"""
            )
    return "SELECT *, 1 - numerator/denominator AS weighted_zero_mean_r2 FROM (" + " UNION ALL ".join(parts) + ") --d:weight_sum numerator denominator weighted_zero_mean_r2"


@query("ridge_single", _ridge_sql(), ctes=(PANEL,), numerator=3, denominator=3)
def ridge_single(spark, sf):
    """Alpha sweep of a one-feature ridge (closed form in SQL)."""
    return E.ridge_fold_scores(panel(spark, sf), fold_list(spark, sf), ["feature_03"], [10.0, 1000.0])


@query("ridge")
def ridge(spark, sf):
    """Alpha sweep of a four-feature ridge."""
    return E.ridge_fold_scores(panel(spark, sf), fold_list(spark, sf), FEATURES, [10.0, 1000.0])


def by_folds(spark, sf, fit):
    """Validation rows of every fold with what fit(train, valid) makes of them."""
    df, parts = panel(spark, sf), []
    for f in fold_list(spark, sf):
        parts.append(fit(df.where(f.train_filter()), df.where(f.valid_filter())).withColumn("fold", F.lit(f.name)))
    return union_all(parts)


@query("rank_ridge")
def rank_ridge(spark, sf):
    """Ridge on rank codes, fold by fold."""

    def fit(train, valid):
        encoder, model = E.rank_ridge(train, FEATURES, alpha=1000.0)
        return encoder.transform(valid).select(*KEYS, model.predict().alias("prediction"))

    return by_folds(spark, sf, fit)


@query("pls")
def pls(spark, sf):
    """Two-component PLS on rank codes, fold by fold."""

    def fit(train, valid):
        encoder, model = E.pls(train, FEATURES, components=2)
        return encoder.transform(valid).select(*KEYS, model.predict().alias("prediction"))

    return by_folds(spark, sf, fit)


@query(
    "linear_stacker",
    f"SELECT {K}, {dot3(TRIO)} AS prediction FROM (SELECT * FROM oof WHERE fold > 'rw_03') CROSS JOIN "
    + solved3(ridge3("(SELECT 1 AS one, " + ", ".join(f"sum({e}) AS {n}" for n, e in gram3(TRIO).items()) + " FROM oof WHERE fold <= 'rw_03')", "one", 1000), "one") + " --d:prediction",
    ctes=(PANEL, OOF),
)
def linear_stacker(spark, sf):
    """No-intercept stack of the experts."""
    from panelkit.operators.stats import linear_expr

    df = oof(spark, sf)
    beta = E.linear_stacker(df.where("fold <= 'rw_03'"), list(fx.EXPERTS), alpha=1000.0)
    return df.where("fold > 'rw_03'").select(*KEYS, linear_expr(list(beta), list(beta.values())).alias("prediction"))


@query("expert_pipeline")
def expert_pipeline(spark, sf):
    """Fold loop of rank ridge, PLS, stack, residual, risk and regime layers."""
    out = E.expert_pipeline(panel(spark, sf), fold_list(spark, sf), FEATURES, ridge_alpha=1000.0, pls_components=2, residual_features=["feature_03"], regime_rows=200, time_bucket_size=4)
    return M.candidate_scores(out, {c: c for c in E.pipeline_candidates(out)})


@query("gbt_expert")
def gbt_expert(spark, sf):
    """Boosted trees on a hash sample, two seeds, fold by fold."""
    return by_folds(spark, sf, lambda train, valid: E.gbt_expert(train, valid, FEATURES, seeds=[17, 18], fraction=0.5).select(*KEYS, "gbt_prediction"))


@query("pca_geometry")
def pca_geometry(spark, sf):
    """Three principal components of all rows, fitted on a grid of dates and times."""
    df = panel(spark, sf)
    out, _ = E.pca_geometry(df, FEATURES, fit_on=grid_sample(df, 2, 2))
    return out.select(*KEYS, *[F.abs(f"pc{i}").alias(f"abs_pc{i}") for i in (1, 2, 3)])


@query("oof_collect")
def oof_collect(spark, sf):
    """Inner out-of-fold ridge predictions."""
    out = E.oof_collect(panel(spark, sf), fold_list(spark, sf)[0], FEATURES, n_folds=3, valid_window=8, alpha=100.0)
    return out.select("fold", *KEYS, "prediction")


@query("clock_tournament")
def clock_tournament(spark, sf):
    """Strategies under all seven clocks, by weight bucket."""
    inputs = studies.clock_inputs(panel(spark, sf), ["feature_00", "feature_03"], windows=[64], max_time_id=6)
    df = oof(spark, sf).join(inputs.select(*KEYS, *sorted({c for c, _ in CLOCKS.values()} - set(KEYS))), KEYS)
    return studies.clock_tournament(df.where("fold <= 'rw_03'"), df.where("fold > 'rw_03'"), list(fx.EXPERTS), "trail_prediction", buckets=4, min_rows=100, max_time_id=6)
