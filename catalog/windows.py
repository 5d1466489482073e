"""Path and cross-section windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import EPANEL, OOF, PANEL, epanel, oof, panel, query
from panelkit.operators import paths
from panelkit.operators import xsection as X
from panelkit.sources import fixtures as fx

KEYS = ["date_id", "time_id", "symbol_id"]
K = "date_id, time_id, symbol_id"


def f32(e: str) -> str:
    return f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"


def ewm(x: str, span: int) -> str:
    """Recurrence folded over the path so far, an independent formulation of the same mean."""
    a = 2.0 / (span + 1)
    return f"list_reduce(list({x}) OVER (PARTITION BY date_id, symbol_id ORDER BY time_id), lambda s, v: {1 - a!r}::DOUBLE * s + {a!r}::DOUBLE * v)"


PATHW = "WINDOW w AS (PARTITION BY date_id, symbol_id ORDER BY time_id)"


@query(
    "w_ewm",
    f"SELECT {K}, {ewm('coalesce(feature_01, 0e0)', 4)} AS ewm_4, {ewm('coalesce(feature_01, 0e0)', 64)} AS ewm_64 FROM epanel --d:ewm_4 ewm_64",
    ctes=(EPANEL,), digits=8,
)
def w_ewm(spark, sf):
    """Exponentially weighted means along the path."""
    from panelkit.functions.scalar import filled
    from panelkit.operators.core import with_ewm

    specs = [(filled("feature_01"), s, f"ewm_{s}") for s in (4, 64)]
    return with_ewm(epanel(spark, sf), specs, ["date_id", "symbol_id"], ["time_id"]).select(*KEYS, "ewm_4", "ewm_64")


DIFF = f"steps AS (SELECT *, {f32('coalesce(x - lag(x) OVER w, 0e0)')} AS d FROM (SELECT *, coalesce(feature_01, 0e0) AS x FROM epanel) {PATHW})"


@query("diff_path", f"SELECT {K}, d AS feature_01_tg_diff1 FROM steps --d:feature_01_tg_diff1", ctes=(EPANEL, DIFF), digits=5)
def diff_path(spark, sf):
    """First difference along the path."""
    return paths.rolling_variation(epanel(spark, sf), ["feature_01"], [5]).select(*KEYS, "feature_01_tg_diff1")


@query(
    "rolling_variation",
    "SELECT {k}, {c} FROM steps WINDOW w5 AS (PARTITION BY date_id, symbol_id ORDER BY time_id ROWS 4 PRECEDING), w20 AS (PARTITION BY date_id, symbol_id ORDER BY time_id ROWS 19 PRECEDING) --d:{n}".format(
        k=K,
        c=", ".join(f"{f32(f'sum(abs(d)) OVER w{n}')} AS feature_01_tg_tv_{n}, {f32(f'sum(d*d) OVER w{n}')} AS feature_01_tg_qv_{n}, {f32(f'sum(abs(d)) OVER w{n} / (sqrt(sum(d*d) OVER w{n}) + 1e-6)')} AS feature_01_tg_rough_{n}" for n in (5, 20)),
        n=" ".join(f"feature_01_tg_tv_{n} feature_01_tg_qv_{n} feature_01_tg_rough_{n}" for n in (5, 20)),
    ),
    ctes=(EPANEL, DIFF), digits=4,
)
def rolling_variation(spark, sf):
    """Total and quadratic variation and roughness."""
    return paths.rolling_variation(epanel(spark, sf), ["feature_01"], [5, 20]).drop("weight", "feature_00", "feature_01", "responder_6", "feature_01_tg_diff1")


@query(
    "koopman_path",
    f"""SELECT {K}, {f32('x*x')} AS feature_01_kp_square, {f32('d')} AS feature_01_kp_delta, {f32('x*d')} AS feature_01_kp_value_delta, {f32('x*e')} AS feature_01_kp_value_ewm_8 FROM (
          SELECT *, coalesce(x - lag(x) OVER w, 0e0) AS d, {ewm('x', 8)} AS e FROM (SELECT *, coalesce(feature_01, 0e0) AS x FROM epanel) {PATHW})
        --d:feature_01_kp_square feature_01_kp_delta feature_01_kp_value_delta feature_01_kp_value_ewm_8""",
    ctes=(EPANEL,), digits=5,
)
def koopman_path(spark, sf):
    """Square, step and memory observables."""
    return paths.koopman_path(epanel(spark, sf), ["feature_01"], 8).drop("weight", "feature_00", "feature_01", "responder_6")


@query(
    "ewm_bands",
    f"""SELECT {K}, {f32('a-b')} AS feature_00_ms_band_4_16, {f32('abs(a-b)')} AS feature_00_ms_absband_4_16, {f32('b-c')} AS feature_00_ms_band_16_64, {f32('abs(b-c)')} AS feature_00_ms_absband_16_64
        FROM (SELECT *, {ewm('feature_00', 4)} AS a, {ewm('feature_00', 16)} AS b, {ewm('feature_00', 64)} AS c FROM epanel)
        --d:feature_00_ms_band_4_16 feature_00_ms_absband_4_16 feature_00_ms_band_16_64 feature_00_ms_absband_16_64""",
    ctes=(EPANEL,), digits=6,
)
def ewm_bands(spark, sf):
    """Differences of neighbouring EWMs."""
    return paths.ewm_bands(epanel(spark, sf), ["feature_00"], [4, 16, 64]).drop("weight", "feature_00", "feature_01", "responder_6")


RESERVOIR = paths.Projection.gaussian(["feature_00", "feature_01"], n=2, seed=17)
TANH = [" + ".join(f"coalesce({c},0e0)*({w!r}::DOUBLE)" for c, w in zip(RESERVOIR.columns, row)) for row in RESERVOIR.weights]


@query(
    "reservoir",
    f"SELECT {K}, " + ", ".join(f"{f32(ewm(f'tanh({t})', s))} AS reservoir_s{i:02d}_ewm_{s}" for i, t in enumerate(TANH) for s in (5, 20))
    + " FROM epanel --d:" + " ".join(f"reservoir_s{i:02d}_ewm_{s}" for i in range(2) for s in (5, 20)),
    ctes=(EPANEL,),
)
def reservoir(spark, sf):
    """Squashed random projections with memory."""
    return paths.reservoir(epanel(spark, sf), RESERVOIR, [5, 20]).drop("weight", "feature_00", "feature_01", "responder_6")


@query(
    "operational_time",
    f"""SELECT {K}, {f32('time_id/86400e0')} AS ot_time_frac, {f32('sin(time_id/86400e0*2*pi())')} AS ot_time_sin, {f32('cos(time_id/86400e0*2*pi())')} AS ot_time_cos, CAST(count(*) OVER w AS DOUBLE) AS ot_symbol_tick_index,
          {f32('sum(weight) OVER w')} AS ot_symbol_weight_cum, m AS ot_missing_count, m/2e0 AS ot_missing_frac, a AS ot_source_activity, {f32(ewm('weight', 16))} AS ot_symbol_weight_ewm_16,
          {f32(ewm('a', 16))} AS ot_source_activity_ewm_16, {f32(ewm('m/2e0', 16))} AS ot_missing_frac_ewm_16
        FROM (SELECT *, CASE WHEN feature_01 IS NULL THEN 1e0 ELSE 0e0 END AS m, {f32('(abs(feature_00)+abs(coalesce(feature_01,0e0)))/2e0')} AS a FROM epanel) {PATHW}
        --d:ot_time_frac ot_time_sin ot_time_cos ot_symbol_tick_index ot_symbol_weight_cum ot_missing_count ot_missing_frac ot_source_activity ot_symbol_weight_ewm_16 ot_source_activity_ewm_16 ot_missing_frac_ewm_16""",
    ctes=(EPANEL,), digits=5,
)
def operational_time(spark, sf):
    """Operational clocks of each path."""
    return paths.operational_time(epanel(spark, sf), ["feature_00", "feature_01"], [16], 86400).drop("weight", "feature_00", "feature_01", "responder_6")


@query(
    "date_rolling_mean",
    f"""SELECT {K}, {f32('avg(responder_6) OVER (PARTITION BY time_id, symbol_id ORDER BY date_id ROWS 7 PRECEDING)')} AS roll8, {f32('abs(responder_6)')} AS mag, {f32('least(greatest(responder_6, -3e0), 3e0)')} AS clip3, CAST(sign(responder_6) AS DOUBLE) AS sgn FROM panel
        --d:roll8 mag clip3 sgn""",
    ctes=(PANEL,), digits=5,
)
def date_rolling_mean(spark, sf):
    """Trailing date means and other derived targets."""
    specs = {
        "roll8": {"kind": "rolling_mean", "source": "responder_6", "window": 8},
        "mag": {"kind": "abs", "source": "responder_6"},
        "clip3": {"kind": "clip", "source": "responder_6", "limit": 3.0},
        "sgn": {"kind": "sign", "source": "responder_6"},
    }
    return paths.auxiliary_targets(panel(spark, sf), specs).select(*KEYS, *specs)


@query(
    "sequence_window",
    f"""SELECT {K}, lag(feature_03, 5, 0e0) OVER w AS f_5, lag(feature_03, 1, 0e0) OVER w AS f_1, feature_03 AS f_0, lag(feature_00, 5, 0e0) OVER w AS g_5, feature_00 AS g_0, n AS size
        FROM (SELECT {K}, coalesce(feature_03, 0e0) AS feature_03, feature_00, 6 AS n FROM panel) WINDOW w AS (PARTITION BY symbol_id ORDER BY date_id, time_id) --d:f_5 f_1 f_0 g_5 g_0""",
    ctes=(PANEL,),
)
def sequence_window(spark, sf):
    """Last six rows of each symbol, left-padded."""
    out = paths.sequence_window(panel(spark, sf), ["feature_03", "feature_00"], 6, dates_per_block=8)
    s = F.col("sequence")
    return out.select(*KEYS, s[0][0].alias("f_5"), s[4][0].alias("f_1"), s[5][0].alias("f_0"), s[0][1].alias("g_5"), s[5][1].alias("g_0"), F.size(s).alias("size"))


@query("batch_ids", f"SELECT {K}, CAST(dense_rank() OVER (ORDER BY date_id, time_id) - 1 AS BIGINT) AS batch_id FROM panel", ctes=(PANEL,))
def batch_ids(spark, sf):
    """Dense batch numbers."""
    return paths.batch_ids(panel(spark, sf)).select(*KEYS, "batch_id")


# --------------------------------------------------------------------------- cross-section

XS = paths.Projection.gaussian(["feature_00", "feature_03"], n=2, seed=17)
RP = [" + ".join(f"coalesce({c},0e0)*({w!r}::DOUBLE)" for c, w in zip(XS.columns, row)) for row in XS.weights]
B = "OVER (PARTITION BY date_id, time_id)"


@query(
    "xs_random_projection",
    f"SELECT {K}, avg(p0) {B} AS xs_market_rp_00, avg(p1) {B} AS xs_market_rp_01, p0 - avg(p0) {B} AS xs_dev_rp_00, p1 - avg(p1) {B} AS xs_dev_rp_01 FROM (SELECT *, {RP[0]} AS p0, {RP[1]} AS p1 FROM panel) --d:xs_market_rp_00 xs_market_rp_01 xs_dev_rp_00 xs_dev_rp_01",
    ctes=(PANEL,),
)
def xs_random_projection(spark, sf):
    """Market mean and deviation of random projections."""
    return X.random_projections(panel(spark, sf), XS).select(*KEYS, *[f"xs_{k}_rp_0{i}" for k in ("market", "dev") for i in range(2)])


@query(
    "xs_tag_loo",
    f"SELECT {K}, l AS tag_price_market_loo, x - l AS tag_price_deviation FROM (SELECT *, CASE WHEN count(*) {B} > 1 THEN (sum(x) {B} - x)/(count(*) {B} - 1) ELSE x END AS l FROM (SELECT *, (coalesce(feature_00,0e0)+coalesce(feature_03,0e0))/2e0 AS x FROM panel)) --d:tag_price_market_loo tag_price_deviation",
    ctes=(PANEL,),
)
def xs_tag_loo(spark, sf):
    """Leave-one-out state of a feature tag."""
    return X.tag_state(panel(spark, sf), {"price": ["feature_00", "feature_03"]}).select(*KEYS, "tag_price_market_loo", "tag_price_deviation")


@query(
    "xs_score_loo",
    f"SELECT {K}, x AS score_prediction, count(*) {B} AS score_group_size, l AS score_market_loo, x - l AS score_deviation FROM (SELECT *, CASE WHEN count(*) {B} > 1 THEN (sum(x) {B} - x)/(count(*) {B} - 1) ELSE x END AS l FROM (SELECT *, least(greatest(trail_prediction, -2e0), 2e0) AS x FROM oof)) --d:score_prediction score_market_loo score_deviation",
    ctes=(PANEL, OOF),
)
def xs_score_loo(spark, sf):
    """Leave-one-out context of a clipped prediction."""
    return X.score_context(oof(spark, sf), "trail_prediction", clip_abs=2.0).select(*KEYS, *[f"score_{c}" for c in ("prediction", "group_size", "market_loo", "deviation")])


def avg_rank(x: str, part: str = "date_id, time_id") -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1)/2e0)"


@query(
    "xs_context",
    f"""SELECT {K}, CAST(floor(time_id/2) AS DOUBLE) AS ctx_time_bucket, CAST(symbol_id AS DOUBLE) AS ctx_symbol_id, ln(1e0+weight) AS ctx_log1p_weight, CASE WHEN feature_03 IS NULL THEN 1e0 ELSE 0e0 END AS ctx_missing_count,
          (abs(feature_00)+abs(x))/2e0 AS ctx_abs_feature_mean, abs(responder_0) AS ctx_lag_energy, ({avg_rank('x')} - 0.5e0)/count(*) {B} - 0.5e0 AS feature_03_ctx_cs_rank,
          (x - avg(x) {B})/CASE WHEN stddev_pop(x) {B} > 1e-12 THEN stddev_pop(x) {B} ELSE 1e0 END AS feature_03_ctx_cs_z FROM (SELECT *, coalesce(feature_03, 0e0) AS x FROM panel)
        --d:ctx_time_bucket ctx_symbol_id ctx_log1p_weight ctx_missing_count ctx_abs_feature_mean ctx_lag_energy feature_03_ctx_cs_rank feature_03_ctx_cs_z""",
    ctes=(PANEL,),
)
def xs_context(spark, sf):
    """Row context with batch rank and z-score."""
    out = X.context_features(panel(spark, sf), ["feature_00", "feature_03"], ranked=["feature_03"], time_bucket_size=2, lags=["responder_0"])
    return out.select(*KEYS, *[c for c in out.columns if c.startswith("ctx_") or "_ctx_" in c])


def modes_sql(x: str, source: str, count: str, std: str, filled: bool) -> str:
    n = f"count({count}) {B}"
    s = f"{std}(x) {B}"
    rank = f"(CASE WHEN x IS NULL THEN NULL ELSE {avg_rank('x')} END - 1e0)/nullif({n} - 1e0, 0)" if not filled else f"({avg_rank('x')} - 1e0)/nullif({n} - 1e0, 0)"
    r = f"CASE WHEN {n} > 1 THEN {rank} - 0.5e0 ELSE 0e0 END"
    z = f"(x - avg(x) {B})/CASE WHEN {s} > 1e-12 THEN {s} ELSE 1e0 END" if filled else f"CASE WHEN {s} > 1e-12 THEN (x - avg(x) {B})/{s} ELSE 0e0 END"
    energy = "x*x" if filled else "sqrt(coalesce(x,0e0)*coalesce(x,0e0))"
    names = ["batch_rank", "batch_top10", "batch_bottom10", "batch_demean", "batch_zscore", "batch_abs_zscore"]
    return f"""SELECT {K}, coalesce(r, 0e0) AS {x}__raw_batch_rank, CASE WHEN r >= 0.4e0 THEN 1e0 ELSE 0e0 END AS {x}__raw_batch_top10, CASE WHEN r <= -0.4e0 THEN 1e0 ELSE 0e0 END AS {x}__raw_batch_bottom10,
      coalesce(x - m, 0e0) AS {x}__raw_batch_demean, coalesce(z, 0e0) AS {x}__raw_batch_zscore, coalesce(abs(z), 0e0) AS {x}__raw_batch_abs_zscore, miss AS raw_row_missing_count, abs(coalesce(x, 0e0)) AS raw_row_abs_mean, {energy} AS raw_row_l2_energy
      FROM (SELECT *, {r} AS r, avg(x) {B} AS m, {z} AS z FROM (SELECT *, {source} AS x, CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END AS miss FROM panel))
      --d:{' '.join(f'{x}__raw_{n}' for n in names)} raw_row_missing_count raw_row_abs_mean raw_row_l2_energy"""


def modes_of(df, variant):
    out = X.raw_modes(df, ["feature_03"], X.RAW_MODES, variant=variant)
    return out.select(*KEYS, *[c for c in out.columns if "__raw_" in c or c.startswith("raw_row")])


@query("xs_raw_modes", modes_sql("feature_03", "coalesce(feature_03, 0e0)", "*", "stddev_pop", True), ctes=(PANEL,), digits=9)
def xs_raw_modes(spark, sf):
    """Raw modes with nulls as zeros."""
    return modes_of(panel(spark, sf), "filled")


@query("xs_raw_modes_oof", modes_sql("feature_03", "feature_03", "x", "stddev_samp", False), ctes=(PANEL,), digits=9)
def xs_raw_modes_oof(spark, sf):
    """Raw modes that keep nulls out of the batch."""
    return modes_of(panel(spark, sf), "nulls")


@query(
    "xs_expert_expansion",
    f"""SELECT {K}, x*abs(x) AS trail_prediction__signed_square, abs(x) AS trail_prediction__abs, sign(x)*sqrt(abs(x)) AS trail_prediction__signed_sqrt, sign(x)*ln(1e0+abs(x)) AS trail_prediction__signed_log1p, x*x*x AS trail_prediction__cube,
          CAST(sign(x) AS DOUBLE) AS trail_prediction__sign, CASE WHEN count(*) {B} > 1 THEN ({avg_rank('x')} - 1e0)/nullif(count(*) {B} - 1e0, 0) - 0.5e0 ELSE 0e0 END AS trail_prediction__batch_rank, avg(x) {B} AS trail_prediction__batch_mean,
          x - avg(x) {B} AS trail_prediction__batch_demean, coalesce(stddev_samp(x) {B}, 0e0) AS trail_prediction__batch_std, CASE WHEN stddev_samp(x) {B} > 1e-12 THEN (x - avg(x) {B})/stddev_samp(x) {B} ELSE 0e0 END AS trail_prediction__batch_zscore,
          x*linear_prediction AS trail_prediction__x__linear_prediction FROM (SELECT *, trail_prediction AS x FROM oof)
        --d:{' '.join(f'trail_prediction__{m}' for m in X.EXPANSIONS if m != 'pair_product')} trail_prediction__x__linear_prediction""",
    ctes=(PANEL, OOF),
)
def xs_expert_expansion(spark, sf):
    """Every expansion of an expert and a pair product."""
    out = X.expert_expansions(oof(spark, sf), ["trail_prediction", "linear_prediction"], X.EXPANSIONS)
    return out.select(*KEYS, *[c for c in out.columns if c.startswith("trail_prediction__")])


@query(
    "xs_presample_batch",
    f"""SELECT * FROM (SELECT {K}, avg(m) {B} AS batch_missing, avg(x) {B} AS feature_03_batch_mean, stddev_pop(x) {B} AS feature_03_batch_std, CASE WHEN count(*) {B} > 1 THEN ({avg_rank('x')} - 1e0)/nullif(count(*) {B} - 1e0, 0) - 0.5e0 ELSE 0e0 END AS feature_03_batch_rank
          FROM (SELECT *, coalesce(feature_03, 0e0) AS x, CASE WHEN feature_03 IS NULL THEN 1e0 ELSE 0e0 END AS m FROM panel)) WHERE (date_id*7 + symbol_id) % 5 = 0
        --d:batch_missing feature_03_batch_mean feature_03_batch_std feature_03_batch_rank""",
    ctes=(PANEL,),
)
def xs_presample_batch(spark, sf):
    """Batch statistics over all rows, kept for a sample."""
    out = X.presample_batch(panel(spark, sf), ["feature_03"], (F.col("date_id") * 7 + F.col("symbol_id")) % 5 == 0)
    return out.select(*KEYS, "batch_missing", "feature_03_batch_mean", "feature_03_batch_std", "feature_03_batch_rank")


@query("xs_batch_missing", f"SELECT {K}, {f32(f'avg(CASE WHEN feature_03 IS NULL THEN 0.5e0 ELSE 0e0 END) {B}')} AS batch_missing_frac FROM panel --d:batch_missing_frac", ctes=(PANEL,), digits=5)
def xs_batch_missing(spark, sf):
    """Mean missing fraction of the batch."""
    return X.batch_missing(panel(spark, sf), ["feature_02", "feature_03"]).select(*KEYS, "batch_missing_frac")


@query(
    "xs_batch_state",
    f"SELECT {K}, {f32(f'sum(weight) {B}')} AS batch_weight_sum, {f32(f'avg(abs(feature_00)) {B}')} AS batch_activity_mean, {f32(f'avg(CASE WHEN feature_03 IS NULL THEN 1e0 ELSE 0e0 END) {B}')} AS batch_missing_frac FROM panel --d:batch_weight_sum batch_activity_mean batch_missing_frac",
    ctes=(PANEL,), digits=4,
)
def xs_batch_state(spark, sf):
    """Batch weight, activity and missingness."""
    df = panel(spark, sf).withColumns({"act": F.abs("feature_00"), "miss": F.col("feature_03").isNull().cast("double")})
    return X.batch_state(df, activity="act", missing="miss").select(*KEYS, "batch_weight_sum", "batch_activity_mean", "batch_missing_frac")


def zr(g: str, part: str, tag: str) -> str:
    o = f"OVER (PARTITION BY {part})"
    return (f"coalesce((x - avg(x) {o})/CASE WHEN stddev_samp(x) {o} > 0 THEN stddev_samp(x) {o} ELSE 1e0 END, 0e0) AS feature_03_cs_z_{tag}, "
            f"coalesce((CASE WHEN x IS NULL THEN NULL ELSE {avg_rank('x', part)} END - 1e0)/CASE WHEN count(*) {o} > 1 THEN count(*) {o} - 1 ELSE 1 END - 0.5e0, 0e0) AS feature_03_cs_rank_{tag}")


@query(
    "xs_forensic",
    f"SELECT {K}, {zr('d', 'date_id', 'date')}, {zr('dt', 'date_id, time_id', 'date_time')} FROM (SELECT *, feature_03 AS x FROM panel) --d:feature_03_cs_z_date feature_03_cs_rank_date feature_03_cs_z_date_time feature_03_cs_rank_date_time",
    ctes=(PANEL,),
)
def xs_forensic(spark, sf):
    """z-scores and ranks inside dates and batches."""
    out = X.z_and_rank(X.z_and_rank(panel(spark, sf), ["feature_03"], ["date_id"], "date"), ["feature_03"], ["date_id", "time_id"], "date_time")
    return out.select(*KEYS, *[f"feature_03_cs_{k}_{g}" for g in ("date", "date_time") for k in ("z", "rank")])


@query(
    "global_rank_bucket",
    f"SELECT {K}, CAST(least(greatest(floor((rank() OVER (ORDER BY weight) + (count(*) OVER (PARTITION BY weight) - 1)/2e0 - 1e0)/count(*) OVER () * 8), 0), 7) AS INT) AS bucket FROM panel",
    ctes=(PANEL,),
)
def global_rank_bucket(spark, sf):
    """Equal-population weight buckets over the whole table."""
    return X.global_rank_bucket(panel(spark, sf), "weight", 8, "bucket").select(*KEYS, "bucket")


@query(
    "expert_context",
    f"""SELECT {K}, base_prediction - trail_prediction AS expert_gap, (abs(base_prediction)+abs(trail_prediction)+abs(linear_prediction))/3e0 AS prediction_abs_mean,
          sqrt((pow(base_prediction-m,2)+pow(trail_prediction-m,2)+pow(linear_prediction-m,2))/3e0) AS prediction_disagreement, ln(1e0+weight) AS log1p_weight
        FROM (SELECT *, (base_prediction+trail_prediction+linear_prediction)/3e0 AS m FROM oof) --d:expert_gap prediction_abs_mean prediction_disagreement log1p_weight""",
    ctes=(PANEL, OOF),
)
def expert_context(spark, sf):
    """Gap, magnitude and disagreement of the experts."""
    out = X.expert_context(oof(spark, sf), list(fx.EXPERTS), left="base_prediction", right="trail_prediction")
    return out.select(*KEYS, "expert_gap", "prediction_abs_mean", "prediction_disagreement", "log1p_weight")
