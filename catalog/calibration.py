"""Calibrators, blends and gates fitted on early folds and applied to late ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.metrics import nearest
from catalog.registry import OOF, PANEL, oof, panel, query
from panelkit.functions import scalar as S
from panelkit.operators import blend, calibrate, gates, stats
from panelkit.operators import metrics as M
from panelkit.operators import xsection as X
from panelkit.sources import fixtures as fx

KEYS = ["date_id", "time_id", "symbol_id"]
K = "date_id, time_id, symbol_id"
CAL, VAL = "fold <= 'rw_03'", "fold > 'rw_03'"
C = "(SELECT * FROM oof WHERE fold <= 'rw_03')"


def cal_val(spark, sf):
    df = oof(spark, sf)
    return df.where(CAL), df.where(VAL)


def pick(df, *columns):
    return df.select(*KEYS, *columns)


# --------------------------------------------------------------------------- shrinkage

CLIPPED = "least(greatest(trail_prediction, -3e0), 3e0)"


@query(
    "shrinkage",
    f"""SELECT {K}, p * coalesce(a, fa) AS calibrated_prediction FROM (SELECT *, {CLIPPED} AS p FROM oof WHERE {VAL})
        LEFT JOIN (SELECT symbol_id AS s, CASE WHEN count(*) >= 120 THEN least(greatest(sum(weight*responder_6*p)/sum(weight*p*p), 0e0), 1e0) ELSE (SELECT least(greatest(sum(weight*responder_6*{CLIPPED})/sum(weight*{CLIPPED}*{CLIPPED}), 0e0), 1e0) FROM {C}) END AS a
                   FROM (SELECT *, {CLIPPED} AS p FROM {C}) GROUP BY 1) ON s = symbol_id
        CROSS JOIN (SELECT least(greatest(sum(weight*responder_6*{CLIPPED})/sum(weight*{CLIPPED}*{CLIPPED}), 0e0), 1e0) AS fa FROM {C}) --d:calibrated_prediction""",
    ctes=(PANEL, OOF),
)
def shrinkage(spark, sf):
    """Group shrinkage with a global fallback."""
    cal, val = cal_val(spark, sf)
    model = calibrate.fit_shrinkage(cal, ["symbol_id"], prediction="trail_prediction", min_rows=120, clip_abs=3.0)
    return pick(model.apply(val, "trail_prediction"), "calibrated_prediction")


GRID_BUCKETS = f"""gb AS (SELECT *, CAST(floor(time_id/2) AS INT) AS time_bucket,
  CASE WHEN weight <= {nearest('weight', 0.5, C)} THEN 'q00_q50' WHEN weight <= {nearest('weight', 0.9, C)} THEN 'q50_q90' WHEN weight <= {nearest('weight', 0.99, C)} THEN 'q90_q99' ELSE 'q99_q100' END AS weight_bucket,
  CASE WHEN feature_03 IS NULL THEN 'm01_m05' ELSE 'm00' END AS missing_bucket,
  CASE WHEN abs(trail_prediction) <= {nearest('abs(trail_prediction)', 0.5, C)} THEN 'p00_p50' WHEN abs(trail_prediction) <= {nearest('abs(trail_prediction)', 0.9, C)} THEN 'p50_p90' WHEN abs(trail_prediction) <= {nearest('abs(trail_prediction)', 0.99, C)} THEN 'p90_p99' ELSE 'p99_p100' END AS prediction_abs_bucket FROM oof)"""


def _grid_sql() -> str:
    base = "SELECT *, " + CLIPPED + " AS p FROM gb"
    alpha = "least(greatest(sum(weight*responder_6*p)/sum(weight*p*p), 0e0), 1e0)"
    parts = [f"SELECT 'clip_only' AS candidate, sum(weight*(responder_6-p)*(responder_6-p)) AS numerator, count(*) AS \"rows\" FROM ({base}) WHERE {VAL}"]
    parts.append(f"SELECT 'raw', sum(weight*(responder_6-trail_prediction)*(responder_6-trail_prediction)), count(*) FROM gb WHERE {VAL}")
    for name, groups in calibrate.SHRINKAGE_GRID.items():
        fit = f"SELECT {alpha} AS fa FROM ({base}) WHERE {CAL}"
        if not groups:
            parts.append(f"SELECT '{name}', sum(weight*(responder_6-fa*p)*(responder_6-fa*p)), count(*) FROM ({base}), ({fit}) WHERE {VAL}")
            continue
        keys = ", ".join(groups)
        parts.append(
            f"SELECT '{name}', sum(weight*(responder_6-coalesce(a,fa)*p)*(responder_6-coalesce(a,fa)*p)), count(*) FROM (SELECT * FROM ({base}) WHERE {VAL}) v CROSS JOIN ({fit}) LEFT JOIN (SELECT {keys}, CASE WHEN count(*) >= 200 THEN {alpha} END AS a FROM ({base}) WHERE {CAL} GROUP BY {keys}) g USING ({keys})"
        )
    return " UNION ALL ".join(parts) + " --d:numerator"


@query("shrinkage_grid", _grid_sql(), ctes=(PANEL, OOF, GRID_BUCKETS), digits=3)
def shrinkage_grid(spark, sf):
    """Every named grouping of the shrinkage grid scored on later folds."""
    df = oof(spark, sf)
    cal = df.where(CAL)
    edges = dict(weight_edges=calibrate.weight_thresholds(cal), abs_edges=calibrate.abs_thresholds(cal, ["trail_prediction"])["trail_prediction"])
    marked = calibrate.calibration_buckets(df, prediction="trail_prediction", features=["feature_00", "feature_03"], time_bucket_size=2, **edges)
    models = calibrate.fit_shrinkage_grid(marked.where(CAL), clip_abs=3.0, min_rows=200, prediction="trail_prediction")
    val = marked.where(VAL)
    for m in models:
        val = m.apply(val, "trail_prediction", f"__{m.name}")
    return M.candidate_scores(val, {m.name: f"__{m.name}" for m in models}, by=[]).select("candidate", "numerator", "rows")


@query("abs_thresholds", "SELECT " + ", ".join(f"{nearest('abs(trail_prediction)', q, C)} AS q{int(q*100)}" for q in (0.5, 0.9, 0.99)) + f", count(*) AS n FROM oof --d:q50 q90 q99", ctes=(PANEL, OOF), digits=9)
def abs_thresholds(spark, sf):
    """Nearest-rank magnitude thresholds."""
    df = oof(spark, sf)
    t = calibrate.abs_thresholds(df.where(CAL), ["trail_prediction"])["trail_prediction"]
    return df.agg(*[F.lit(v).alias(k) for k, v in t.items()], F.count(F.lit(1)).alias("n"))


@query("weight_thresholds", "SELECT " + ", ".join(f"{nearest('weight', q)} AS q{int(q*100)}" for q in (0.5, 0.9, 0.99)) + f", {nearest('abs(responder_6)', 0.999)} AS target_q999, count(*) AS n FROM panel --d:q50 q90 q99 target_q999", ctes=(PANEL,), digits=9)
def weight_thresholds(spark, sf):
    """Weight thresholds and an extreme target magnitude."""
    from panelkit.operators.core import quantile

    df = panel(spark, sf)
    (extreme,) = quantile(df, F.abs("responder_6"), [0.999], "nearest")
    return df.agg(*[F.lit(v).alias(k) for k, v in calibrate.weight_thresholds(df).items()], F.lit(extreme).alias("target_q999"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- blends

NUM, DEN = "weight*(base_prediction-trail_prediction)*(responder_6-trail_prediction)", "weight*(base_prediction-trail_prediction)*(base_prediction-trail_prediction)"
LAM = f"least(greatest(sum({NUM})/sum({DEN}), 0e0), 1e0)"


@query("convex_blend", f"SELECT {K}, l*base_prediction + (1-l)*trail_prediction AS blend_prediction FROM oof, (SELECT {LAM} AS l FROM {C}) WHERE {VAL} --d:blend_prediction", ctes=(PANEL, OOF))
def convex_blend(spark, sf):
    """One convex weight."""
    cal, val = cal_val(spark, sf)
    return pick(blend.add_convex(val, "base_prediction", "trail_prediction", blend.fit_convex(cal, "base_prediction", "trail_prediction")), "blend_prediction")


@query(
    "grouped_convex_blend",
    f"""SELECT {K}, coalesce(a,l)*base_prediction + (1-coalesce(a,l))*trail_prediction AS blend_prediction FROM (SELECT * FROM oof WHERE {VAL}) CROSS JOIN (SELECT {LAM} AS l FROM {C})
        LEFT JOIN (SELECT symbol_id AS s, CASE WHEN count(*) >= 120 THEN {LAM} END AS a FROM {C} GROUP BY 1) ON s = symbol_id --d:blend_prediction""",
    ctes=(PANEL, OOF),
)
def grouped_convex_blend(spark, sf):
    """Convex weight per symbol."""
    cal, val = cal_val(spark, sf)
    model = blend.fit_grouped_convex(cal, ["symbol_id"], "base_prediction", "trail_prediction", min_rows=120)
    return pick(blend.apply_convex(val, model, "base_prediction", "trail_prediction"), "blend_prediction")


@query("simplex_blend", f"SELECT {K}, l*base_prediction + (1-l)*trail_prediction AS ensemble_prediction FROM oof, (SELECT {LAM} AS l FROM {C}) WHERE {VAL} --d:ensemble_prediction", ctes=(PANEL, OOF))
def simplex_blend(spark, sf):
    """Simplex weights of two experts (equal to the convex weight)."""
    cal, val = cal_val(spark, sf)
    return pick(blend.add_simplex(val, blend.fit_simplex(cal, ["base_prediction", "trail_prediction"])), "ensemble_prediction")


def simplex3_sql(groups: str, experts: tuple[str, ...]) -> str:
    """Weights of three experts on the simplex: the inner solution where it is one, else the best edge."""
    sums = ", ".join(f"sum(weight*{experts[i]}*{experts[j]}) AS g{i}{j}" for i in range(3) for j in range(i, 3)) + ", " + ", ".join(f"sum(weight*{e}*responder_6) AS r{i}" for i, e in enumerate(experts))
    by = f"{groups}, " if groups else ""
    source = f"(SELECT {by}count(*) AS \"rows\", {sums} FROM {C}" + (f" GROUP BY {groups})" if groups else ")")
    inner = f"""(SELECT *, (b0*a11 - b1*a01)/(a00*a11 - a01*a01) AS w0, (a00*b1 - a01*b0)/(a00*a11 - a01*a01) AS w1 FROM (SELECT *, g00 - 2*g02 + g22 AS a00, g01 - g02 - g12 + g22 AS a01, g11 - 2*g12 + g22 AS a11, r0 - r2 - g02 + g22 AS b0, r1 - r2 - g12 + g22 AS b1 FROM {source}))"""
    parts = [f"SELECT {by}\"rows\", g00, g01, g02, g11, g12, g22, r0, r1, r2, w0, w1, 1 - w0 - w1 AS w2 FROM {inner} WHERE w0 >= 0 AND w1 >= 0 AND w0 + w1 <= 1"]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        lam = f"least(greatest((r{i} - r{j} - g{i}{j} + g{j}{j})/(g{i}{i} - 2*g{i}{j} + g{j}{j}), 0e0), 1e0)"
        w = {i: lam, j: f"1 - {lam}"}
        parts.append(f"SELECT {by}\"rows\", g00, g01, g02, g11, g12, g22, r0, r1, r2, " + ", ".join(f"{w.get(k, '0e0')} AS w{k}" for k in range(3)) + f" FROM {source}")
    loss = "w0*w0*g00 + w1*w1*g11 + w2*w2*g22 + 2*(w0*w1*g01 + w0*w2*g02 + w1*w2*g12) - 2*(w0*r0 + w1*r1 + w2*r2)"
    best = ", ".join(f"arg_min(w{k}, loss) AS w{k}" for k in range(3))
    return f"SELECT {by}any_value(\"rows\") AS \"rows\", {best} FROM (SELECT *, {loss} AS loss FROM ({' UNION ALL '.join(parts)}))" + (f" GROUP BY {groups}" if groups else "")


@query(
    "grouped_simplex",
    f"SELECT {K}, " + " + ".join(f"coalesce(g.w{k}, f.w{k})*{e}" for k, e in enumerate(fx.EXPERTS))
    + f" AS simplex_prediction FROM (SELECT * FROM oof WHERE {VAL}) CROSS JOIN ({simplex3_sql('', fx.EXPERTS)}) f LEFT JOIN (SELECT * FROM ({simplex3_sql('time_id', fx.EXPERTS)}) WHERE \"rows\" >= 200) g USING (time_id) --d:simplex_prediction",
    ctes=(PANEL, OOF),
)
def grouped_simplex(spark, sf):
    """Simplex weights of three experts per time step."""
    cal, val = cal_val(spark, sf)
    model = blend.fit_grouped_simplex(cal, ["time_id"], list(fx.EXPERTS), min_rows=200)
    return pick(model.apply(val, "simplex_prediction"), "simplex_prediction")


FIXED = blend.fixed_blends


@query(
    "fixed_blend",
    f"SELECT {K}, " + ", ".join(
        f"{w}*{a}_prediction + (1-{w})*{b}_prediction AS fixed_blend_{i}_w{str(w).replace('.', 'p').replace('e0', '')}_prediction" for i, (a, b) in enumerate([("base", "trail"), ("base", "linear"), ("trail", "linear")]) for w in ("0.25e0", "0.5e0")
    ) + " FROM oof --d:" + " ".join(f"fixed_blend_{i}_w{w}_prediction" for i in range(3) for w in ("0p25", "0p5")),
    ctes=(PANEL, OOF),
)
def fixed_blend(spark, sf):
    """All pairs at fixed weights."""
    added = blend.fixed_blends(fx.EXPERTS, [0.25, 0.5])
    return pick(oof(spark, sf).withColumns(added), *added)


# --------------------------------------------------------------------------- empirical Bayes, scales, risk


@query(
    "eb_scale",
    f"""SELECT {K}, coalesce(a, g)*trail_prediction AS eb_prediction FROM (SELECT * FROM oof WHERE {VAL}) CROSS JOIN overall LEFT JOIN (
          SELECT symbol_id AS s, CASE WHEN k >= 120 AND d > 1e-12 THEN least(greatest((n + m*g)/(d + m), 0e0), 2e0) ELSE g END AS a FROM grp, overall, (SELECT 4e0*median(d) AS m FROM grp WHERE d > 1e-12)) ON s = symbol_id --d:eb_prediction""",
    ctes=(PANEL, OOF, f"grp AS (SELECT symbol_id, count(*) AS k, sum(weight*trail_prediction*responder_6) AS n, sum(weight*trail_prediction*trail_prediction) AS d FROM {C} GROUP BY 1)", "overall AS (SELECT least(greatest(sum(n)/sum(d), 0e0), 2e0) AS g FROM grp)"),
)
def eb_scale(spark, sf):
    """Scales shrunk by four median groups."""
    cal, val = cal_val(spark, sf)
    model = calibrate.fit_bayes_scale(cal, ["symbol_id"], prediction="trail_prediction", prior_strength=4.0, min_rows=120)
    return pick(model.apply(val, lambda a: a * F.col("trail_prediction"), "eb_prediction"), "eb_prediction")


@query(
    "hier_mean",
    f"""SELECT {K}, coalesce(a, g) AS mean_prediction FROM (SELECT * FROM oof WHERE {VAL}) CROSS JOIN overall LEFT JOIN (
          SELECT symbol_id AS s, CASE WHEN k >= 120 AND d > 1e-12 THEN (n + m*g)/(d + m) ELSE g END AS a FROM grp, overall, (SELECT 8e0*median(d) AS m FROM grp WHERE d > 1e-12)) ON s = symbol_id --d:mean_prediction""",
    ctes=(PANEL, OOF, f"grp AS (SELECT symbol_id, count(*) AS k, sum(weight*responder_6) AS n, sum(weight) AS d FROM {C} GROUP BY 1)", "overall AS (SELECT sum(n)/sum(d) AS g FROM grp)"),
)
def hier_mean(spark, sf):
    """Shrunk conditional means."""
    cal, val = cal_val(spark, sf)
    return pick(calibrate.fit_bayes_mean(cal, ["symbol_id"], min_rows=120).apply(val, lambda m: m, "mean_prediction"), "mean_prediction")


LOO = "ctx AS (SELECT *, CASE WHEN count(*) OVER b > 1 THEN (sum(trail_prediction) OVER b - trail_prediction)/(count(*) OVER b - 1) ELSE trail_prediction END AS m FROM oof WINDOW b AS (PARTITION BY date_id, time_id))"


@query(
    "context_combiner",
    f"""SELECT {K}, least(greatest((aa*e - ab*c)/(aa*bb - ab*ab)*0 + (bb*c - ab*e)/(aa*bb - ab*ab), 0e0), 1e0)*m + least(greatest((aa*e - ab*c)/(aa*bb - ab*ab), 0e0), 1e0)*(trail_prediction - m) AS combined FROM ctx,
          (SELECT sum(weight*m*m)+1e-3 AS aa, sum(weight*m*d) AS ab, sum(weight*d*d)+1e-3 AS bb, sum(weight*m*responder_6) AS c, sum(weight*d*responder_6) AS e FROM (SELECT *, trail_prediction - m AS d FROM ctx WHERE {CAL})) WHERE {VAL} --d:combined""",
    ctes=(PANEL, OOF, LOO),
)
def context_combiner(spark, sf):
    """Clipped ridge over leave-one-out context."""
    df = X.score_context(oof(spark, sf), "trail_prediction")
    beta = calibrate.fit_context_combiner(df.where(CAL))
    return pick(df.where(VAL).withColumn("combined", stats.linear_expr(list(beta), list(beta.values()))), "combined")


@query(
    "grouped_scale",
    f"""SELECT {K}, coalesce(a, g)*trail_prediction AS scaled FROM (SELECT * FROM oof WHERE {VAL}) CROSS JOIN (SELECT (sum(n)+50e0)/(sum(d)+50e0) AS g FROM grp)
        LEFT JOIN (SELECT time_id AS t, w AS ww, CASE WHEN k >= 100 THEN (n + 50e0*g)/(d + 50e0) END AS a FROM grp, (SELECT (sum(n)+50e0)/(sum(d)+50e0) AS g FROM grp)) ON t = time_id AND ww = CAST(floor(weight/25) AS BIGINT) --d:scaled""",
    ctes=(PANEL, OOF, f"grp AS (SELECT time_id, CAST(floor(weight/25) AS BIGINT) AS w, count(*) AS k, sum(weight*trail_prediction*responder_6) AS n, sum(weight*trail_prediction*trail_prediction) AS d FROM {C} GROUP BY 1, 2)"),
)
def grouped_scale(spark, sf):
    """Scale per time and weight regime with a prior."""
    df = oof(spark, sf).withColumn("w", S.int_bucket("weight", 25))
    model = calibrate.fit_grouped_scale(df.where(CAL), ["time_id", "w"], prediction="trail_prediction", min_rows=100, prior=50.0)
    return pick(model.apply(df.where(VAL), lambda a: a * F.col("trail_prediction"), "scaled"), "scaled")


@query(
    "risk_shrink",
    f"SELECT {K}, trail_prediction/(1 + 0.5e0*least(r/m, 10e0)) AS plain, trail_prediction/sqrt(1 + 0.5e0*least(r/m, 10e0)) AS rooted FROM (SELECT *, abs(base_prediction) AS r FROM oof WHERE {VAL}), (SELECT avg(abs(base_prediction)) AS m FROM {C}) --d:plain rooted",
    ctes=(PANEL, OOF),
)
def risk_shrink(spark, sf):
    """Plain and root risk shrinkage."""
    cal, val = cal_val(spark, sf)
    mean = calibrate.risk_mean(cal, F.abs("base_prediction"))
    both = {n: S.risk_shrink("trail_prediction", F.abs("base_prediction"), mean, 0.5, root=r) for n, r in (("plain", False), ("rooted", True))}
    return pick(val.withColumns(both), "plain", "rooted")


DIS = "dis AS (SELECT *, ln(1e0+weight) AS log1p_weight, (abs(base_prediction)+abs(trail_prediction)+abs(linear_prediction))/3e0 AS prediction_abs_mean, sqrt((pow(base_prediction-m,2)+pow(trail_prediction-m,2)+pow(linear_prediction-m,2))/3e0) AS prediction_disagreement FROM (SELECT *, (base_prediction+trail_prediction+linear_prediction)/3e0 AS m FROM oof))"


def context(spark, sf):
    return X.expert_context(oof(spark, sf), list(fx.EXPERTS), left="base_prediction", right="trail_prediction")


@query(
    "risk_proxy",
    f"SELECT {K}, least(prediction_disagreement/a, 10e0) + least(prediction_abs_mean/b, 10e0) + least(log1p_weight/c, 10e0) AS risk FROM dis, (SELECT quantile_cont(prediction_disagreement, 0.9) AS a, quantile_cont(prediction_abs_mean, 0.9) AS b, quantile_cont(log1p_weight, 0.9) AS c FROM dis) --d:risk",
    ctes=(PANEL, OOF, DIS),
)
def risk_proxy(spark, sf):
    """Sum of relative risks."""
    df = context(spark, sf)
    return pick(df.withColumn("risk", calibrate.risk_proxy(df)), "risk")


# --------------------------------------------------------------------------- switches and gates

WB = "CASE WHEN weight <= 25 THEN 'q00_q50' WHEN weight <= 40 THEN 'q50_q90' WHEN weight <= 60 THEN 'q90_q99' ELSE 'q99_q100' END"
TAILED = f"tl AS (SELECT *, {WB} AS weight_bucket FROM oof)"


def tailed(spark, sf):
    return oof(spark, sf).withColumn("weight_bucket", S.quantile_bucket("weight", {"q50": 25, "q90": 40, "q99": 60}, S.WEIGHT_LABELS))


@query("tail_switch", f"SELECT {K}, CASE WHEN weight_bucket IN ('q90_q99', 'q99_q100') THEN trail_prediction ELSE base_prediction END AS switched FROM tl --d:switched", ctes=(PANEL, OOF, TAILED))
def tail_switch(spark, sf):
    """Candidate only in the weight tail."""
    return pick(tailed(spark, sf).withColumn("switched", gates.tail_switch("base_prediction", "trail_prediction")), "switched")


ADV = f"""adv AS (SELECT symbol_id AS s, count(*) AS "rows", sum(weight*(responder_6-trail_prediction)*(responder_6-trail_prediction)) < sum(weight*(responder_6-base_prediction)*(responder_6-base_prediction)) AS u FROM tl WHERE {CAL} AND weight_bucket IN ('q90_q99', 'q99_q100') GROUP BY 1 HAVING count(*) >= 15),
fall AS (SELECT sum(weight*(responder_6-trail_prediction)*(responder_6-trail_prediction)) < sum(weight*(responder_6-base_prediction)*(responder_6-base_prediction)) AS f FROM tl WHERE {CAL} AND weight_bucket IN ('q90_q99', 'q99_q100'))"""


def advantage(spark, sf):
    df = tailed(spark, sf)
    return df, gates.fit_tail_advantage(df.where(CAL), ["symbol_id"], base="base_prediction", candidate="trail_prediction", min_rows=15)


@query("tail_advantage", f"SELECT {K}, CASE WHEN weight_bucket IN ('q90_q99', 'q99_q100') AND coalesce(u, f) THEN trail_prediction ELSE base_prediction END AS advantaged FROM (SELECT * FROM tl WHERE {VAL}) CROSS JOIN fall LEFT JOIN adv ON s = symbol_id --d:advantaged", ctes=(PANEL, OOF, TAILED, ADV))
def tail_advantage(spark, sf):
    """Candidate in tail groups that improved."""
    df, policy = advantage(spark, sf)
    return pick(policy.apply(df.where(VAL), "advantaged"), "advantaged")


GG = f"SELECT symbol_id AS s, count(*) >= 150 AND sum(weight*responder_6*responder_6) > 1e-12 AND (sum(weight*(responder_6-base_prediction)*(responder_6-base_prediction)) - sum(weight*(responder_6-trail_prediction)*(responder_6-trail_prediction)))/sum(weight*responder_6*responder_6) > 0.01e0 AS u FROM {C} GROUP BY 1"


@query("group_gate", f"SELECT {K}, CASE WHEN coalesce(u, false) THEN trail_prediction ELSE base_prediction END AS gated FROM (SELECT * FROM oof WHERE {VAL}) LEFT JOIN ({GG}) ON s = symbol_id --d:gated", ctes=(PANEL, OOF))
def group_gate(spark, sf):
    """Candidate in symbols whose R2 improved enough."""
    cal, val = cal_val(spark, sf)
    gate = gates.fit_group_gate(cal, ["symbol_id"], base="base_prediction", candidate="trail_prediction", min_rows=150, min_delta=0.01)
    return pick(gate.apply(val, "gated"), "gated")


def described(spark, sf):
    df = tailed(spark, sf).withColumn("clock_bucket", S.fixed_time_bin("time_id", max_time_id=6, buckets=3))
    return gates.gate_meta(df.where(CAL), [df.where(CAL), df.where(VAL)], list(fx.EXPERTS), base="base_prediction", candidate="trail_prediction")


@query("gate_policies")
def gate_policies(spark, sf):
    """All named blend and shrink gates, scored on later folds."""
    cal, val = described(spark, sf)
    named = gates.fit_named_gates(cal, [*gates.BLEND_GATES, *gates.SHRINK_GATES], base="base_prediction", candidate="trail_prediction", min_rows=100)
    for put in named.values():
        val = put(val)
    return M.candidate_scores(val, {name: f"{name}_prediction" for name in named})


GQ = {"base_prediction": "e", "greatest(base_prediction,trail_prediction,linear_prediction)-least(base_prediction,trail_prediction,linear_prediction)": "d", "trail_prediction-base_prediction": "c"}


def _meta_sql() -> str:
    names = {"e": "ensemble_abs_bucket", "d": "disagreement_bucket", "c": "candidate_delta_bucket"}
    cols = []
    for x, n in GQ.items():
        q = [nearest(f"abs({x})", v, C) for v in (0.5, 0.9, 0.99)]
        cols.append(f"CASE WHEN abs({x}) <= {q[0]} THEN 'p00_p50' WHEN abs({x}) <= {q[1]} THEN 'p50_p90' WHEN abs({x}) <= {q[2]} THEN 'p90_p99' ELSE 'p99_p100' END AS {names[n]}")
    return f"SELECT {K}, {', '.join(cols)} FROM oof WHERE {VAL}"


@query("gate_meta", _meta_sql(), ctes=(PANEL, OOF))
def gate_meta(spark, sf):
    """Magnitude, disagreement and gap buckets under calibration thresholds."""
    return pick(described(spark, sf)[1], "ensemble_abs_bucket", "disagreement_bucket", "candidate_delta_bucket")


@query(
    "strategy_select",
    f"SELECT {K}, CASE best WHEN 'trail' THEN trail_prediction WHEN 'linear' THEN linear_prediction ELSE base_prediction END AS selected FROM oof, (SELECT CASE WHEN greatest(t, l) > b + 0.001e0 THEN CASE WHEN t >= l THEN 'trail' ELSE 'linear' END ELSE 'base' END AS best FROM (SELECT "
    + ", ".join(f"1 - sum(weight*(responder_6-{c})*(responder_6-{c}))/sum(weight*responder_6*responder_6) AS {c[0]}" for c in fx.EXPERTS) + f" FROM {C})) WHERE {VAL} --d:selected",
    ctes=(PANEL, OOF),
)
def strategy_select(spark, sf):
    """Best eligible strategy when it beats the base."""
    from panelkit.plans.walkforward import pick_column

    cal, val = cal_val(spark, sf)
    named = {c.removesuffix("_prediction"): c for c in fx.EXPERTS}
    best = gates.select_strategy(M.candidate_scores(cal, named, by=[]), "base", ["trail", "linear"], 0.001)
    return pick(val.withColumn("selected", pick_column(F.lit(best), named)), "selected")


@query("selection_gate", f"SELECT {K}, CASE WHEN passed THEN trail_prediction ELSE base_prediction END AS gated FROM oof, (SELECT sum(weight*(responder_6-trail_prediction)*(responder_6-trail_prediction)) < sum(weight*(responder_6-base_prediction)*(responder_6-base_prediction)) AS passed FROM {C}) WHERE {VAL} --d:gated", ctes=(PANEL, OOF))
def selection_gate(spark, sf):
    """One decision picks the column."""
    cal, val = cal_val(spark, sf)
    losses = calibrate.weighted_loss(cal, {"c": F.col("trail_prediction"), "b": F.col("base_prediction")})
    chosen = "trail_prediction" if losses["c"] < losses["b"] else "base_prediction"
    return pick(val.withColumn("gated", F.col(chosen)), "gated")


@query(
    "clock_bins",
    f"SELECT {K}, CAST(" + " + ".join(f"CASE WHEN weight > (SELECT quantile_cont(weight, {i}/8e0) FROM {C}) THEN 1 ELSE 0 END" for i in range(1, 8)) + f" AS INT) AS clock_bucket FROM oof WHERE {VAL}",
    ctes=(PANEL, OOF),
)
def clock_bins(spark, sf):
    """Linear-quantile clock bins fitted on early folds."""
    cal, val = cal_val(spark, sf)
    return pick(val.withColumn("clock_bucket", gates.fit_clock_bins(cal, "weight", buckets=8).column()), "clock_bucket")


@query("encoder_z", f"SELECT {K}, (coalesce(feature_03, m) - m)/s AS z FROM oof, (SELECT avg(feature_03) AS m, stddev_pop(feature_03) AS s FROM {C}) WHERE {VAL} --d:z", ctes=(PANEL, OOF))
def encoder_z(spark, sf):
    """Mean-imputed z-score from training statistics."""
    cal, val = cal_val(spark, sf)
    m, s = stats.standardizer(cal, ["feature_03"], impute="mean")
    return pick(val.withColumn("z", stats.z_expr("feature_03", m["feature_03"], s["feature_03"])), "z")


@query("encoder_rank")
def encoder_rank(spark, sf):
    """Rank codes from 254 training quantile edges."""
    from panelkit.plans.experts import RankEncoder

    cal, val = cal_val(spark, sf)
    out = RankEncoder.fit(cal, ["feature_00", "feature_03"]).transform(val)
    return pick(out, "feature_00__rank", "feature_03__rank")


@query("prediction_calibration", f"SELECT {K}, least(greatest(g, -1.5e0), 1.5e0)*linear_prediction AS calibrated FROM oof, (SELECT sum(weight*linear_prediction*responder_6)/sum(weight*linear_prediction*linear_prediction) AS g FROM {C}) WHERE {VAL} --d:calibrated", ctes=(PANEL, OOF))
def prediction_calibration(spark, sf):
    """Bounded global scale."""
    cal, val = cal_val(spark, sf)
    scale = calibrate.bounded_scale(cal, "linear_prediction", limit=1.5)
    return pick(val.withColumn("calibrated", F.lit(scale) * F.col("linear_prediction")), "calibrated")


@query(
    "residual_rule",
    f"""SELECT {K}, trail_prediction + a*(coalesce(feature_03, m)-m)/s AS corrected FROM oof, (SELECT m, s, sum(weight*(coalesce(feature_03,m)-m)/s*(responder_6-trail_prediction))/sum(weight*pow((coalesce(feature_03,m)-m)/s,2)) AS a
          FROM {C}, (SELECT m, stddev_pop(coalesce(feature_03, m)) AS s FROM {C}, (SELECT avg(feature_03) AS m FROM {C}) GROUP BY 1) GROUP BY 1, 2) WHERE {VAL} --d:corrected""",
    ctes=(PANEL, OOF),
)
def residual_rule(spark, sf):
    """Univariate residual correction."""
    cal, val = cal_val(spark, sf)
    rule = calibrate.fit_residual_rule(cal, "feature_03", "trail_prediction")
    return pick(val.withColumn("corrected", F.col("trail_prediction") + rule.correction()), "corrected")


@query(
    "risk_targets",
    f"SELECT {K}, abs(responder_6) AS abs_responder6, responder_6*responder_6 AS sq_responder6, e AS abs_error, e*e AS sq_error, CASE WHEN e >= h THEN 1e0 ELSE 0e0 END AS high_error FROM (SELECT *, abs(responder_6-trail_prediction) AS e FROM oof), (SELECT quantile_cont(abs(responder_6-trail_prediction), 0.9) AS h FROM {C}) --d:abs_responder6 sq_responder6 abs_error sq_error high_error",
    ctes=(PANEL, OOF),
)
def risk_targets(spark, sf):
    """Auxiliary magnitude and error targets."""
    from panelkit.operators.core import quantile

    df = oof(spark, sf)
    (h,) = quantile(df.where(CAL), F.abs(F.col("responder_6") - F.col("trail_prediction")), [0.9])
    cols = calibrate.risk_targets("trail_prediction", h)
    return pick(df.withColumns(cols), *cols)


# --------------------------------------------------------------------------- audits


@query("tail_activation", "SELECT count(*) AS validation_rows, count(CASE WHEN weight_bucket IN ('q90_q99', 'q99_q100') THEN 1 END) AS validation_tail_rows, count(DISTINCT CASE WHEN weight_bucket IN ('q90_q99', 'q99_q100') THEN date_id*1000+time_id END) AS validation_tail_batches, count(CASE WHEN weight_bucket NOT IN ('q90_q99', 'q99_q100') THEN 1 END) AS validation_non_tail_rows FROM tl", ctes=(PANEL, OOF, TAILED))
def tail_activation(spark, sf):
    """Rows and batches in the tail."""
    return gates.tail_activation(tailed(spark, sf))


@query(
    "tail_policy_audit",
    f"""SELECT p.*, r.*, g.* FROM
        (SELECT count(*) AS parameter_rows, count(CASE WHEN u THEN 1 END) AS use_candidate_parameter_rows, count(CASE WHEN NOT u THEN 1 END) AS use_base_parameter_rows, CAST(sum("rows") AS BIGINT) AS calibration_tail_rows, count(CASE WHEN NOT u THEN 1 END) = 0 AS all_parameter_rows_use_candidate FROM adv) p,
        (SELECT count(*) AS "rows", count(CASE WHEN t THEN 1 END) AS tail_rows, count(CASE WHEN abs(a-x) > 0 THEN 1 END) AS differing_rows, max(abs(a-x)) AS max_abs_diff, count(CASE WHEN abs(a-x) > 0 THEN 1 END) = 0 AS fixed_and_advantage_identical FROM (
           SELECT weight_bucket IN ('q90_q99','q99_q100') AS t, CASE WHEN weight_bucket IN ('q90_q99','q99_q100') AND coalesce(u, f) THEN trail_prediction ELSE base_prediction END AS a, CASE WHEN weight_bucket IN ('q90_q99','q99_q100') THEN trail_prediction ELSE base_prediction END AS x
           FROM (SELECT * FROM tl WHERE {VAL}) CROSS JOIN fall LEFT JOIN adv ON s = symbol_id)) r,
        (SELECT count(*) AS validation_tail_groups, count(CASE WHEN coalesce(u, f) THEN 1 END) AS validation_tail_groups_using_candidate, count(CASE WHEN NOT coalesce(u, f) THEN 1 END) AS validation_tail_groups_using_base, count(CASE WHEN u IS NULL THEN 1 END) AS validation_tail_groups_using_fallback
           FROM (SELECT DISTINCT symbol_id FROM tl WHERE {VAL} AND weight_bucket IN ('q90_q99','q99_q100')) CROSS JOIN fall LEFT JOIN adv ON s = symbol_id) g --d:max_abs_diff""",
    ctes=(PANEL, OOF, TAILED, ADV),
)
def tail_policy_audit(spark, sf):
    """Policy summary and its equality with the fixed switch on later folds."""
    df, policy = advantage(spark, sf)
    val = policy.apply(df.where(VAL), "adv").withColumn("fixed", gates.tail_switch("base_prediction", "trail_prediction"))
    summary = gates.policy_summary(policy).first().asDict()
    return gates.policy_equivalence(val, policy, fixed="fixed", advantage="adv").withColumns({n: F.lit(v) for n, v in summary.items()})


def _diag_sql() -> str:
    values = {"weight": "weight", "baseline_abs": "abs(base_prediction)", "candidate_delta_abs": "abs(trail_prediction-base_prediction)"}
    cols = []
    for n, x in values.items():
        q = [nearest(x, v, "oof") for v in (0.5, 0.9, 0.99)]
        cols.append(f"CASE WHEN {x} <= {q[0]} THEN 'p00_p50' WHEN {x} <= {q[1]} THEN 'p50_p90' WHEN {x} <= {q[2]} THEN 'p90_p99' ELSE 'p99_p100' END AS {n}_bucket")
    return f"SELECT {K}, CAST(floor(time_id/2) AS INT) AS time_bucket, {', '.join(cols)} FROM oof"


@query("diag_buckets", _diag_sql(), ctes=(PANEL, OOF))
def diag_buckets(spark, sf):
    """Target-free diagnostic buckets."""
    values = {"weight": F.col("weight"), "baseline_abs": F.abs("base_prediction"), "candidate_delta_abs": F.abs(F.col("trail_prediction") - F.col("base_prediction"))}
    return pick(gates.diagnostic_buckets(oof(spark, sf), values, time_bucket_size=2), "time_bucket", *[f"{n}_bucket" for n in values])


VARIANTS = {"q99": ["q99_q100"], "q90_q100": ["q90_q99", "q99_q100"]}
SLICES = "sl AS (SELECT fold, weight_bucket, 'base' AS strategy, count(*) AS \"rows\", sum(weight*(responder_6-base_prediction)*(responder_6-base_prediction)) AS numerator, sum(weight*(responder_6-trail_prediction)*(responder_6-trail_prediction)) AS other, sum(weight*responder_6*responder_6) AS denominator FROM tl GROUP BY 1, 2)"


def slices(spark, sf):
    named = {"base": "base_prediction", "trail": "trail_prediction"}
    return M.candidate_scores(tailed(spark, sf), named, by=["fold", "weight_bucket"]).withColumnRenamed("candidate", "strategy")


def _variant_sql(by_fold: bool) -> str:
    parts = []
    for n, b in VARIANTS.items():
        cond = "weight_bucket IN (" + ", ".join(f"'{x}'" for x in b) + ")"
        parts.append(
            f"""SELECT '{n}' AS variant, '{",".join(b)}' AS tail_buckets, fold, CAST(sum("rows") AS BIGINT) AS "rows", sum(CASE WHEN {cond} THEN other ELSE numerator END) AS numerator, sum(denominator) AS denominator,
            1 - sum(CASE WHEN {cond} THEN other ELSE numerator END)/sum(denominator) AS weighted_zero_mean_r2, 1 - sum(numerator)/sum(denominator) AS base_r2, sum(numerator) - sum(CASE WHEN {cond} THEN other ELSE numerator END) AS numerator_improvement,
            (sum(numerator) - sum(CASE WHEN {cond} THEN other ELSE numerator END))/sum(denominator) AS delta_r2 FROM sl GROUP BY 3"""
        )
    union = " UNION ALL ".join(parts)
    if by_fold:
        return union + " --d:numerator denominator weighted_zero_mean_r2 base_r2 numerator_improvement delta_r2"
    return f"""SELECT variant, tail_buckets, count(*) AS folds, CAST(sum("rows") AS BIGINT) AS validation_rows, avg(weighted_zero_mean_r2) AS mean_r2, stddev_samp(weighted_zero_mean_r2) AS std_r2, min(weighted_zero_mean_r2) AS min_r2, max(weighted_zero_mean_r2) AS max_r2,
      1 - sum(numerator)/sum(denominator) AS global_r2, min(delta_r2) AS min_delta_r2, max(delta_r2) AS max_delta_r2, sum(numerator_improvement) AS numerator_improvement FROM ({union}) GROUP BY 1, 2 --d:mean_r2 std_r2 min_r2 max_r2 global_r2 min_delta_r2 max_delta_r2 numerator_improvement"""


BIG = dict(numerator=3, denominator=3, numerator_improvement=3)


@query("tail_switch_from_slices", _variant_sql(True), ctes=(PANEL, OOF, TAILED, SLICES), **BIG)
def tail_switch_from_slices(spark, sf):
    """Switch scores from slice numerators alone."""
    from panelkit.plans.selection import tail_variants_by_fold

    return tail_variants_by_fold(slices(spark, sf), VARIANTS, base="base", candidate="trail")


@query("tail_variants", _variant_sql(False), ctes=(PANEL, OOF, TAILED, SLICES), **BIG)
def tail_variants(spark, sf):
    """Variant summaries with per-fold deltas."""
    from panelkit.plans.selection import tail_variants as summary

    return summary(slices(spark, sf), VARIANTS, base="base", candidate="trail")
