"""Walk-forward, online, screen and expert plans against numpy, and past-only checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import folds, screens
from panelkit.operators import metrics as M
from panelkit.plans import experts as E
from panelkit.plans import online as O
from panelkit.plans import selection, studies
from panelkit.plans import walkforward as WF

KEYS = ["date_id", "time_id", "symbol_id"]
XS = ["a_prediction", "b_prediction"]


def column(df, name):
    return df.toPandas().sort_values(KEYS)[name].to_numpy()


def ridge(x, y, w, alpha, centre=None):
    centre = np.zeros(x.shape[1]) if centre is None else centre
    return np.linalg.solve(x.T @ (x * w[:, None]) + alpha * np.eye(x.shape[1]), x.T @ (w * y) + alpha * centre)


def test_ridge_stack_uses_earlier_folds(toy):
    pdf, df = toy
    got = column(WF.wf_ridge_stack(df, XS, {"p": 10.0}).rows, "p")
    want = np.empty(len(pdf))
    for k, f in enumerate(sorted(pdf.fold.unique())):
        now, past = pdf.fold == f, pdf[pdf.fold < f]
        beta = np.array([1.0, 0.0]) if k == 0 else ridge(past[XS].to_numpy(), past.responder_6.to_numpy(), past.weight.to_numpy(), 10.0)
        want[now] = pdf.loc[now, XS].to_numpy() @ beta
    np.testing.assert_allclose(got, want)


def test_residual_matches_direct_fit(toy):
    pdf, df = toy
    features = ["feature_00", "feature_01"]
    got = column(WF.wf_residual(df, "a_prediction", features, alpha=5.0, output="p").rows, "p")
    want = pdf.a_prediction.to_numpy().copy()
    for f in sorted(pdf.fold.unique())[1:]:
        now, past = (pdf.fold == f).to_numpy(), pdf[pdf.fold < f]
        mean = past[features].mean().to_numpy()
        filled = past[features].fillna(dict(zip(features, mean))).to_numpy()
        scale = filled.std(axis=0)
        beta = ridge((filled - mean) / scale, (past.responder_6 - past.a_prediction).to_numpy(), past.weight.to_numpy(), 5.0)
        x = pdf.loc[now, features].fillna(dict(zip(features, mean))).to_numpy()
        want[now] += (x - mean) / scale @ beta
    np.testing.assert_allclose(got, want)


def disturbed(df, fold):
    """Same table with the targets of one fold changed."""
    return df.withColumn("responder_6", F.when(F.col("fold") == fold, F.col("responder_6") * -3 + 1).otherwise(F.col("responder_6")))


BUILDERS = {
    "convex": lambda d: WF.wf_convex(d, *XS, "p").rows,
    "grouped": lambda d: WF.wf_grouped_blend(d, *XS, ["time_bucket", "weight_bucket"], min_rows=5, time_bucket_size=2, output="p").rows,
    "bayes": lambda d: WF.wf_bayes_scale(d, "a_prediction", ["weight_bucket"], left=XS[0], right=XS[1], min_rows=5, output="p").rows,
    "deadband": lambda d: WF.wf_deadband(d, "a_prediction", output="p").rows,
    "static": lambda d: WF.wf_static_ridge(d, XS, alpha=10.0, prior_feature=XS[0], output="p").rows,
    "residual": lambda d: WF.wf_residual(d, "a_prediction", ["feature_00", "feature_01"], output="p").rows,
    "context": lambda d: WF.wf_context_blend(d, *XS, "weight+abs_diff", time_bucket_size=2, min_rows=5, prior=1.0, output="p").rows,
    "regime": lambda d: WF.wf_regime_scale(d, "a_prediction", third="b_prediction", time_bucket_size=2, min_rows=3, prior=1.0, output="p").rows,
}


@pytest.mark.parametrize("name", BUILDERS)
def test_fold_targets_never_reach_their_own_fold(toy, name):
    _, df = toy
    a = BUILDERS[name](df).where("fold <= 'rw_03'")
    b = BUILDERS[name](disturbed(df, "rw_03")).where("fold <= 'rw_03'")
    np.testing.assert_array_equal(column(a, "p"), column(b, "p"))
    later = BUILDERS[name](disturbed(df, "rw_03")).where("fold > 'rw_03'")
    assert not np.allclose(column(BUILDERS[name](df).where("fold > 'rw_03'"), "p"), column(later, "p"))


def test_context_score_equals_scored_rows(toy):
    _, df = toy
    options = dict(time_bucket_size=2, min_rows=8, prior=2.0)
    rows = WF.wf_context_blend(df, *XS, "time+abs_left+sign_agree", output="p", **options).rows
    a = M.fold_scores(rows, "p").orderBy("fold").toPandas()
    b = WF.score_context_blend(df, *XS, "time+abs_left+sign_agree", **options).orderBy("fold").toPandas()
    np.testing.assert_allclose(a.numerator, b.numerator)
    with pytest.raises(ValueError):
        WF.parse_context("time+target")


def test_subset_search_matches_stack(toy):
    _, df = toy
    found = WF.subset_search(df, ["a_prediction"], ["b_prediction"], alpha=10.0)
    both = {r["fold"]: r["numerator"] for r in found if r["subset"] == "b_prediction"}
    rows = WF.wf_ridge_stack(df, XS, {"p": 10.0}).rows
    for r in M.fold_scores(rows, "p").collect():
        assert both[r.fold] == pytest.approx(r.numerator)


# --------------------------------------------------------------------------- online


def replayed(pdf, alpha, forgetting):
    """Day loop of recursive least squares in numpy."""
    out, lev = np.empty(len(pdf)), np.empty(len(pdf))
    for f in sorted(pdf.fold.unique()):
        past = pdf[pdf.fold < f]
        x, y, w = past[XS].to_numpy(), past.responder_6.to_numpy(), past.weight.to_numpy()
        p = alpha * np.eye(2) + x.T @ (x * w[:, None])
        r = alpha * np.array([1.0, 0.0]) + x.T @ (w * y)
        pending = None
        for d in sorted(pdf[pdf.fold == f].date_id.unique()):
            if pending is not None:
                x, y, w = pending[XS].to_numpy(), pending.responder_6.to_numpy(), pending.weight.to_numpy()
                p, r = forgetting * p + x.T @ (x * w[:, None]), forgetting * r + x.T @ (w * y)
            now = ((pdf.fold == f) & (pdf.date_id == d)).to_numpy()
            x = pdf.loc[now, XS].to_numpy()
            out[now] = x @ np.linalg.solve(p, r)
            lev[now] = np.einsum("ij,jk,ik->i", x, np.linalg.inv(p), x)
            pending = pdf[now]
    return out, lev


@pytest.mark.parametrize("forgetting", [1.0, 0.9])
def test_rls_equals_day_loop(toy, forgetting):
    pdf, df = toy
    options = dict(alpha=20.0, forgetting=forgetting, prior_feature="a_prediction")
    want, lev = replayed(pdf, 20.0, forgetting)
    np.testing.assert_allclose(column(O.with_rls(df, XS, "p", **options), "p"), want)
    np.testing.assert_allclose(column(O.with_posterior_shrink(df, XS, {"p": 3.0}, **options), "p"), want / np.sqrt(1 + 3.0 * lev))
    shrunk = O.with_risk_shrink(df, XS, [2.0], ["all"], **options)
    x = pdf[XS].to_numpy()
    rel = np.clip(x.std(axis=1) / np.maximum(np.abs(x).mean(axis=1), 1e-8), 0, 5)
    multiplier = 1 + rel + np.clip(np.abs(want), 0, 5) + np.clip(np.log1p(pdf.weight.to_numpy()), 0, 5)
    np.testing.assert_allclose(column(shrunk, "risk_rls_all_s2_prediction"), want / np.sqrt(1 + 2.0 * lev * multiplier))


@pytest.mark.parametrize("rank_error", [0.05, 0.005])
def test_sketched_thresholds_keep_their_rank_error(spark, rank_error):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"fold": [f"f{k}" for k in rng.integers(0, 4, 40_000)], "v": np.round(rng.standard_cauchy(40_000), 2), "w": rng.normal(size=40_000)})
    pdf.loc[pdf.fold == "f0", "w"] = np.nan
    pdf.loc[::11, "v"] = np.inf
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    folds = sorted(pdf.fold.unique())
    found = WF.sketched_thresholds_before(spark.createDataFrame(pdf), folds, {"v": F.col("v"), "w": F.col("w")}, probs, rank_error=rank_error)
    assert sorted(found) == folds[1:] and found["f1"]["w"] == [None] * len(probs)
    for f in folds[1:]:
        for c in "vw":
            x = pdf[(pdf.fold < f) & np.isfinite(pdf[c])][c].to_numpy()
            for p, q in zip(probs, found[f][c], strict=True):
                if len(x):
                    assert (x < q).mean() - 2 * rank_error <= p <= (x <= q).mean() + 2 * rank_error


def test_sketches_make_no_copies_of_rows(toy, monkeypatch):
    pdf, df = toy

    def copies(*_):
        raise AssertionError("rows were copied for later folds")

    monkeypatch.setattr(WF, "calibration_copies", copies)
    found = WF.wf_residual_tail(df, XS[0], XS[1], quantile=0.8, modes=["weight"], rank_error=0.01)
    thresholds = {r["fold"]: r["weight"] for r in found.parameters}
    folds = sorted(pdf.fold.unique())
    assert sorted(thresholds) == folds[1:]
    for f, t in thresholds.items():
        past = pdf[pdf.fold < f].weight
        assert (past < t).mean() - 0.02 <= 0.8 <= (past <= t).mean() + 0.02
    for r in found.rows.toPandas().itertuples():
        taken = r.fold in thresholds and r.weight >= thresholds[r.fold]
        assert getattr(r, f"{XS[0]}_residual_weight_tail_prediction") == pytest.approx(getattr(r, XS[1] if taken else XS[0]))


def test_grid_equals_scored_predictions(toy):
    pdf, df = toy
    grid = {"all": O.Candidate(tuple(XS), 2.0), "first": O.Candidate((XS[0],), 5.0), "strong": O.Candidate(tuple(reversed(XS)), 50.0)}
    got = {(r["candidate"], r["forgetting"], r["fold"]): r for r in O.rls_grid(df, grid, [1.0, 0.9], prior_feature=XS[0]).collect()}
    assert len(got) == len(grid) * 2 * pdf.fold.nunique()
    for name, c in grid.items():
        for f in (1.0, 0.9) if name == "all" else (0.9,):
            scored = M.fold_scores(O.with_rls(df, list(c.features), "p", alpha=c.alpha, forgetting=f, prior_feature=XS[0]), "p")
            for r in scored.collect():
                found = got[name, f, r["fold"]]
                for k in ("rows", "weight_sum", "numerator", "denominator", M.R2):
                    assert found[k] == pytest.approx(r[k], rel=1e-9)
                dates = sorted(pdf[pdf.fold == r["fold"]].date_id.unique())
                assert found["days"] == len(dates) and found["update_source_date"] == (dates[-2] if len(dates) > 1 else None)


def test_grid_leaves_out_unusable_rows(spark, toy):
    _, df = toy
    grid = {"all": O.Candidate(tuple(XS), 2.0)}
    odd = df.withColumn(XS[0], F.when(F.col("symbol_id") == 0, F.lit(None)).otherwise(F.col(XS[0])))
    want = O.rls_grid(df.where("symbol_id != 0"), grid, [0.9]).orderBy("fold").collect()
    assert O.rls_grid(odd, grid, [0.9]).orderBy("fold").collect() == want
    for bad in ({}, {"a": O.Candidate((), 1.0)}, {"a": O.Candidate(tuple(XS), 0.0)}):
        with pytest.raises(ValueError):
            O.rls_grid(df, bad, [0.9])
    with pytest.raises(ValueError):
        O.rls_grid(df, grid, [1.5])


def test_rls_audit_is_strictly_past(toy):
    _, df = toy
    audit = M.causality_audit(O.day_audit(O.rls_states(df, XS, alpha=1.0))).first()
    assert (audit.audit_rows, audit.bad_updates, audit.all_strictly_past) == (20, 0, True)


def test_affine_matches_normal_equations(toy):
    pdf, df = toy
    got = column(O.with_daily_affine(df, "a_prediction", "p", prior=4.0, forgetting=0.9), "p")
    want = np.empty(len(pdf))
    for f in sorted(pdf.fold.unique()):
        lhs, rhs = 4.0 * np.eye(2), np.array([0.0, 4.0])
        for d in sorted(pdf[pdf.fold == f].date_id.unique()):
            now = ((pdf.fold == f) & (pdf.date_id == d)).to_numpy()
            bias, scale = np.linalg.solve(lhs, rhs)
            x, y, w = (pdf.loc[now, c].to_numpy() for c in ("a_prediction", "responder_6", "weight"))
            want[now] = bias + np.clip(scale, 0, 2) * x
            z = np.column_stack([np.ones_like(x), x])
            lhs, rhs = 0.9 * lhs + z.T @ (z * w[:, None]), 0.9 * rhs + z.T @ (w * y)
    np.testing.assert_allclose(got, want)


def test_online_state_ignores_the_same_day(toy):
    _, df = toy
    changed = df.withColumn("responder_6", F.when(F.col("date_id") == 10, F.lit(50.0)).otherwise(F.col("responder_6")))
    for build in (lambda d: O.with_loss_selector(d, {"a": XS[0], "b": XS[1]}, default="a", decay=0.5, output="p"), lambda d: O.with_daily_scale(d, XS[0], "p", prior=1.0, forgetting=0.9)):
        a, b = build(df).where("date_id <= 10"), build(changed).where("date_id <= 10")
        np.testing.assert_array_equal(column(a, "p"), column(b, "p"))


def test_nested_selection_rules(spark):
    rows = [(f, c, n, 1.0, 1 - n) for f, ns in (("f1", (0.5, 0.9)), ("f2", (0.9, 0.1)), ("f3", (0.2, 0.3))) for c, n in zip("ab", ns)]
    scores = spark.createDataFrame(rows, "fold string, candidate_id string, numerator double, denominator double, weighted_zero_mean_r2 double")
    got = {r.fold: (r.candidate_id, r.history_folds) for r in selection.nested_select(scores, first="b").collect()}
    assert got == {"f1": ("b", 0), "f2": ("a", 1), "f3": ("b", 2)}
    with pytest.raises(ValueError):
        selection.nested_select(scores, first="b", metric="best")


# --------------------------------------------------------------------------- screens


def views_of(train, valid):
    """The nine views in numpy."""
    fill = np.nanmean(train)
    t, v = np.where(np.isnan(train), fill, train), np.where(np.isnan(valid), fill, valid)
    m, s = t.mean(), t.std()
    lo, hi = np.quantile(t, [0.05, 0.95])
    rank = pd.Series(t).rank(method="average").to_numpy() - 1
    pairs = {
        "z": lambda x: (x - m) / s, "sign": np.sign, "abs_z": lambda x: np.abs((x - m) / s), "square_z": lambda x: ((x - m) / s) ** 2,
        "positive_indicator": lambda x: (x > 0) * 1.0, "top05_indicator": lambda x: (x >= hi) * 1.0, "bottom05_indicator": lambda x: (x <= lo) * 1.0,
        "signed_tail05": lambda x: (x >= hi) * 1.0 - (x <= lo) * 1.0,
    }
    out = {n: (f(t), f(v)) for n, f in pairs.items()}
    out["rank"] = (rank / (len(t) - 1) - 0.5, np.searchsorted(np.sort(t), v, side="right") / len(t) - 0.5)
    return out


def information(x, y, bins=10):
    def codes(v):
        e = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
        return np.searchsorted(e, v, side="right")

    a, b = codes(x), codes(y)
    if a.max() == 0 or b.max() == 0:
        return 0.0
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    p = t / t.sum()
    q = p.sum(1, keepdims=True) @ p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())


def test_univariate_screen_matches_numpy(toy):
    pdf, df = toy
    got = {(r.feature, r.transform): r for r in screens.univariate_screen(screens.split_frame(df, 14), ["feature_00", "feature_01"]).collect()}
    train, valid = pdf[pdf.date_id < 14], pdf[pdf.date_id >= 14]
    assert len(got) == 18
    for f in ("feature_00", "feature_01"):
        for name, (pt, pv) in views_of(train[f].to_numpy(), valid[f].to_numpy()).items():
            r, (yt, wt, yv, wv) = got[f, name], (train.responder_6.to_numpy(), train.weight.to_numpy(), valid.responder_6.to_numpy(), valid.weight.to_numpy())
            alpha = (wt * pt * yt).sum() / (wt * pt * pt).sum()
            assert r.alpha == pytest.approx(alpha), (f, name)
            assert r.valid_r2 == pytest.approx(1 - (wv * (yv - alpha * pv) ** 2).sum() / (wv * yv**2).sum()), (f, name)
            c = np.cov(pv, yv, aweights=wv, ddof=0)
            assert r.valid_corr == pytest.approx(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1])), (f, name)
            lo, hi = np.quantile(pt, [0.05, 0.95])
            assert r.train_tail_low_mean == pytest.approx(np.average(yt[pt <= lo], weights=wt[pt <= lo])), (f, name)
            assert r.train_tail_high_mean == pytest.approx(np.average(yt[pt >= hi], weights=wt[pt >= hi])), (f, name)
            assert r.train_binned_mi == pytest.approx(information(pt, yt)), (f, name)
            assert r.valid_binned_mi == pytest.approx(information(pv, yv)), (f, name)


def test_univariate_screen_reads_ties_and_odd_rows_without_a_row_per_view(toy, monkeypatch):
    """Few values, empty ones and rows that don't count; nothing is expanded by view."""

    def expanded(*_, **__):
        raise AssertionError("rows are expanded by view")

    monkeypatch.setattr(screens, "transform_views", expanded)
    pdf, df = toy
    coarse = F.when(F.col("symbol_id") != 4, F.round("feature_00", 0))
    odd = df.withColumns({"feature_00": coarse, "weight": F.when(F.col("time_id") * 6 + F.col("symbol_id") != 7, F.col("weight"))})
    got = {r.transform: r for r in screens.univariate_screen(screens.split_frame(odd, 14), ["feature_00"]).collect()}
    pdf = pdf.assign(feature_00=np.where(pdf.symbol_id != 4, np.round(pdf.feature_00), np.nan), counts=pdf.time_id * 6 + pdf.symbol_id != 7)
    train, valid = pdf[pdf.date_id < 14], pdf[pdf.date_id >= 14]
    for name, phis in views_of(train.feature_00.to_numpy(), valid.feature_00.to_numpy()).items():
        r = got[name]
        (kt, pt), (kv, pv) = ((part.counts.to_numpy(), phi) for part, phi in zip((train, valid), phis, strict=True))
        y, w = train.responder_6.to_numpy(), train.weight.to_numpy()
        assert r.alpha == pytest.approx((w * pt * y)[kt].sum() / (w * pt * pt)[kt].sum()), name
        for split, part, phi, k in (("train", train, pt, kt), ("valid", valid, pv, kv)):
            y, w = part.responder_6.to_numpy(), part.weight.to_numpy()
            assert r[f"{split}_binned_mi"] == pytest.approx(information(phi, y)), (name, split)
            lo, hi = np.quantile(phi, [0.05, 0.95])
            assert r[f"{split}_tail_low_mean"] == pytest.approx(np.average(y[k & (phi <= lo)], weights=w[k & (phi <= lo)])), (name, split)
            assert r[f"{split}_tail_high_mean"] == pytest.approx(np.average(y[k & (phi >= hi)], weights=w[k & (phi >= hi)])), (name, split)


@pytest.mark.parametrize("max_values", [3, 200_000])
def test_order_statistics_of_many_columns(spark, max_values):
    """Ties, missing values, an empty column and cells cut into blocks."""
    from panelkit.operators.core import order_statistics

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.random(3000) < 0.3, "a": rng.normal(size=3000), "b": rng.integers(0, 4, 3000).astype(float)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("e", F.lit(None).cast("double"))
    probs = [0.0, 0.05, 0.5, 0.77, 1.0]
    got = order_statistics(df, {c: F.col(c) for c in "abe"}, probs, "g", max_values=max_values)
    for g, part in pdf.groupby("g"):
        for c in "ab":
            v = part[c].dropna().to_numpy()
            low, high = (np.quantile(v, probs, method=m) for m in ("lower", "higher"))
            assert [q[0] for q in got[g][c]] == low.tolist() and all(q[1] == h or q[2] == 0 for q, h in zip(got[g][c], high, strict=True))
            assert [lo + (hi - lo) * s for lo, hi, s in got[g][c]] == pytest.approx(np.quantile(v, probs))
        assert got[g]["e"] == [None] * 5


def test_interactions_match_numpy(toy):
    pdf, df = toy
    got = {r.interaction: r for r in screens.interaction_screen(screens.split_frame(df, 14), ["feature_00", "feature_01"]).collect()}
    train, valid = pdf[pdf.date_id < 14], pdf[pdf.date_id >= 14]
    a, b = (views_of(train[f].to_numpy(), valid[f].to_numpy()) for f in ("feature_00", "feature_01"))
    combos = {
        "sign_product": ("sign", lambda x, y: x * y), "rank_diff": ("rank", lambda x, y: x - y), "z_diff": ("z", lambda x, y: x - y),
        "abs_z_diff": ("z", lambda x, y: abs(x - y)), "z_product": ("z", lambda x, y: x * y), "rank_product": ("rank", lambda x, y: x * y),
    }
    for name, (view, f) in combos.items():
        pt, pv = f(a[view][0], b[view][0]), f(a[view][1], b[view][1])
        alpha = (train.weight * pt * train.responder_6).sum() / (train.weight * pt * pt).sum()
        r2 = 1 - (valid.weight * (valid.responder_6 - alpha * pv) ** 2).sum() / (valid.weight * valid.responder_6**2).sum()
        assert (got[name].alpha, got[name].valid_r2) == pytest.approx((alpha, r2)), name


@pytest.mark.parametrize("kind", screens.NULL_KINDS)
def test_null_targets_permute(toy, kind):
    from panelkit.operators.sampling import row_index

    pdf, df = toy
    n = len(pdf)
    moved = screens.null_targets(row_index(df, KEYS, "i"), kind, seed=3, rows=n, block_size=50).toPandas().sort_values("i")
    assert moved.i.tolist() == list(range(n))
    np.testing.assert_allclose(np.sort(moved.null_y), np.sort(pdf.responder_6))
    assert not np.allclose(moved.null_y, pdf.responder_6)
    if kind == "date":
        days = {tuple(np.round(g.responder_6, 9)) for _, g in pdf.groupby("date_id")}
        assert {tuple(np.round(c, 9)) for c in np.split(moved.null_y.to_numpy(), 20)} == days


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 100, 101, 4097, 100_000])
def test_bijection(n):
    from panelkit.operators.sampling import bijection

    x = np.arange(n)
    a, b = bijection(x, n, 1), bijection(x, n, 2)
    assert sorted(a) == sorted(b) == list(range(n))
    np.testing.assert_array_equal(bijection(x[::3], n, 1), a[::3])  # each image by itself
    if n > 50:
        assert (a != b).mean() > 0.9 and (a != x).mean() > 0.9 and abs(np.corrcoef(x, a)[0, 1]) < 0.35
        assert abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.35


def arrays(pdf, features):
    """Values, z-scores and ranks of train and validation rows, as in views_of, side by side."""
    train, valid = pdf[pdf.date_id < 14], pdf[pdf.date_id >= 14]
    views = {f: views_of(train[f].to_numpy(), valid[f].to_numpy()) for f in features}
    return train, valid, views


@pytest.mark.parametrize("pairs", [False, True])
def test_null_screen_against_numpy(toy, pairs):
    pdf, df = toy
    features = ["feature_00", "feature_01", "a_prediction"]
    df = screens.split_frame(df, 14)
    runs = 2
    got = {(r.null_kind, r.run): r for r in screens.null_screen(df, features, pairs=pairs, runs=runs, block_size=50).collect()}
    assert set(got) == {(k, i) for k in screens.NULL_KINDS for i in range(runs)}
    slots = [(k * runs + run, kind, 17 + 1000 * run + k) for k, kind in enumerate(screens.NULL_KINDS) for run in range(runs)]
    ys = screens.with_null_targets(df, slots, block_size=50).select(*KEYS, "null_ys").toPandas()
    pdf = pdf.merge(ys, on=KEYS)
    train, valid, views = arrays(pdf, features)
    y = {name: np.stack(part.null_ys) for name, part in (("t", train), ("v", valid))}
    for name, part in (("t", train), ("v", valid)):
        for k in range(len(slots)):
            np.testing.assert_allclose(np.sort(y[name][:, k]), np.sort(part.responder_6))
    if pairs:
        combos = {"sign_product": ("sign", np.multiply), "rank_diff": ("rank", np.subtract), "z_diff": ("z", np.subtract), "abs_z_diff": ("z", lambda a, b: abs(a - b)), "z_product": ("z", np.multiply), "rank_product": ("rank", np.multiply)}
        phis = {(a, b, n): [f(views[a][v][s], views[b][v][s]) for s in (0, 1)] for i, a in enumerate(features) for b in features[i + 1 :] for n, (v, f) in combos.items()}
    else:
        phis = {(f, v): views[f][v] for f in features for v in screens.VIEWS}
    for k, kind, _ in slots:
        best = {}
        for name, (pt, pv) in phis.items():
            alpha = (train.weight * pt * y["t"][:, k]).sum() / (train.weight * pt * pt).sum()
            best[name] = 1 - (valid.weight * (y["v"][:, k] - alpha * pv) ** 2).sum() / (valid.weight * y["v"][:, k] ** 2).sum()
        row = got[kind, k % runs]
        assert row.best_valid_r2 == pytest.approx(max(best.values()))
        assert best[tuple(row)[3:]] == pytest.approx(row.best_valid_r2)


@pytest.mark.parametrize("pairs", [False, True])
def test_null_screen_shuffles_iid_targets_only_and_reads_the_others_as_runs(toy, monkeypatch, pairs):
    """Many stretches, files and rank cells give what one stretch gives; a feature of few values sends no ranks."""

    df = screens.split_frame(toy[1].withColumn("feature_02", F.floor("feature_00").cast("double")), 14)
    run = lambda: {(r.null_kind, r.run): r for r in screens.null_screen(df, ["feature_00", "feature_01", "feature_02"], pairs=pairs, runs=2, block_size=50).collect()}
    want, packed, sent = run(), screens.packed_nulls, []
    monkeypatch.setattr(screens, "packed_nulls", lambda rows, slots, *a, **b: sent.extend(s[1] for s in slots) or packed(rows, slots, *a, **b))
    monkeypatch.setattr(screens, "STRETCH", 64)
    monkeypatch.setattr(screens, "RANK_CELLS", 8)
    got = run()
    assert sent == ["iid", "iid"] and got.keys() == want.keys()
    for key, r in got.items():
        assert r.best_valid_r2 == pytest.approx(want[key].best_valid_r2) and tuple(r)[3:] == tuple(want[key])[3:], key


def test_layout_reads_runs_across_files(toy):
    from panelkit.operators.layout import lay_out

    pdf, df = toy
    laid = lay_out(df.withColumn("__s", (F.col("date_id") >= 14).cast("int")), ["weight", "feature_00"], "responder_6", split="__s", stretch_rows=50)
    pdf = pdf.sort_values(KEYS)
    for which, part in ((0, pdf[pdf.date_id < 14]), (1, pdf[pdf.date_id >= 14])):
        n = len(part)
        assert laid.sizes[which] == n and len(laid.names[which]) > 1
        np.testing.assert_array_equal(laid.rows(which, 3, n - 2), part[["weight", "feature_00"]].to_numpy()[3 : n - 2])
        runs = screens._moved_runs("block", 5, n, 16)
        assert runs[:, 2].sum() == n and runs[0, 0] == 0 and (np.diff(runs[:, 0]) == runs[:-1, 2]).all()
        with laid.targets(which) as targets:
            moved = np.concatenate([part.responder_6.to_numpy()[i : i + m] for _, i, m in runs])
            np.testing.assert_array_equal(targets.gather(runs, 7, n - 9), moved[7 : n - 9])


def test_like_features_make_no_view(spark, toy):
    _, df = toy
    twin = screens.split_frame(df.withColumn("feature_02", F.col("feature_00")), 14)
    got = {r.interaction: r for r in screens.interaction_screen(twin, ["feature_00", "feature_02"]).collect()}
    assert all(got[k].alpha == 0 and got[k].valid_r2 == 0 for k in ("rank_diff", "z_diff", "abs_z_diff"))


def test_interactions_of_many_features_are_one_small_plan(spark, toy):
    _, df = toy
    wide = screens.split_frame(df.select("*", *[(F.col("feature_00") * k + F.col("a_prediction")).alias(f"feature_{k + 10}") for k in range(20)]), 14)
    names = [f"feature_{k + 10}" for k in range(20)]
    assert screens.interaction_screen(wide, names).count() == 190 * 6


def test_spectrum_periodogram_hill(toy):
    pdf, df = toy
    found = screens.correlation_spectrum(df, ["a_prediction", "feature_00", "feature_01"])
    x = pdf[["a_prediction", "feature_00", "feature_01"]]
    x = x.fillna(x.mean()).to_numpy()
    filled = pdf[["a_prediction", "feature_00", "feature_01"]]
    scale = filled.std(ddof=0).to_numpy()
    z = (x - x.mean(0)) / scale
    np.testing.assert_allclose(found["eigenvalues"], np.linalg.eigvalsh(z.T @ z / (len(z) - 1)))
    assert found["lambda_plus"] == pytest.approx((1 + np.sqrt(3 / 360)) ** 2)
    peaks = screens.periodogram(df, top_k=2).where("symbol_id = 0").orderBy(F.desc("power")).collect()
    daily = pdf[pdf.symbol_id == 0].groupby("date_id").responder_6.mean().to_numpy()
    power = np.abs(np.fft.rfft(daily - daily.mean())) ** 2 / len(daily)
    power[0] = 0
    assert [p.frequency_index for p in peaks] == list(np.argsort(-power)[:2])
    top = np.sort(np.abs(pdf.responder_6))[-21:]
    assert screens.hill_table(df, 20).first()[0] == pytest.approx(20 / np.log(top[1:] / top[0]).sum())
    with pytest.raises(ValueError):
        screens.acf(df, [0])


# --------------------------------------------------------------------------- experts


def test_ridge_matches_direct_fit(toy):
    pdf, df = toy
    features = ["feature_00", "feature_01"]
    model = E.RidgeData.fit(df, features).solve(7.0)
    x = pdf[features].fillna(0.0).to_numpy()
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    w, y = pdf.weight.to_numpy(), pdf.responder_6.to_numpy()
    beta = np.linalg.solve(z.T @ (z * w[:, None]) + np.diag([0, 7.0, 7.0]), z.T @ (w * y))
    np.testing.assert_allclose(column(df.withColumn("p", model.predict()), "p"), z @ beta)


def test_rank_encoder_matches_numpy(toy):
    pdf, df = toy
    out = E.RankEncoder.fit(df, ["feature_00", "feature_01"], 20).transform(df)
    for c in ("feature_00", "feature_01"):
        x = pdf[c].to_numpy()
        fin = x[~np.isnan(x)]
        edges = np.unique(np.quantile(fin, np.linspace(0, 1, 21)[1:-1]))
        code = np.searchsorted(edges, np.where(np.isnan(x), np.median(fin), x), side="right")
        np.testing.assert_allclose(column(out, f"{c}__rank"), (2 * (code + 0.5) / (len(edges) + 1) - 1).astype(np.float32), rtol=1e-6)


def test_pls_equals_nipals():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 5)), rng.normal(size=80)
    x, y = x - x.mean(0), y - y.mean()
    for k in (1, 2, 4):
        r, weights, loads, inner = x.copy(), [], [], []
        for _ in range(k):
            w = r.T @ y
            w /= np.linalg.norm(w)
            t = r @ w
            p = r.T @ t / (t @ t)
            weights.append(w), loads.append(p), inner.append(y @ t / (t @ t))
            r = r - np.outer(t, p)
        w, p = np.column_stack(weights), np.column_stack(loads)
        np.testing.assert_allclose(E.pls_coefficients(x.T @ x, x.T @ y, k), w @ np.linalg.solve(p.T @ w, inner), rtol=1e-8)


def test_pipeline_and_latent_models(toy):
    _, df = toy
    plan = folds.rolling_folds(0, 19, n_folds=2, train_window=10, valid_window=5)
    out = E.expert_pipeline(df, plan, ["feature_00", "feature_01"], ridge_alpha=1.0, pls_components=1, bins=20, residual_features=["feature_00"], regime_rows=5, time_bucket_size=2)
    names = E.pipeline_candidates(out)
    assert len(names) == 6 and out.count() == 180
    scores, fitted, table = studies.latent_models(screens.split_frame(df, 14), ["feature_00", "feature_01"], components=(1, 2))
    assert len(scores) == 7 and table.count() == 360 and all(len(b) == 3 for b in fitted.values())
    # with all components PLS is unweighted least squares
    t = table.toPandas()
    train = t[t.is_train]
    z = np.column_stack([np.ones(len(train)), train[["rank_feature_00", "rank_feature_01"]].to_numpy()])
    np.testing.assert_allclose(fitted["pls_rank_k2"], np.linalg.lstsq(z, train.responder_6.to_numpy(), rcond=None)[0], rtol=1e-6)


@pytest.mark.parametrize("keep, gain", [(0.0, 1.0), (0.3, 0.7), (0.9, 1.0), (0.995, 0.005), (1.0, 1.0)])
def test_decayed_states_of_many_days(spark, keep, gain):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"fold": np.repeat(["a", "b"], [10_000, 300]), "date_id": np.r_[np.arange(10_000) * 2, np.arange(300)], "v": rng.normal(size=10_300) * 10.0 ** rng.integers(-3, 4, 10_300)})
    df = spark.createDataFrame(pdf).repartition(4)
    start = F.when(F.col("fold") == "a", 3.0).otherwise(-5.0)
    got = O.with_decayed(df, {"s": (F.col("v"), start), "t": (F.abs("v"), F.lit(1.0))}, keep, gain).toPandas().sort_values(["fold", "date_id"])
    assert list(got.columns) == ["fold", "date_id", "v", "s", "t"]
    for name, value, begin in (("s", pdf.v, {"a": 3.0, "b": -5.0}), ("t", pdf.v.abs(), {"a": 1.0, "b": 1.0})):
        want = []
        for fold in "ab":
            s = begin[fold]
            for v in value[pdf.fold == fold]:
                want.append(s)
                s = keep * s + gain * v
        np.testing.assert_allclose(got[name], want, rtol=1e-9, atol=1e-9 * np.abs(want).max())


def test_sweeps_equal_direct_solves():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12))
    g, r = x.T @ x + 5.0 * np.eye(12), x.T @ (x @ rng.normal(size=12) + rng.normal(size=400))
    seen = {}
    for bits, beta in WF.sweep_subsets(g, r, 2):
        inside = [0, 1, *[2 + j for j in range(10) if bits >> j & 1]]
        want = np.zeros(12)
        want[inside] = np.linalg.solve(g[np.ix_(inside, inside)], r[inside])
        np.testing.assert_allclose(beta, want, rtol=1e-8, atol=1e-10)
        seen[bits] = True
    assert len(seen) == 1024


def enumerated_simplex(g, r):
    import itertools

    best = (np.inf, None)
    for size in range(1, len(r) + 1):
        for s in map(list, itertools.combinations(range(len(r)), size)):
            system = np.ones((size + 1, size + 1))
            system[:size, :size], system[size, size] = g[np.ix_(s, s)], 0.0
            w = np.linalg.lstsq(system, np.append(r[s], 1.0), rcond=None)[0][:size]
            if w.min() >= -1e-9:
                full = np.zeros(len(r))
                full[s] = np.clip(w, 0, None) / np.clip(w, 0, None).sum()
                best = min(best, (full @ g @ full - 2 * full @ r, tuple(full)))
    return best


@pytest.mark.parametrize("k", [1, 2, 3, 5, 10])
def test_simplex_weights_against_enumeration(k):
    from panelkit.operators.blend import simplex_weights
    from panelkit.operators.stats import Normal

    rng = np.random.default_rng(k)
    for trial in range(40 if k < 10 else 8):
        x = rng.normal(size=(60, k)) + rng.normal(size=(60, 1)) * (trial % 3)
        if trial % 4 == 1 and k > 2:
            x[:, 1] = x[:, 0]  # twins
        y = x @ rng.normal(size=k) * 0.4 + rng.normal(size=60)
        g, r = x.T @ x, x.T @ y
        w = simplex_weights(Normal(g, r))
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        least = enumerated_simplex(g, r)[0]
        assert w @ g @ w - 2 * w @ r <= least + 1e-8 * abs(least)


def test_simplex_weights_of_many_experts():
    from panelkit.operators.blend import simplex_weights
    from panelkit.operators.stats import Normal

    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 60))
    y = x[:, :7] @ np.full(7, 1 / 7) + 0.1 * rng.normal(size=500)
    g, r = x.T @ x, x.T @ y
    w = simplex_weights(Normal(g, r))
    slope = g @ w - r
    assert (slope >= slope[w > 0].max() - 1e-6).all() and slope[w > 0].std() < 1e-6  # no exchange of weight lowers the loss


@pytest.mark.parametrize("block", [5, 64])
def test_periodogram_in_blocks(toy, block):
    pdf, df = toy
    got = screens.periodogram(df, top_k=4, order=["date_id", "time_id"], block=block, dates_per_part=3).toPandas()
    for s, rows in pdf.sort_values(["date_id", "time_id"]).groupby("symbol_id"):
        x = rows.responder_6.to_numpy()
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x)
        power[0] = 0
        mine = got[got.symbol_id == s].sort_values("power", ascending=False)
        best = np.argsort(-power)[:4]
        assert mine.frequency_index.tolist() == best.tolist()
        np.testing.assert_allclose(mine.power, power[best])
        np.testing.assert_allclose(mine.power_share, power[best] / power.sum())
        np.testing.assert_allclose(mine.period_rows, len(x) / best)


def test_packed_nulls_carry_the_null_targets(spark, toy, monkeypatch):
    """Every stretch gets the targets that the plain positions give, for all kinds."""

    monkeypatch.setattr(screens, "STRETCH", 64)
    df = screens.split_frame(toy[1], 14)
    rows, sizes = screens._split_positions(df)
    slots = [(k, kind, 5 + k) for k, kind in enumerate(screens.NULL_KINDS)]
    want = {(r["__s"], r["slot"], r["p"]): r["null_y"] for r in screens.null_positions(rows, slots, sizes, split="__s", block_size=32).collect()}
    got = {}
    for r in screens.packed_nulls(rows, slots, sizes, split="__s", block_size=32).collect():
        for at, y in zip(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["y"]), strict=True):
            got[r["__s"], r["slot"], r["stretch"] * 64 + int(at)] = y
    assert got == want and len(got) == 4 * 360


def test_typical_evidence_holds_when_sums_change_between_reads(spark):
    """Sums of doubles differ in their last bits from read to read, here by a random part of 1e-12."""
    import random

    from panelkit.operators import calibrate

    jitter = F.udf(lambda e: e * (1.0 + 1e-12 * random.SystemRandom().random()), "double")
    names = ["rw_01", "rw_02", "rw_03", "rw_04"]
    rows = spark.createDataFrame([(f, g, float(1 + g * g)) for f in names for g in range(16)], "fold string, g int, e double")
    evidence = jitter("e")
    for _ in range(3):
        found = WF._typical_before(rows, names, lambda fold: {"g": F.col("g")}, evidence)
        assert [found[f] for f in names] == pytest.approx([0.0, *[k * (1 + 49 + 1 + 64) / 2 for k in (1, 2, 3)]], rel=1e-9)
        assert calibrate._typical(rows, ["g"], evidence) == pytest.approx(4 * (1 + 49 + 1 + 64) / 2, rel=1e-9)


def test_periodogram_reads_blocks_once_and_adds_up_stretches(toy, monkeypatch):
    """Blocks of a series are no groups of their own, and what they send is read once; a long series is several stretches."""

    monkeypatch.setattr(screens, "FOURIER_BLOCK", 16)
    pdf, df = toy
    found = screens.periodogram(df, top_k=3, order=["date_id", "time_id"], block=5, dates_per_part=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan
    got = found.toPandas()
    for s, rows in pdf.sort_values(["date_id", "time_id"]).groupby("symbol_id"):
        x = rows.responder_6.to_numpy()
        power = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2 / len(x)
        best = np.argsort(-power)[:3]
        mine = got[got.symbol_id == s].sort_values("power", ascending=False)
        assert mine.frequency_index.tolist() == (best + 1).tolist()
        np.testing.assert_allclose(mine.power_share, power[best] / power.sum())


def test_xs_screen_ranks_values_not_rows(toy):
    """No window runs over the rows of a group; groups cut into blocks of values, and missing values, change nothing."""

    pdf, df = toy
    split = screens.split_frame(df, 12)
    groupings = {"date": ["date_id"], "all": ["fold"]}
    whole, cut = (screens.xs_screen(split, ["feature_00", "feature_01"], groupings, block_rows=b) for b in (5_000_000, 10))
    assert "rank(" not in whole._jdf.queryExecution().optimizedPlan().toString()
    got, same = (t.toPandas().sort_values(["feature", "grouping", "transform"]).reset_index(drop=True) for t in (whole, cut))
    np.testing.assert_allclose(got[["alpha", "valid_r2", "valid_corr"]], same[["alpha", "valid_r2", "valid_corr"]], rtol=1e-9, atol=1e-12)
    train = pdf.date_id < 12
    for r in got.itertuples():
        g = pdf.groupby([train, groupings[r.grouping][0]])[r.feature]
        if r.transform == "cs_z":
            phi = g.transform(lambda v: (v - v.mean()) / v.std()).fillna(0)
        else:
            phi = g.transform(lambda v: (v.rank() - 1) / (len(v) - 1) - 0.5).fillna(0)
        t, v = pdf[train], pdf[~train]
        a = (t.weight * phi[train] * t.responder_6).sum() / (t.weight * phi[train] ** 2).sum()
        assert r.alpha == pytest.approx(a)
        assert r.valid_r2 == pytest.approx(1 - (v.weight * (v.responder_6 - a * phi[~train]) ** 2).sum() / (v.weight * v.responder_6**2).sum())


def test_boosted_trees_fit_bins_not_rows(toy, monkeypatch):
    """The fit gets one row for equal bins, and predicts what Spark's trees on all rows predict."""

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    seen = []

    class Counted(GBTRegressor):
        def fit(self, data):
            seen.append(data.count())
            return super().fit(data)

    monkeypatch.setattr(E, "GBTRegressor", Counted)
    df = toy[1].withColumn("feature_00", F.round("feature_00", 2))
    rows = df.unionByName(df.withColumns({"symbol_id": F.col("symbol_id") + 6, "responder_6": F.col("responder_6") + F.col("feature_00")}))
    train, valid, features = rows.where("date_id < 14"), rows.where("date_id >= 14"), ["feature_00", "feature_01"]
    got = E.gbt_expert(train, valid, features, seeds=[17])
    assert len(seen) == 1 and seen[0] <= train.count() / 2
    x = VectorAssembler(inputCols=["f0", "f1"], outputCol="x")
    train, valid = (x.transform(t.withColumns({"f0": F.col("feature_00"), "f1": F.coalesce("feature_01", F.lit(0.0))})) for t in (train, valid))
    plain = GBTRegressor(featuresCol="x", labelCol="responder_6", weightCol="weight", maxIter=20, maxDepth=3, stepSize=0.1, seed=17).fit(train).transform(valid)
    keys = ["date_id", "time_id", "symbol_id"]
    both = got.select(*keys, "gbt_prediction").toPandas().merge(plain.select(*keys, "prediction").toPandas(), on=keys)
    assert len(both) == valid.count()
    np.testing.assert_allclose(both.gbt_prediction, both.prediction, rtol=1e-9)
