"""Operators against literal numbers, closed forms and causality."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit import schema
from panelkit.functions import scalar as S
from panelkit.operators import blend, calibrate, folds, gates, graph, lags, metrics, paths, sampling, stats
from panelkit.operators import xsection as X
from panelkit.sources import io

KEYS = ["date_id", "time_id", "symbol_id"]


def keyed(df, *columns):
    return {(r.date_id, r.time_id, r.symbol_id): tuple(r[c] for c in columns) for r in df.collect()}


def test_lag_join(spark):
    rows = [(d, 0, s, 10.0 * d + s, 100.0 * d + s) for d in (4, 5) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "date_id int, time_id int, symbol_id int, responder_0 double, responder_1 double")
    got = keyed(lags.with_lags(df, ["responder_0", "responder_1"]), "responder_0_lag_1", "responder_1_lag_1")
    assert got[5, 0, 2] == (42.0, 402.0) and got[4, 0, 2] == (None, None)
    assert len(got) == 6
    assert keyed(lags.gateway_lags(df, 5, ["responder_0"]), "responder_0_lag_1")[5, 0, 3] == (43.0,)
    with pytest.raises(ValueError):
        lags.with_lags(df, ["responder_0"], 0)


def test_missing_date_gives_null(spark):
    df = spark.createDataFrame([(1, 0, 1, 1.0), (3, 0, 1, 3.0)], "date_id int, time_id int, symbol_id int, responder_6 double")
    assert keyed(lags.with_lags(df, ["responder_6"]), "responder_6_lag_1")[3, 0, 1] == (None,)


def test_daily_last(spark):
    df = spark.createDataFrame([(1, 0, 1, 5.0), (1, 9, 1, 7.0), (2, 0, 1, 1.0)], "date_id int, time_id int, symbol_id int, responder_6 double")
    assert keyed(lags.with_daily_last_lags(df, ["responder_6"]), "responder_6_daily_last_lag_1")[2, 0, 1] == (7.0,)


def test_graph_features(spark):
    df = spark.createDataFrame([(1, 0, 1, 10.0), (1, 0, 2, 14.0), (1, 1, 1, 20.0), (1, 1, 2, 23.0)], "date_id int, time_id int, symbol_id int, feature_00 double")
    got = keyed(graph.with_neighbor_features(df, graph.edge_frame(spark, {1: [2], 2: [1]}), ["feature_00"]), "feature_00_sg_neighbor_mean", "feature_00_sg_deviation")
    assert got == {(1, 0, 1): (14.0, -4.0), (1, 0, 2): (10.0, 4.0), (1, 1, 1): (23.0, -3.0), (1, 1, 2): (20.0, 3.0)}


def test_graph_counts_absent_neighbours(spark):
    df = spark.createDataFrame([(1, 0, 1, 10.0)], "date_id int, time_id int, symbol_id int, feature_00 double")
    out = graph.with_neighbor_features(df, graph.edge_frame(spark, {1: [7]}), ["feature_00"])
    assert keyed(out, "symbol_graph_neighbor_count", "feature_00_sg_neighbor_mean", "feature_00_sg_deviation") == {(1, 0, 1): (1, 0.0, 10.0)}


def test_tags(spark, tmp_path):
    path = tmp_path / "features.csv"
    path.write_text("feature,tag_0,tag_1\nfeature_00,true,false\nfeature_01,true,true\nfeature_99,false,true\n")
    assert io.scan_tags(spark, str(path), ["feature_00", "feature_01"], min_features=2) == {"0": ("feature_00", "feature_01")}
    df = spark.createDataFrame([(1, 0, 1, 1.0, 2.0), (1, 0, 2, 3.0, 4.0)], "date_id int, time_id int, symbol_id int, feature_00 double, feature_01 double")
    got = keyed(X.tag_state(df, {"0": ["feature_00", "feature_01"]}), "tag_0_market_loo", "tag_0_deviation")
    assert got == {(1, 0, 1): (3.5, -2.0), (1, 0, 2): (1.5, 2.0)}


def test_fold_rules():
    f = folds.rolling_folds(0, 82, n_folds=5, train_window=30, valid_window=10)
    assert (f[0].train_start, f[0].train_end, f[0].valid_start, f[-1].valid_end) == (3, 32, 33, 82)
    e = folds.expanding_folds(0, 20, n_folds=2, valid_window=5, gap=1)
    assert [(x.name, x.train_start, x.train_end, x.valid_start, x.valid_end) for x in e] == [("wf_01", 0, 9, 11, 15), ("wf_02", 0, 14, 16, 20)]
    t = folds.tail_folds(0, 30, n_folds=1, train_window=5, selection_window=4, valid_window=3, gap=1)[0]
    assert (t.train_start, t.train_end, t.selection_start, t.selection_end, t.valid_start) == (17, 21, 23, 26, 28)
    for bad in (dict(n_folds=0, train_window=3, valid_window=3), dict(n_folds=9, train_window=30, valid_window=10), dict(n_folds=1, train_window=3, valid_window=3, gap=-1)):
        with pytest.raises(ValueError):
            folds.rolling_folds(0, 82, **bad)


def test_weighted_r2_checks(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, -1.0, -1.0)], "weight double, responder_6 double, prediction double")
    assert metrics.weighted_r2(df) == pytest.approx(1 - 1 / 3)
    bad = df.unionByName(spark.createDataFrame([(1.0, float("nan"), 0.0)], df.schema))
    with pytest.raises(ValueError):
        metrics.weighted_r2(bad)
    assert metrics.weighted_r2(bad, on_invalid="drop") == pytest.approx(1 - 1 / 3)
    with pytest.raises(ValueError):
        metrics.weighted_r2(df.withColumn("responder_6", F.lit(0.0)))


def test_summary_of_components(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1.0, 4.0, 0.75), ("b", 1, 1.0, 2.0, 6.0, 2 / 3)], "fold string, rows long, weight_sum double, numerator double, denominator double, weighted_zero_mean_r2 double")
    assert metrics.summarize(df).first()["global_r2"] == pytest.approx(0.7)


def test_row_index_is_dense(spark):
    rng = np.random.default_rng(0)
    rows = sorted({(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 9, (300, 3))})
    df = spark.createDataFrame(rows, "date_id int, time_id int, symbol_id int")
    got = sampling.row_index(df, KEYS).orderBy(*KEYS).toPandas()
    assert got.row_index.tolist() == list(range(len(rows)))


def test_sample_plan(spark):
    df = spark.range(1000).selectExpr("cast(id as int) date_id", "0 time_id", "0 symbol_id", "cast(id as double) weight")
    plan = sampling.plan_sample(df, 200, policy="weight_tail", tail_quantile=0.9)
    assert plan.threshold == 899.0 and plan.tail_bps == 10_000 and plan.rest_bps == 1102
    kept = df.where(plan.predicate(17))
    assert kept.where("weight >= 899").count() == 101
    assert kept.count() < 300
    assert sampling.plan_sample(df, 5000).rest_bps == 10_000
    assert df.where(sampling.plan_sample(df, 50, policy="weight_tail").predicate(1)).where("weight < 899").count() == 0


def test_blend_recovers_a_perfect_side(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0, 1.0), (2.0, 2.0, 5.0, 2.0), (3.0, 3.0, -1.0, 1.0)], "responder_6 double, left double, right double, weight double")
    assert blend.fit_convex(df, "left", "right") == 1.0
    assert blend.fit_simplex(df, ["left", "right"]) == {"left": 1.0, "right": 0.0}


def test_simplex_beats_a_grid(toy):
    pdf, df = toy
    cols = ["a_prediction", "b_prediction", "feature_00"]
    w = np.array(list(blend.fit_simplex(df, cols).values()))
    x, y, sw = pdf[cols].to_numpy(), pdf.responder_6.to_numpy(), pdf.weight.to_numpy()

    def loss(v):
        return float((sw * (y - x @ v) ** 2).sum())

    assert w.min() >= 0 and w.sum() == pytest.approx(1.0)
    grid = [np.array([i, j, 20 - i - j]) / 20 for i, j in itertools.product(range(21), repeat=2) if i + j <= 20]
    assert loss(w) <= min(map(loss, grid)) + 1e-9


def test_grouped_simplex_matches_each_group(toy):
    _, df = toy
    cols = ["a_prediction", "b_prediction"]
    model = blend.fit_grouped_simplex(df, ["time_id"], cols, min_rows=10)
    for r in model.parameters.collect():
        want = blend.fit_simplex(df.where(F.col("time_id") == r.time_id), cols)
        assert (r.w_a_prediction, r.w_b_prediction) == pytest.approx((want["a_prediction"], want["b_prediction"]))


def test_shrinkage_falls_back(toy):
    _, df = toy
    model = calibrate.fit_shrinkage(df.where("symbol_id < 3"), ["symbol_id"], prediction="a_prediction", min_rows=10)
    out = model.apply(df, "a_prediction").where("symbol_id = 5").select((F.col("calibrated_prediction") / F.col("a_prediction")).alias("r")).toPandas()
    np.testing.assert_allclose(out.r, model.model.fallback)
    with pytest.raises(ValueError):
        calibrate.fit_shrinkage(df, min_rows=0)
    with pytest.raises(ValueError):
        calibrate.fit_shrinkage(df.where("false"), prediction="a_prediction")


def test_tail_policy_validation(toy):
    _, df = toy
    with pytest.raises(ValueError):
        gates.fit_tail_advantage(df, ["symbol_id"], base="a_prediction", candidate="b_prediction")
    with pytest.raises(ValueError):
        gates.tail_switch("a_prediction", "b_prediction", [])
    empty = gates.fit_tail_advantage(df.withColumn("weight_bucket", F.lit("q00_q50")), ["symbol_id"], base="a_prediction", candidate="b_prediction")
    assert empty.default is False and empty.table.count() == 0


def test_select_strategy_needs_a_margin(spark):
    scores = spark.createDataFrame([("base", 0.10), ("x", 0.11), ("y", 0.109)], "candidate string, weighted_zero_mean_r2 double")
    assert gates.select_strategy(scores, "base", ["x", "y"], 0.005) == "x"
    assert gates.select_strategy(scores, "base", ["x", "y"], 0.02) == "base"


def same_normal(a, b):
    for x, y in ((a.g, b.g), (a.r, b.r), (a.yy, b.yy), (a.weight_sum, b.weight_sum), (a.rows, b.rows)):
        np.testing.assert_allclose(np.asarray(x, float), np.asarray(y, float))


def odd_rows(spark, where, odd, width):
    rng = np.random.default_rng(6)
    names = [f"feature_{i:02d}" for i in range(width)]
    rows = [dict(zip(["fold", "weight", "responder_6", *names], [f"f{k % 3}", *rng.uniform(1, 2, width + 2).tolist()], strict=True)) for k in range(60)]
    for row in rows[::10]:
        row[where] = odd
        row["feature_01"] = None
    return names, spark.createDataFrame(rows, f"fold string, weight double, responder_6 double, {', '.join(f'{c} double' for c in names)}").repartition(3)


@pytest.mark.parametrize("fill", [False, True])
@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_gram_is_the_same_on_both_paths(spark, monkeypatch, odd, fill):
    for where in ("responder_6", "weight", "feature_02"):
        names, df = odd_rows(spark, where, odd, 4)
        narrow = stats.normal_stats_by(df, names, "fold", fill=fill)
        with monkeypatch.context() as m:
            m.setattr(stats, "MAX_GENERATED", 2)
            wide = stats.normal_stats_by(df, names, "fold", fill=fill)
            whole = stats.normal_stats(df, names, fill=fill)
        assert narrow.keys() == wide.keys() == {"f0", "f1", "f2"}
        for fold in narrow:
            same_normal(wide[fold], narrow[fold])
        same_normal(whole, sum(narrow.values(), stats.Normal.zeros(4)))


@pytest.mark.parametrize("width", [41, 79])
def test_wide_gram_with_null_and_nan(spark, width):
    names, df = odd_rows(spark, "responder_6", None, width)
    table = df.toPandas()
    got = stats.normal_stats(df, names)
    ok = table.dropna(subset=["responder_6"])
    assert got.yy == pytest.approx((ok.weight * ok.responder_6**2).sum())
    assert got.r[0] == pytest.approx((ok.weight * ok.responder_6 * ok.feature_00).sum()) and np.isfinite(got.g).all()
    nan = stats.normal_stats(odd_rows(spark, "responder_6", float("nan"), width)[1], names)
    assert np.isnan(nan.yy) and np.isfinite(nan.g).all()


def test_wide_gram_of_no_rows(toy, monkeypatch):
    monkeypatch.setattr(stats, "MAX_GENERATED", 1)
    empty = stats.normal_stats(toy[1].limit(0), ["feature_00", "feature_01"])
    assert empty.rows == 0 and not empty.g.any()


def test_path_features_do_not_look_ahead(toy):
    _, df = toy
    short = df.where("time_id < 2")
    for build in (
        lambda d: paths.koopman_path(d, ["feature_01"], 4),
        lambda d: paths.ewm_bands(d, ["feature_00"], [2, 4]),
        lambda d: paths.rolling_variation(d, ["feature_01"], [2]),
        lambda d: paths.operational_time(d, ["feature_00", "feature_01"], [4]),
        lambda d: paths.reservoir(d, paths.Projection.gaussian(["feature_00"], n=1), [3]),
    ):
        full, cut = build(df), build(short)
        names = [c for c in cut.columns if c not in df.columns]
        assert keyed(full.where("time_id < 2"), *names) == keyed(cut, *names)


def test_presample_equals_window_then_filter(toy):
    _, df = toy
    keep = F.col("symbol_id") % 2 == 0
    out = X.presample_batch(df, ["feature_00"], keep)
    ref = X.context_features(df, ["feature_00"], ranked=["feature_00"], time_bucket_size=1).where(keep)
    a, b = keyed(out, "feature_00_batch_mean", "feature_00_batch_std"), keyed(ref, "feature_00", "feature_00_ctx_cs_z")
    assert a.keys() == b.keys()
    for k, (m, s) in a.items():
        assert (b[k][0] - m) / s == pytest.approx(b[k][1])


def test_raw_modes_reject_targets(toy):
    _, df = toy
    for bad in (["responder_6"], ["responder_0"]):
        with pytest.raises(ValueError):
            X.raw_modes(df, bad, ["batch_rank"])
    with pytest.raises(ValueError):
        X.raw_modes(df, ["feature_00"], ["nope"])


def test_name_rules(toy):
    _, df = toy
    assert schema.feature_columns(df) == ("feature_00", "feature_01")
    assert schema.expert_columns(df.withColumn("gateway_x_prediction", F.lit(0)), exclude=["a_prediction"]) == ("b_prediction",)
    assert schema.clean_prefix(" My run-1 ") == "my_run_1"
    for f in (lambda: schema.clean_prefix("--"), lambda: schema.require_known(["x"], ["y"]), lambda: schema.parse_positive_ints("4,2", ascending=True), lambda: schema.parse_positive_ints("0")):
        with pytest.raises(ValueError):
            f()


def test_scalar_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (None,)], "x double")
    got = [r[0] for r in df.select(S.tercile_code("x", 0.0, 0.5)).collect()]
    assert got == [0, 1, 2, 1]
    codes = [r[0] for r in spark.createDataFrame([(-5,), (3,), (9,), (None,)], "x int").select(S.category_code("x", 0, 5)).collect()]
    assert codes == [6, 3, 6, 6]
    with pytest.raises(ValueError):
        S.clip_abs("x", 0.0)


def test_union_widest(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1.5, "k")], "x double, z string")
    got = io.union_widest([a, b]).collect()
    assert [(r.x, r.y, r.z) for r in got] == [(1.0, 2, None), (1.5, None, "k")]


def test_fold_score_files(spark, tmp_path):
    header = "fold,candidate,family,rows,weight_sum,numerator,denominator,weighted_zero_mean_r2\n"
    (tmp_path / "a.csv").write_text(header + "f1,c,fam,3,1.0,1.0,2.0,0.5\n")
    got = io.scan_fold_scores(spark, {"run": str(tmp_path / "a.csv")}).first()
    assert (got.candidate_id, got.source_family, got.rows) == ("run/c", "run/fam", 3)
    (tmp_path / "b.csv").write_text("fold,candidate\nf,c\n")
    with pytest.raises(ValueError):
        io.scan_fold_scores(spark, {"run": str(tmp_path / "b.csv")})


def test_summaries_skip_bad_files(spark, tmp_path):
    good = ",".join(io.SUMMARY_COLUMNS) + "\nc,f,3,1,1,2,0.5,0.4,0.1,0.5\n"
    (tmp_path / "good.csv").write_text(good)
    (tmp_path / "bad.csv").write_text("x\n1\n")
    paths_ = {"hist_run": str(tmp_path / "good.csv"), "smoke": str(tmp_path / "bad.csv"), "gone": str(tmp_path / "none.csv")}
    frame, skipped = io.scan_summaries(spark, paths_)
    assert frame.first()["category"] == "historical"
    assert {s["report"] for s in skipped} == {"smoke", "gone"}


def test_average_members_detects_lost_rows(toy):
    _, df = toy
    a = df.select("fold", *KEYS, F.col("a_prediction").alias("p"))
    with pytest.raises(ValueError):
        lags.average_members([a, a.where("symbol_id > 0")], "p")


def test_batch_ids_are_dense(toy):
    pdf, df = toy
    got = paths.batch_ids(df).toPandas()
    want = got.groupby(["date_id", "time_id"]).ngroup()
    assert (got.batch_id == want).all()


def test_sequence_window_matches_pandas(toy):
    pdf, df = toy
    got = paths.sequence_window(df, ["feature_00"], 4, dates_per_block=3).toPandas().sort_values(["symbol_id", "date_id", "time_id"])
    for _, part in got.groupby("symbol_id"):
        x = part.feature_00.to_numpy()
        padded = np.concatenate([np.zeros(3), x])
        want = np.stack([padded[i : i + 4] for i in range(len(x))])
        np.testing.assert_allclose(np.array([[v[0] for v in s] for s in part.sequence]), want)


def test_frame_has_expected_rows(toy):
    pdf, df = toy
    assert isinstance(pdf, pd.DataFrame) and df.count() == len(pdf) == 360


def test_nearest_symbols_over_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(1, 0, k, 1.0, *rng.normal(size=2).tolist()) for k in range(50)]
    rows[11] = (1, 0, 11, *rows[10][3:])  # equally far from all others
    df = spark.createDataFrame(rows, "date_id int, time_id int, symbol_id int, weight double, feature_00 double, feature_01 double")
    z = np.array([r[4:] for r in rows])
    z = (z - z.mean(0)) / z.std(0)
    want = {(a, b, r + 1) for a in range(50) for r, b in enumerate(sorted((i for i in range(50) if i != a), key=lambda i: (((z[a] - z[i]) ** 2).sum(), i))[:3])}
    for size in (7, 50):
        got = graph.nearest_symbols(df, ["feature_00", "feature_01"], start=0, end=5, n_neighbors=3, block_size=size)
        found = {(r["symbol_id"], r["neighbor_id"], r["rank"]) for r in got.collect()}
        assert found == want


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """15 rows (date 0..4, three each) as nested plain folders, as keys, and as keys below plain folders."""
    root = tmp_path_factory.mktemp("tree")
    df = spark.range(15).select((F.col("id") % 5).cast("int").alias("date_id"), F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    df.where("x < 3").coalesce(1).write.parquet(str(root / "plain"))
    df.where("x >= 3 and x < 9").coalesce(1).write.parquet(str(root / "plain" / "y2020" / "m1"))
    df.where("x >= 9").coalesce(1).write.parquet(str(root / "plain" / "y2021"))
    df.write.partitionBy("date_id").parquet(str(root / "keys"))
    df.where("x < 8").write.partitionBy("date_id").parquet(str(root / "both" / "a"))
    df.where("x >= 8").write.partitionBy("date_id").parquet(str(root / "both" / "b" / "c"))
    df.write.partitionBy("date_id").parquet(str(root / "mixed"))
    df.write.parquet(str(root / "mixed" / "more"))
    (root / "none").mkdir()
    return root


@pytest.mark.parametrize("kind", ["plain", "keys", "both"])
def test_scan_panel_reads_every_folder(spark, tree, kind):
    df = io.scan_panel(spark, str(tree / kind))
    assert sorted((r.date_id, r.x, r.y) for r in df.collect()) == [(d, x, 2 * x) for d in range(5) for x in range(d, 15, 5)]
    assert sorted((r.x for r in io.scan_panel(spark, f"file://{tree / kind}").where("date_id = 3").collect())) == [3, 8, 13]


@pytest.mark.parametrize("kind", ["keys", "both"])
def test_scan_panel_prunes(spark, tree, kind):
    plan = io.scan_panel(spark, str(tree / kind)).where("date_id = 3 and x > 5").select("x")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == (1 if kind == "keys" else 2)
    assert all("PartitionFilters: [isnotnull(date_id" in s and "GreaterThan(x,5)" in s and "ReadSchema: struct<x:bigint>" in s for s in scans)


def test_scan_panel_several_roots(spark, tree):
    assert io.scan_panel(spark, [str(tree / "plain" / "y2021"), str(tree / "plain" / "y2020")]).count() == 12


def test_scan_panel_rejects_mixed_and_empty_trees(spark, tree):
    with pytest.raises(ValueError, match="differ in their partition keys: date_id=, no key"):
        io.scan_panel(spark, str(tree / "mixed"))
    with pytest.raises(ValueError, match="no Parquet file"):
        io.scan_panel(spark, str(tree / "none"))


def test_summaries_list_values_that_are_no_numbers(spark, tmp_path):
    head = ",".join(io.SUMMARY_COLUMNS) + "\n"
    (tmp_path / "a.csv").write_text(head + "c,f,3,1,1,2,0.5,0.4,0.1,0.5\nd,f,,1,1,2,0.5,0.4,0.1,\n")
    (tmp_path / "b.csv").write_text(head + "c,f,many,1,1,2,0.5,x,0.1,0.5\n")
    frame, skipped = io.scan_summaries(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")})
    assert {(r.report, r.rows) for r in frame.collect()} == {("a", 3), ("a", None)}
    assert [s["reason"] for s in skipped] == ["bad_values:rows,min_fold_r2"]


def test_tags_keep_the_order_of_known_features(spark, tmp_path):
    (tmp_path / "t.csv").write_text("feature,tag_a,tag_b\nf1,true,false\nf2,true,true\nf3,true,true\nother,true,true\n")
    assert io.scan_tags(spark, str(tmp_path / "t.csv"), ["f3", "f1", "f2"], min_features=2) == {"a": ("f3", "f1", "f2"), "b": ("f3", "f2")}
    (tmp_path / "u.csv").write_text("name,tag_a\nf1,true\n")
    with pytest.raises(ValueError):
        io.scan_tags(spark, str(tmp_path / "u.csv"), ["f1"])
