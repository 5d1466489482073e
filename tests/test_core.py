"""Order statistics, ranks, look-back windows and EWMs against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelkit.operators import core


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    heavy = np.concatenate([rng.normal(size=3000), np.full(2500, 0.25), rng.standard_cauchy(500) * 1e4])
    pdf = pd.DataFrame({"g": np.where(np.arange(6000) % 3 == 0, "a", "b"), "v": rng.permutation(heavy), "w": rng.integers(0, 7, 6000).astype(float)})
    return pdf, spark.createDataFrame(pdf).persist()


PROBS = [0.0, 0.05, 1 / 3, 0.5, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("max_values", [200_000, 40])
@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_exact_quantiles(values, max_values, interpolation):
    pdf, df = values
    found = core.exact_quantiles(df, {"v": F.col("v"), "w": F.col("w")}, PROBS, by="g", interpolation=interpolation, max_values=max_values)
    for g, part in pdf.groupby("g"):
        for c in "vw":
            x = np.sort(part[c].to_numpy())
            if interpolation == "linear":
                np.testing.assert_allclose(found[g][c], np.quantile(x, PROBS), rtol=1e-12)
            else:
                want = [x[int(np.floor(p * (len(x) - 1) + 0.5))] for p in PROBS]
                assert found[g][c] == want


def test_quantiles_of_many_groups_collect_little(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.arange(60_000) % 20, "v": rng.normal(size=60_000)})
    df = spark.createDataFrame(pdf)
    probs = [0.1, 0.3, 0.5, 0.7, 0.9]
    sizes, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    found = core.exact_quantiles(df, {"v": F.col("v")}, probs, by="g")
    assert max(sizes) <= 20 * len(probs) * 2
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(found[g]["v"], np.quantile(part.v, probs), rtol=1e-12)


def test_quantiles_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert core.exact_quantiles(df, {"v": F.col("v")}, [0.5], by="g") == {None: {"v": [2.0]}, "a": {"v": [5.0]}}


def test_quantiles_ignore_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert core.quantile(df, F.col("v"), [0.5]) == [2.0]
    with pytest.raises(ValueError):
        core.quantile(df.where("v > 10 and v < 11"), F.col("v"), [0.5])


@pytest.mark.parametrize("block_rows", [5_000_000, 100])
def test_average_rank(values, block_rows):
    pdf, df = values
    for keys in (["g"], []):
        got = core.with_average_rank(df, keys, "v", "r", block_rows=block_rows).toPandas()
        want = got.groupby("g").v.rank("average") if keys else got.v.rank(method="average")
        assert len(got) == len(pdf)
        np.testing.assert_array_equal(got.r, want)


def test_rank_of_null_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), (None, 5.0)], "g string, v double")
    got = {(r.g, r.v): r.r for r in core.with_average_rank(df, ["g"], "v", "r").collect()}
    assert got == {("a", 1.0): 1.0, ("a", None): None, ("a", 2.0): 2.0, (None, 5.0): 1.0}


def test_halo_equals_plain_window(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"s": rng.integers(0, 3, 400), "d": np.arange(400) // 7, "t": np.arange(400) % 7, "v": rng.normal(size=400)})
    pdf = pdf[rng.random(400) < 0.6]  # sparse blocks
    df = spark.createDataFrame(pdf)
    plain = df.withColumn("x", F.sum("v").over(Window.partitionBy("s").orderBy("d", "t").rowsBetween(-5, 0)))
    cut = core.with_halo(df, ["s"], ["d", "t"], F.floor(F.col("d") / 2), 5)
    inner = Window.partitionBy("s", "__block").orderBy("d", "t").rowsBetween(-5, 0)
    blocked = cut.withColumn("x", F.sum("v").over(inner)).where("not __halo").select(*plain.columns)
    a, b = (t.toPandas().sort_values(["s", "d", "t"]).reset_index(drop=True) for t in (plain, blocked))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("span", [1, 2, 64])
def test_ewm_long_path(spark, span):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"d": 0, "s": np.repeat([0, 1], 4000), "t": np.tile(np.arange(4000), 2), "v": rng.normal(size=8000) + 5})
    got = core.with_ewm(spark.createDataFrame(pdf), [(F.col("v"), span, "e")], ["d", "s"], ["t"]).toPandas().sort_values(["s", "t"])
    want = pdf.groupby("s").v.transform(lambda x: x.ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(got.e.to_numpy(), want.to_numpy(), rtol=1e-12)


def test_group_stats_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "k int, v double")
    got = sorted((r.k or 0, r.v, r.m) for r in core.with_group_stats(df, ["k"], {"m": F.avg("v")}).collect())
    assert got == [(0, 1.0, 2.0), (0, 3.0, 2.0), (1, 5.0, 5.0)]

def test_quantiles_send_no_rows_to_the_task_of_their_group(spark, monkeypatch):
    """Joins of rows with cut points are broadcasts, also where a session broadcasts nothing by itself."""

    plans, join = [], core.join_groups

    def seen(*args, **kwargs):
        out = join(*args, **kwargs)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(core, "join_groups", seen)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(1000).selectExpr("id % 2 AS g", "cast(id AS double) AS v")
        got = core.exact_quantiles(df, {"v": F.col("v")}, [0.25, 0.5], by="g")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {0: {"v": [249.5, 499.0]}, 1: {"v": [250.5, 500.0]}}
    assert plans and not any("SortMergeJoin" in p for p in plans)


def test_cells_of_values_are_compiled_comparisons(spark):
    rows = spark.createDataFrame([(v, [1.0, 1.0, 2.5, 4.0]) for v in (0.5, 1.0, 1.5, 2.5, 3.0, 4.0, 9.0)], "v double, cuts array<double>")
    out = rows.select("v", core.cell_of("v", "cuts", 4).alias("cell"))
    assert [r.cell for r in out.orderBy("v").collect()] == [0, 0, 2, 2, 3, 3, 4]
    assert "lambda" not in out._jdf.queryExecution().toString()
