"""Panels derived from the shared tables."""

import os

import pytest
from pyspark.sql import functions as F

from panelkit.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_oof_takes_one_shuffle_and_equals_the_join(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    panel = fx.panel(spark, SF)
    joined = "WITH " + fx.EXPERTS_CTE.replace("FROM panel", "FROM {panel}").replace("LEFT JOIN panel", "LEFT JOIN {panel}") + " SELECT * FROM oof"
    want, got = spark.sql(joined, panel=panel), fx.oof(spark, SF)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    plan = spark.sql("WITH " + fx.ONE_PASS_CTE.replace("FROM panel", "FROM {panel}") + " SELECT * FROM oof", panel=panel)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0]


def test_the_panel_lies_in_buckets_that_grow_with_the_items_and_needs_no_shuffle_along_dates(spark, tmp_path, monkeypatch):
    days = ["1996-01-03", "1996-01-30", "1996-02-10", "1996-03-05", "1996-05-01", None]
    rows = [(day, line, supp, 3.0 + k, 100.25 * (k + 1), 0.05, 0.02, "R" if k % 2 else "N") for k, day in enumerate(days) for line in (1, 2, None) for supp in (1, 2, 9, None)]
    schema = "l_shipdate string, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    items = spark.createDataFrame(rows, schema).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    monkeypatch.setattr(fx, "BUCKET_ROWS", 5)
    for name, some, buckets in (("some", items, 15), ("none", items.limit(0), 8)):
        some.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        panel, oof = fx.panel(spark, f"{tmp_path}/{name}"), fx.oof(spark, f"{tmp_path}/{name}")
        want = spark.sql(fx.PANEL_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=some)
        assert panel.count() == want.count() and panel.exceptAll(want).isEmpty()
        experts = spark.sql("WITH " + fx.ONE_PASS_CTE.replace("FROM panel", "FROM {panel}") + " SELECT * FROM oof", panel=want)
        assert oof.count() == experts.count() and oof.exceptAll(experts).isEmpty()
        in_buckets = fx.panel_in_buckets(spark, f"{tmp_path}/{name}")
        groups = in_buckets.groupBy("time_id", "symbol_id").count()
        # a row in a wrong bucket would give its group twice
        assert groups.count() == want.select("time_id", "symbol_id").distinct().count()
        plan = groups._jdf.queryExecution().executedPlan().toString()
        assert f"SelectedBucketsCount: {buckets} out of {buckets}" in plan
        again = spark.sql("WITH " + fx.ONE_PASS_CTE.replace("FROM panel", "FROM {panel}") + " SELECT * FROM oof", panel=in_buckets)
        assert "hashpartitioning" not in again._jdf.queryExecution().executedPlan().toString()
        # members of a union are grouped over all of them
        twice = panel.select("time_id", "symbol_id").unionByName(panel.select("time_id", "symbol_id")).groupBy("time_id", "symbol_id").count()
        assert twice.count() == groups.count()
