"""Every catalogued query runs on the small tables; the oracle ones equal DuckDB."""

import os

import duckdb
import pytest

from catalog import ORACLE, QUERIES
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
FAST = (
    "lag_join fold_summary xs_context rolling_variation shrinkage wf_convex wf_regime_scale loss_selector modulo_screen acf nested_select global_rank_bucket scan_panel scan_tags scan_fold_scores "
    "scan_summaries report_category union_vertical xs_screen interaction_screen periodogram periodogram_rows grouped_simplex sequence_window online_daily_affine dynamic_scale dynamic_rls rls_risk_shrink "
    "wf_static_ridge wf_alpha_stack wf_ridge_stack linear_stacker shrinkage_grid wf_residual_tail stream_tumbling rls_validation_grid"
).split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_registry_is_described():
    assert len(QUERIES) > 150 and set(ORACLE) <= set(QUERIES)
    assert all(q.__doc__ for q in QUERIES.values())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
