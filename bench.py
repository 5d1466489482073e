"""Headline queries timed end to end; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (comma list, or ``all``),
BENCH_REPEAT (runs per query, median reported). The derived panels are written as Parquet before the clock starts;
every run scans them again.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from catalog import QUERIES
from panelkit.session import build_session
from panelkit.sources.fixtures import event_panel, oof, panel

HEADLINE = (
    "fold_summary slice_r2 gram feature_profile date_profile clock_quality lag_join daily_last_lag symbol_graph_join sequence_window "
    "w_ewm rolling_variation operational_time xs_context xs_raw_modes xs_expert_expansion global_rank_bucket quantile_bucket4 shrinkage grouped_convex_blend eb_scale "
    "wf_convex wf_grouped_blend wf_residual_tail wf_regime_scale wf_context_blend dynamic_rls loss_selector modulo_screen acf univariate_fit"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    for derived in (panel, oof, event_panel):
        derived(spark, sf_dir)
    QUERIES["fold_score"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm
    seconds: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name], first[name] = round(statistics.median(runs), 3), round(runs[0], 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "first_runs": first, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
