"""Scans, projections, sampling, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import OOF, PANEL, oof, panel, query, table
from panelkit import schema
from panelkit.functions import scalar as S
from panelkit.operators import graph, lags, sampling
from panelkit.operators.core import with_group_stats
from panelkit.plans.selection import REPORT_CATEGORIES
from panelkit.session import new_folder
from panelkit.sources import fixtures as fx
from panelkit.sources import io

KEYS = list(schema.KEYS)
FEATURES = ["feature_00", "feature_01", "feature_02", "feature_03"]


# --------------------------------------------------------------------------- scans


@query(
    "scan_panel",
    """SELECT layout, l_returnflag, CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty
       FROM lineitem, (SELECT unnest(['keys', 'plain']) AS layout) WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_linenumber <= 3 GROUP BY 1, 2, 3""",
)
def scan_panel(spark, sf):
    """Nested trees of folders, with and without partition keys below plain ones, read with a pushed filter and few columns."""
    root, items = new_folder(spark, "trees"), table(spark, sf, "lineitem")
    for k in range(3):
        part = items.where(F.coalesce(F.pmod("l_orderkey", F.lit(3)), F.lit(0)) == k)
        part.write.partitionBy("l_linenumber").parquet(f"{root}/keys/part_{k}")
        part.write.parquet(f"{root}/plain/some/part_{k}")
    out = []
    for layout in ("keys", "plain"):
        rows = io.scan_panel(spark, f"{root}/{layout}").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")) & (F.col("l_linenumber") <= 3))
        counts = rows.groupBy("l_returnflag", F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("qty"))
        out.append(counts.withColumn("layout", F.lit(layout)))
    return io.union_all(out)


@query(
    "scan_tags",
    """SELECT tag, string_agg(feature, ',' ORDER BY feature) AS features FROM (
         SELECT p_brand AS feature, 'small' AS tag FROM part GROUP BY 1 HAVING min(p_size) <= 1
         UNION ALL SELECT p_brand, 'large' FROM part GROUP BY 1 HAVING max(p_size) >= 50
         UNION ALL SELECT p_brand, 'dear' FROM part GROUP BY 1 HAVING max(p_retailprice) > 1500)
       WHERE feature IN (SELECT p_brand FROM part WHERE p_size = 7) GROUP BY 1 HAVING count(*) >= 2""",
)
def scan_tags(spark, sf):
    """Tag matrix (brands as features) written as CSV and read to tag -> known features, in order of name."""
    path = f"{new_folder(spark, 'tags')}/matrix.csv"
    part = table(spark, sf, "part")
    matrix = part.groupBy(F.col("p_brand").alias("feature")).agg(
        (F.min("p_size") <= 1).alias("tag_small"), (F.max("p_size") >= 50).alias("tag_large"), (F.max("p_retailprice") > 1500).alias("tag_dear")
    )
    io.write_report(matrix, path)
    known = part.where("p_size = 7").select(F.col("p_brand").alias("feature")).distinct()
    return io.tag_map(io.read_tags(spark, path), known, min_features=2).select("tag", F.array_join("features", ",").alias("features"))


@query(
    "scan_fold_scores",
    f"""SELECT fold, 'base' AS candidate, 'run_a' AS source, 'run_a/base' AS candidate_id, 'run_a/naive' AS source_family,
          count(*) AS "rows", sum(weight * (responder_6-base_prediction)*(responder_6-base_prediction)) AS numerator FROM oof GROUP BY 1
        UNION ALL
        SELECT fold, 'trail', 'run_b', 'run_b/trail', 'run_b/naive',
          count(*), sum(weight * (responder_6-trail_prediction)*(responder_6-trail_prediction)) FROM oof GROUP BY 1 --d:numerator""",
    ctes=(PANEL, OOF), digits=3,
)
def scan_fold_scores(spark, sf):
    """Fold scores of two sources written as CSV, read and joined under their sources' names."""
    from panelkit.operators.metrics import candidate_scores

    df, root, sources = oof(spark, sf), new_folder(spark, "scores"), {}
    for source, name in (("run_a", "base"), ("run_b", "trail")):
        sources[source] = f"{root}/{source}.csv"
        io.write_report(candidate_scores(df, {name: f"{name}_prediction"}, family="naive"), sources[source])
    return io.scan_fold_scores(spark, sources).select("fold", "candidate", "source", "candidate_id", "source_family", "rows", "numerator")


def _summary_sql(report: str, category: str, where: str) -> str:
    return f"""SELECT p_brand AS candidate, p_type AS family, '{report}' AS report, '{category}' AS category, count(*) AS "rows", max(p_retailprice) AS global_r2, min(p_retailprice) AS min_fold_r2
      FROM part WHERE {where} GROUP BY 1, 2"""


SUMMARIES = {"hist_small": ("historical", "p_size <= 12"), "smoke_run": ("smoke", "p_size BETWEEN 13 AND 25"), "stage3_run": ("stage3", "p_size BETWEEN 26 AND 38"), "stride_8": ("sampled", "p_size BETWEEN 39 AND 44"), "last": ("other", "p_size > 44")}


@query(
    "scan_summaries",
    " UNION ALL ".join(_summary_sql(r, c, w) for r, (c, w) in SUMMARIES.items())
    + """ UNION ALL SELECT NULL, NULL, 'narrow', 'missing_columns:global_r2', NULL, NULL, NULL UNION ALL SELECT NULL, NULL, 'words', 'bad_values:rows', NULL, NULL, NULL --d:global_r2 min_fold_r2""",
)
def scan_summaries(spark, sf):
    """Summaries of several reports written as CSV and read with their category; unfit files are listed with the reason."""
    root, part, paths = new_folder(spark, "summaries"), table(spark, sf, "part"), {}
    for report, (_, where) in SUMMARIES.items():
        price = S.dbl("p_retailprice")
        numbers = {"weight_sum": F.sum(price), "numerator": F.sum(price), "denominator": F.sum(price), "mean_fold_r2": F.avg(price), "min_fold_r2": F.min(price), "std_fold_r2": F.lit(0.0), "global_r2": F.max(price)}
        summary = part.where(where).groupBy(F.col("p_brand").alias("candidate"), F.col("p_type").alias("family")).agg(F.count(F.lit(1)).alias("rows"), *[e.alias(c) for c, e in numbers.items()])
        paths[report] = f"{root}/{report}.csv"
        io.write_report(summary, paths[report])
    for report, odd in (("narrow", summary.drop("global_r2")), ("words", summary.withColumn("rows", F.lit("many")))):
        paths[report] = f"{root}/{report}.csv"
        io.write_report(odd, paths[report])
    found, skipped = io.scan_summaries(spark, paths)
    listed = spark.createDataFrame([(s["report"], s["reason"]) for s in skipped], "report string, category string")
    return io.union_widest([found.select("candidate", "family", "report", "category", "rows", "global_r2", "min_fold_r2"), listed])


@query("report_category",
       f"""SELECT category, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'historical' WHEN 1 THEN 'smoke' WHEN 2 THEN 'stage3' WHEN 3 THEN 'sampled' ELSE 'other' END AS category FROM part) GROUP BY 1""")
def report_category(spark, sf):
    """Report names, made of part names and a telling word, classified by substrings."""
    words = F.array(*[F.lit(w) for w in ("Max1398", "SMOKE", "stage3", "family_artifacts", "plain")])
    named = table(spark, sf, "part").select(F.concat_ws("_", "p_name", F.get(words, F.col("p_size") % 5), F.col("p_partkey").cast("string")).alias("report"))
    return named.groupBy(S.report_category("report", REPORT_CATEGORIES).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "schema_select",
    """SELECT count(o.feature_00) AS feature_00, count(o.feature_01) AS feature_01, count(o.feature_02) AS feature_02, count(o.feature_03) AS feature_03,
              count(q.responder_0) AS responder_0_lag_1, count(q.responder_6) AS responder_6_lag_1,
              count(o.base_prediction) AS base_prediction, count(o.trail_prediction) AS trail_prediction, count(o.linear_prediction) AS linear_prediction
       FROM oof o LEFT JOIN oof q ON q.date_id + 1 = o.date_id AND q.time_id = o.time_id AND q.symbol_id = o.symbol_id""",
    ctes=(PANEL, OOF),
)
def schema_select(spark, sf):
    """Features, lags and experts found by name conventions, aggregated."""
    df = lags.with_lags(oof(spark, sf), ["responder_0", "responder_6"])
    names = [*schema.feature_columns(df), *schema.lag_columns(df), *schema.expert_columns(df)]
    schema.reject_target_columns(names)
    return df.agg(*[F.count(c).alias(c) for c in names])


# --------------------------------------------------------------------------- projections and filters


@query("date_range_filter", f"SELECT count(*) AS n, min(date_id) AS lo, max(date_id) AS hi FROM panel WHERE date_id BETWEEN 33 AND 42", ctes=(PANEL,))
def date_range_filter(spark, sf):
    """Inclusive validation range of a rolling fold."""
    from panelkit.operators.folds import rolling_folds

    fold = rolling_folds(0, 82, n_folds=5, train_window=30, valid_window=10)[0]
    return panel(spark, sf).where(fold.valid_filter()).agg(F.count(F.lit(1)).alias("n"), F.min("date_id").alias("lo"), F.max("date_id").alias("hi"))


@query(
    "model_frame",
    "SELECT date_id, time_id, symbol_id, coalesce(feature_00, 0e0) AS feature_00, coalesce(feature_03, 0e0) AS feature_03, responder_6, weight FROM panel --d:feature_00 feature_03 responder_6 weight",
    ctes=(PANEL,),
)
def model_frame(spark, sf):
    """Null -> 0 features in double precision with target and weight."""
    return panel(spark, sf).select(*KEYS, *[S.filled(c).alias(c) for c in ("feature_00", "feature_03")], S.dbl("responder_6").alias("responder_6"), S.dbl("weight").alias("weight"))


@query(
    "bucket_filter",
    """SELECT weight_bucket, count(*) AS n FROM (SELECT CASE WHEN weight <= 25 THEN 'q00_q50' WHEN weight <= 50 THEN 'q50_q90'
         WHEN weight <= 75 THEN 'q90_q99' ELSE 'q99_q100' END AS weight_bucket FROM panel) WHERE weight_bucket IN ('q90_q99', 'q99_q100') GROUP BY 1""",
    ctes=(PANEL,),
)
def bucket_filter(spark, sf):
    """Tail-bucket rows."""
    from panelkit.operators.gates import TAIL_BUCKETS

    tagged = panel(spark, sf).select(S.quantile_bucket("weight", {"q50": 25, "q90": 50, "q99": 75}, S.WEIGHT_LABELS).alias("weight_bucket"))
    return tagged.where(F.col("weight_bucket").isin(list(TAIL_BUCKETS))).groupBy("weight_bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stride_sample",
    """SELECT fold, date_id, time_id, symbol_id FROM (
         SELECT *, row_number() OVER (ORDER BY fold, date_id, time_id, symbol_id) - 1 AS i FROM oof) WHERE i % 7 = 0""",
    ctes=(PANEL, OOF),
)
def stride_sample(spark, sf):
    """Every 7th row in key order."""
    return sampling.stride_sample(oof(spark, sf), 7).select("fold", *KEYS)


@query("grid_sample", "SELECT date_id, time_id, symbol_id FROM panel WHERE date_id % 3 = 0 AND time_id % 2 = 0", ctes=(PANEL,))
def grid_sample(spark, sf):
    """Rows on a date and time grid."""
    return sampling.grid_sample(panel(spark, sf), 3, 2).select(*KEYS)


@query("hash_sample")
def hash_sample(spark, sf):
    """Seeded key-hash sample of a quarter of the rows."""
    return sampling.hash_sample(panel(spark, sf), 0.25, seed=17).select(*KEYS)


@query("weight_tail_sample")
def weight_tail_sample(spark, sf):
    """Row budget spent on heavy rows first."""
    df = panel(spark, sf)
    return sampling.weight_tail_sample(df, df.count() // 4, tail_quantile=0.9).select(*KEYS, "weight")


@query("recent_days", "SELECT date_id, time_id, symbol_id FROM panel WHERE date_id > (SELECT max(date_id) FROM panel) - 12", ctes=(PANEL,))
def recent_days(spark, sf):
    """Rows of the last 12 dates."""
    return sampling.recent_days(panel(spark, sf), 12).select(*KEYS)


@query(
    "finite_guard",
    """SELECT date_id, time_id, symbol_id, CASE WHEN feature_03 IS NULL OR isnan(r) OR isinf(r) THEN 0e0 ELSE r END AS strict, coalesce(CASE WHEN isnan(r) THEN 0e0 ELSE r END, 0e0) AS loose
       FROM (SELECT *, CASE WHEN feature_01 = 0e0 THEN CAST('nan' AS DOUBLE) ELSE feature_03 / feature_01 END AS r FROM panel) --d:strict loose""",
    ctes=(PANEL,),
)
def finite_guard(spark, sf):
    """Null, NaN and infinity guards of both kinds."""
    r = F.when(F.col("feature_01") == 0, F.lit(float("nan"))).otherwise(F.col("feature_03") / F.when(F.col("feature_01") != 0, F.col("feature_01")))
    return panel(spark, sf).withColumn("r", r).select(*KEYS, S.finite_or_zero("r").alias("strict"), S.number_or_zero("r").alias("loose"))


# --------------------------------------------------------------------------- joins


@query(
    "lag_join",
    """SELECT p.date_id, p.time_id, p.symbol_id, q.responder_0 AS responder_0_lag_1, q.responder_6 AS responder_6_lag_1 FROM panel p
       LEFT JOIN panel q ON q.date_id + 1 = p.date_id AND q.time_id = p.time_id AND q.symbol_id = p.symbol_id --d:responder_0_lag_1 responder_6_lag_1""",
    ctes=(PANEL,),
)
def lag_join(spark, sf):
    """Previous-date values of the same time and symbol."""
    return lags.with_lags(panel(spark, sf), ["responder_0", "responder_6"]).select(*KEYS, "responder_0_lag_1", "responder_6_lag_1")


@query("gateway_lags", "SELECT 40 AS date_id, time_id, symbol_id, responder_6 AS responder_6_lag_1 FROM panel WHERE date_id = 39 --d:responder_6_lag_1", ctes=(PANEL,))
def gateway_lags(spark, sf):
    """Lag table served on date 40."""
    return lags.gateway_lags(panel(spark, sf), 40, ["responder_6"])


@query(
    "daily_last_lag",
    """SELECT p.date_id, p.time_id, p.symbol_id, q.v AS responder_6_daily_last_lag_1 FROM panel p LEFT JOIN (
         SELECT date_id + 1 AS date_id, symbol_id, arg_max(responder_6, time_id) AS v FROM panel GROUP BY 1, 2) q
       ON q.date_id = p.date_id AND q.symbol_id = p.symbol_id --d:responder_6_daily_last_lag_1""",
    ctes=(PANEL,),
)
def daily_last_lag(spark, sf):
    """Last value of the symbol's previous date."""
    return lags.with_daily_last_lags(panel(spark, sf), ["responder_6"]).select(*KEYS, "responder_6_daily_last_lag_1")


@query(
    "oof_join",
    "SELECT fold, date_id, time_id, symbol_id, weight, responder_6, base_prediction, trail_prediction AS tree_prediction FROM oof WHERE time_id < 5 AND symbol_id % 2 = 0 --d:weight responder_6 base_prediction tree_prediction",
    ctes=(PANEL, OOF),
)
def oof_join(spark, sf):
    """Inner join of two expert tables that cover different rows."""
    df = oof(spark, sf)
    left = df.where("time_id < 5").select("fold", *KEYS, "weight", "responder_6", "base_prediction")
    right = df.where("symbol_id % 2 = 0").select("fold", *KEYS, F.col("trail_prediction").alias("tree_prediction"))
    return lags.join_experts(left, [right])


@query(
    "extra_expert_prefix",
    "SELECT fold, date_id, time_id, symbol_id, trail_prediction AS my_run_1_trail_prediction, linear_prediction AS my_run_1_linear_prediction FROM oof --d:my_run_1_trail_prediction my_run_1_linear_prediction",
    ctes=(PANEL, OOF),
)
def extra_expert_prefix(spark, sf):
    """Extra experts under a cleaned prefix."""
    return lags.prefixed_experts(oof(spark, sf), " My run-1 ", ["trail_prediction", "linear_prediction"])


@query(
    "family_bridge_join",
    """SELECT a.fold, a.date_id, a.time_id, a.symbol_id, a.base_prediction, b.trail_prediction, c.linear_prediction FROM oof a
       JOIN (SELECT * FROM oof WHERE time_id <> 3) b USING (fold, date_id, time_id, symbol_id)
       JOIN (SELECT * FROM oof WHERE symbol_id > 10) c USING (fold, date_id, time_id, symbol_id) --d:base_prediction trail_prediction linear_prediction""",
    ctes=(PANEL, OOF),
)
def family_bridge_join(spark, sf):
    """Three-way inner join of expert families."""
    df = oof(spark, sf)
    parts = [df.where("time_id <> 3").select("fold", *KEYS, "trail_prediction"), df.where("symbol_id > 10").select("fold", *KEYS, "linear_prediction")]
    return lags.join_experts(df.select("fold", *KEYS, "base_prediction"), parts)


@query(
    "raw_enrich_join",
    "SELECT o.date_id, o.time_id, o.symbol_id, o.base_prediction, p.feature_01, p.feature_03 FROM oof o LEFT JOIN panel p ON p.date_id=o.date_id AND p.time_id=o.time_id AND p.symbol_id=o.symbol_id AND p.time_id < 6 --d:base_prediction feature_01 feature_03",
    ctes=(PANEL, OOF),
)
def raw_enrich_join(spark, sf):
    """Raw features attached by key, missing where the raw table has no row."""
    rows = oof(spark, sf).select(*KEYS, "base_prediction")
    return lags.enrich(rows, panel(spark, sf).where("time_id < 6"), ["feature_01", "feature_03"])


@query(
    "engine_merge",
    "SELECT fold, date_id, time_id, symbol_id, base_prediction AS engine_a_prediction, trail_prediction AS engine_b_prediction, linear_prediction AS engine_c_prediction FROM oof --d:engine_a_prediction engine_b_prediction engine_c_prediction",
    ctes=(PANEL, OOF),
)
def engine_merge(spark, sf):
    """Per-engine tables merged on the key."""
    df = oof(spark, sf)
    engines = [df.select("fold", *KEYS, F.col(c).alias(f"engine_{n}_prediction")) for n, c in zip("abc", fx.EXPERTS)]
    return lags.join_experts(engines[0], engines[1:])


@query(
    "seed_average",
    "SELECT fold, date_id, time_id, symbol_id, (base_prediction + trail_prediction + linear_prediction) / 3e0 AS prediction, CAST(3 AS BIGINT) AS members FROM oof --d:prediction",
    ctes=(PANEL, OOF),
)
def seed_average(spark, sf):
    """Mean of three members by union and aggregate."""
    df = oof(spark, sf)
    return lags.average_members([df.select("fold", *KEYS, F.col(c).alias("prediction")) for c in fx.EXPERTS], "prediction")


GRAPH_SQL = """
prof AS (SELECT n_nationkey AS symbol_id, w FROM nation JOIN (SELECT s_nationkey, count(*) AS w FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey),
npanel AS (SELECT date_id, time_id, s_nationkey AS symbol_id, sum(weight) AS weight, avg(feature_00) AS feature_00, avg(feature_01) AS feature_01,
             avg(responder_0) AS responder_0, avg(responder_6) AS responder_6 FROM panel JOIN supplier ON s_suppkey = symbol_id GROUP BY 1, 2, 3)
"""


def nation_panel(spark, sf):
    """The panel with nations as symbols (a small symbol set, as the graph needs)."""
    nations = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("symbol_id"), "s_nationkey")
    joined = panel(spark, sf).join(nations, "symbol_id").drop("symbol_id").withColumnRenamed("s_nationkey", "symbol_id")
    return joined.groupBy(*KEYS).agg(F.sum("weight").alias("weight"), *[F.avg(c).alias(c) for c in ("feature_00", "feature_01", "responder_0", "responder_6")])


def ring_edges(spark):
    """Each nation linked to the next two."""
    return graph.edge_frame(spark, {s: [(s + 1) % 25, (s + 2) % 25] for s in range(25)})


@query(
    "symbol_graph_join",
    """SELECT p.date_id, p.time_id, p.symbol_id, CAST(count(*) AS INT) AS symbol_graph_neighbor_count,
         CAST(CAST(coalesce(avg(n.feature_00), 0e0) AS FLOAT) AS DOUBLE) AS feature_00_sg_neighbor_mean,
         CAST(CAST(max(p.feature_00) AS FLOAT) - CAST(coalesce(avg(n.feature_00), 0e0) AS FLOAT) AS DOUBLE) AS feature_00_sg_deviation
       FROM npanel p JOIN (SELECT unnest([1, 2]) AS k) e ON true
       LEFT JOIN npanel n ON n.date_id = p.date_id AND n.time_id = p.time_id AND n.symbol_id = (p.symbol_id + e.k) % 25
       GROUP BY 1, 2, 3 --d:feature_00_sg_neighbor_mean feature_00_sg_deviation""",
    ctes=(PANEL, GRAPH_SQL), digits=4,
)
def symbol_graph_join(spark, sf):
    """Neighbour mean and deviation; absent neighbours count as edges."""
    out = graph.with_neighbor_features(nation_panel(spark, sf), ring_edges(spark), ["feature_00"])
    return out.select(*KEYS, "symbol_graph_neighbor_count", "feature_00_sg_neighbor_mean", "feature_00_sg_deviation")


@query(
    "knn_symbols",
    """SELECT symbol_id, neighbor_id, CAST(r AS INT) AS rank FROM (
         SELECT a.symbol_id, b.symbol_id AS neighbor_id, row_number() OVER (PARTITION BY a.symbol_id ORDER BY
           pow((a.x - b.x) / sx, 2) + pow((a.y - b.y) / sy, 2), b.symbol_id) AS r
         FROM (SELECT symbol_id, sum(weight*responder_0)/sum(weight) AS x, sum(weight*responder_6)/sum(weight) AS y FROM npanel WHERE date_id BETWEEN 0 AND 60 GROUP BY 1) a
         JOIN (SELECT symbol_id, sum(weight*responder_0)/sum(weight) AS x, sum(weight*responder_6)/sum(weight) AS y FROM npanel WHERE date_id BETWEEN 0 AND 60 GROUP BY 1) b
           ON a.symbol_id <> b.symbol_id
         CROSS JOIN (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM (
           SELECT symbol_id, sum(weight*responder_0)/sum(weight) AS x, sum(weight*responder_6)/sum(weight) AS y FROM npanel WHERE date_id BETWEEN 0 AND 60 GROUP BY 1)))
       WHERE r <= 3""",
    ctes=(PANEL, GRAPH_SQL),
)
def knn_symbols(spark, sf):
    """Three nearest nations by standardised weighted profile."""
    return graph.nearest_symbols(nation_panel(spark, sf), ["responder_0", "responder_6"], start=0, end=60, n_neighbors=3).select("symbol_id", "neighbor_id", "rank")


@query(
    "param_join",
    """SELECT o.date_id, o.time_id, o.symbol_id, coalesce(m.parameter, 0.5e0) * base_prediction AS scaled FROM oof o LEFT JOIN (
         SELECT symbol_id, CAST(count(*) AS DOUBLE) / 1000e0 AS parameter FROM oof WHERE symbol_id % 3 <> 0 GROUP BY 1) m ON m.symbol_id = o.symbol_id --d:scaled""",
    ctes=(PANEL, OOF),
)
def param_join(spark, sf):
    """Parameter table with a fallback for unseen groups."""
    from panelkit.operators.calibrate import GroupModel

    df = oof(spark, sf)
    table_ = df.where("symbol_id % 3 <> 0").groupBy("symbol_id").agg((F.count(F.lit(1)).cast("double") / 1000.0).alias("parameter"))
    return GroupModel(("symbol_id",), table_, 0.5).apply(df, lambda p: p * F.col("base_prediction"), "scaled").select(*KEYS, "scaled")


@query(
    "clock_value_join",
    """SELECT o.date_id, o.time_id, o.symbol_id, b.batch_weight_sum FROM oof o JOIN (SELECT date_id, time_id, CAST(sum(weight) AS FLOAT)::DOUBLE AS batch_weight_sum FROM panel GROUP BY 1, 2) b
       ON b.date_id = o.date_id AND b.time_id = o.time_id --d:batch_weight_sum""",
    ctes=(PANEL, OOF), digits=3,
)
def clock_value_join(spark, sf):
    """Clock inputs attached by key; a miss raises."""
    clocks = with_group_stats(panel(spark, sf).select(*KEYS, "weight"), ["date_id", "time_id"], {"batch_weight_sum": F.sum("weight").cast("float")})
    return lags.attach_required(oof(spark, sf).select(*KEYS), clocks, ["batch_weight_sum"])


@query(
    "batch_observability",
    """SELECT count(*) AS batches, min(batch_rows) AS batch_rows_min, max(batch_rows) AS batch_rows_max, 0e0 AS max_abs_diff, 0e0 AS mean_abs_diff
       FROM (SELECT date_id, time_id, count(*) AS batch_rows FROM panel GROUP BY 1, 2) --d:max_abs_diff mean_abs_diff""",
    ctes=(PANEL,),
)
def batch_observability(spark, sf):
    """Batch missingness recomputed and compared with the attached value."""
    from panelkit.operators.xsection import batch_missing

    df = panel(spark, sf)
    value = S.missing_count(["feature_02", "feature_03"]) / 2.0
    return lags.batch_observability(df, batch_missing(df, ["feature_02", "feature_03"]), value=value, column="batch_missing_frac")


# --------------------------------------------------------------------------- set operations


@query("union_vertical", "SELECT date_id, count(*) AS n FROM panel GROUP BY 1", ctes=(PANEL,))
def union_vertical(spark, sf):
    """Concatenation of the two halves of the panel."""
    df = panel(spark, sf)
    return io.union_all([df.where("date_id < 40"), df.where("date_id >= 40")]).groupBy("date_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_diagonal",
    "SELECT symbol_id, count(*) AS n, count(a) AS n_a, count(b) AS n_b FROM (SELECT symbol_id, feature_03 AS a, NULL AS b FROM panel WHERE date_id < 40 UNION ALL SELECT symbol_id, NULL, weight FROM panel WHERE date_id >= 40) GROUP BY 1",
    ctes=(PANEL,),
)
def union_diagonal(spark, sf):
    """Concatenation with different columns."""
    df = panel(spark, sf)
    parts = [df.where("date_id < 40").select("symbol_id", F.col("feature_03").alias("a")), df.where("date_id >= 40").select("symbol_id", F.col("weight").alias("b"))]
    return io.union_all(parts, allow_missing=True).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"))


@query("distinct_keys", "SELECT DISTINCT fold, date_id FROM oof", ctes=(PANEL, OOF))
def distinct_keys(spark, sf):
    """Fold and date pairs."""
    return oof(spark, sf).select("fold", "date_id").distinct()


@query(
    "list_parse",
    "SELECT date_id, time_id, symbol_id, " + ", ".join(f"{c} * {s} AS {c}_x{s}" for c in ("feature_00", "feature_02") for s in (2, 4, 8))
    + " FROM panel --d:" + " ".join(f"{c}_x{s}" for c in ("feature_00", "feature_02") for s in (2, 4, 8)),
    ctes=(PANEL,),
)
def list_parse(spark, sf):
    """Validated column and window lists drive a projection."""
    df = panel(spark, sf)
    columns = schema.require_known(schema.parse_columns("feature_00, feature_02"), schema.feature_columns(df))
    spans = schema.parse_positive_ints("2,4,8", at_least=2, ascending=True)
    return df.select(*KEYS, *[(F.col(c) * F.lit(s)).alias(f"{c}_x{s}") for c in columns for s in spans])
