"""Sinks and Structured Streaming queries. They work in the shared folder of the session."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from catalog.registry import OOF, PANEL, oof, panel, query
from panelkit.operators import metrics as M
from panelkit.session import new_folder
from panelkit.sources import fixtures as fx
from panelkit.sources import io
from panelkit.streaming import serving, state

KEYS = ["date_id", "time_id", "symbol_id"]
K = "date_id, time_id, symbol_id"
EXPERTS = list(fx.EXPERTS)


def work_dir(spark) -> str:
    return new_folder(spark, "panelkit")


# --------------------------------------------------------------------------- sinks


@query("sink_oof", f"SELECT fold, {K}, weight, base_prediction FROM oof --d:weight base_prediction", ctes=(PANEL, OOF))
def sink_oof(spark, sf):
    """Predictions written by fold and read back."""
    path = f"{work_dir(spark)}/oof"
    io.write_oof(oof(spark, sf).select("fold", *KEYS, "weight", "base_prediction"), path)
    return io.scan_partitioned(spark, path).select("fold", *KEYS, "weight", "base_prediction")


@query("scan_oof", f"SELECT fold, {K}, (base_prediction + trail_prediction) / 2e0 AS prediction, 2 AS members FROM oof --d:prediction", ctes=(PANEL, OOF))
def scan_oof(spark, sf):
    """Two written prediction tables checked for equal folds and averaged."""
    from panelkit.operators.lags import average_members

    root = work_dir(spark)
    for c in EXPERTS[:2]:
        io.write_oof(oof(spark, sf).select("fold", *KEYS, F.col(c).alias("prediction")), f"{root}/{c}")
    return average_members(io.scan_oof(spark, [f"{root}/{c}" for c in EXPERTS[:2]]), "prediction")


@query("sink_lag_cache", f"SELECT p.date_id, p.time_id, p.symbol_id, q.responder_6 AS responder_6_lag_1 FROM panel p LEFT JOIN panel q ON q.date_id + 1 = p.date_id AND q.time_id = p.time_id AND q.symbol_id = p.symbol_id --d:responder_6_lag_1", ctes=(PANEL,))
def sink_lag_cache(spark, sf):
    """Lag table written by date and read back."""
    path = f"{work_dir(spark)}/lags"
    io.write_lag_cache(panel(spark, sf), path, ["responder_6"])
    return io.scan_partitioned(spark, path).select(*KEYS, "responder_6_lag_1")


@query("sink_reports", 'SELECT fold, count(*) AS "rows" FROM oof GROUP BY 1', ctes=(PANEL, OOF))
def sink_reports(spark, sf):
    """Fold scores written as CSV and read back."""
    path = f"{work_dir(spark)}/report"
    io.write_report(M.fold_scores(oof(spark, sf), "base_prediction"), path)
    return spark.read.csv(path, header=True).select("fold", F.col("rows").cast("long").alias("rows"))


# --------------------------------------------------------------------------- streams


def protocol_rows(df):
    """Test rows and the lag rows each date delivers."""
    test = df.select(F.concat_ws("-", *KEYS).alias("row_id"), *KEYS, "weight", *EXPERTS, F.lit("test").alias("kind"), F.lit(None).cast("double").alias(serving.TARGET_LAG))
    lag = df.select(F.lit(None).cast("string").alias("row_id"), (F.col("date_id") + 1).alias("date_id"), "time_id", "symbol_id", *[F.lit(None).cast("double").alias(c) for c in ("weight", *EXPERTS)], F.lit("lag").alias("kind"), F.col("responder_6").alias(serving.TARGET_LAG))
    return test.unionByName(lag)


def feed(spark, rows, root: str, cuts: list[int]):
    """Append the rows date range by date range and yield after each delivery."""
    bounds = [*cuts, None]
    low = None
    for high in bounds:
        part = rows if low is None else rows.where(F.col("date_id") >= low)
        part = part if high is None else part.where(F.col("date_id") < high)
        part.write.mode("append").parquet(f"{root}/source")
        low = high
        yield spark.readStream.schema(rows.schema).parquet(f"{root}/source")


def served(spark, sf):
    root = work_dir(spark)
    server = serving.Server(spark, f"{root}/server", serving.RlsState.prior(EXPERTS, alpha=1000.0, forgetting=0.95, prior_feature=EXPERTS[1]))
    batches = 0
    for source in feed(spark, protocol_rows(oof(spark, sf)), root, [50, 65]):
        serving.serve(source, server, f"{root}/checkpoint").awaitTermination()
        batches += 1
    return server, batches


@query("stream_predict")
def stream_predict(spark, sf):
    """Serving protocol over all dates in three deliveries."""
    server, _ = served(spark, sf)
    return server.predictions().select("row_id", *KEYS, "responder_6")


@query("stream_rls_state")
def stream_rls_state(spark, sf):
    """Final recursive least-squares state of the stream."""
    server, batches = served(spark, sf)
    final = server.state(batches - 1)
    return spark.createDataFrame([(f, float(b), int(final.last_update)) for f, b in zip(final.features, final.beta)], "feature string, beta double, last_update long")


@query(
    "stream_lag_attach",
    f"SELECT p.date_id, p.time_id, p.symbol_id, q.responder_6 AS responder_6_lag_1 FROM oof p LEFT JOIN oof q ON q.date_id + 1 = p.date_id AND q.time_id = p.time_id AND q.symbol_id = p.symbol_id --d:responder_6_lag_1",
    ctes=(PANEL, OOF),
)
def stream_lag_attach(spark, sf):
    """Delivered lags attached to every streamed row."""
    root = work_dir(spark)

    def sink(batch, batch_id):
        lags = batch.where("kind = 'lag'").select(*KEYS, serving.TARGET_LAG)
        rows = serving.attach_lags(batch.where("kind = 'test'").drop(serving.TARGET_LAG), lags)
        rows.select(*KEYS, serving.TARGET_LAG).write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    for source in feed(spark, protocol_rows(oof(spark, sf)), root, [60]):
        source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*KEYS, serving.TARGET_LAG)


#: Neighbouring symbols that share a state group of the keyed streams.
SYMBOLS = 256


@contextmanager
def rocksdb(spark):
    """Keyed state of the streams inside is kept in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, state.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def run_into(out, root: str) -> None:
    """Drain an append stream into a folder."""
    sink = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def deliver(spark, parts, root: str):
    """Append delivery after delivery and yield the stream after each."""
    for part in parts:
        part.write.mode("append").parquet(f"{root}/source")
        yield spark.readStream.schema(part.schema).parquet(f"{root}/source")


@query(
    "stream_feature_cache",
    f"SELECT CAST(p.date_id + 1 AS BIGINT) AS date_id, CAST(p.time_id AS BIGINT) AS time_id, CAST(p.symbol_id AS BIGINT) AS symbol_id, p.weight, p.base_prediction, p.trail_prediction, p.linear_prediction, p.responder_6 FROM oof p --d:weight base_prediction trail_prediction linear_prediction responder_6",
    ctes=(PANEL, OOF),
)
def stream_feature_cache(spark, sf):
    """Training rows from keyed state: features of one date joined to the next date's lags.

    Every lag is sent twice, and test rows of an older date come again with other values; neither changes the result.
    """
    root = work_dir(spark)
    rows = protocol_rows(oof(spark, sf)).drop("row_id")
    last = rows.agg(F.max("date_id")).first()[0]
    first, second = rows.where(F.col("date_id") < last - 22), rows.where(F.col("date_id") >= last - 22)
    old = rows.where((F.col("kind") == "test") & (F.col("date_id") == last - 25)).withColumn("weight", F.col("weight") * 3)
    again = rows.where((F.col("kind") == "lag") & F.col("date_id").between(last - 24, last - 10))
    with rocksdb(spark):
        for source in deliver(spark, [first, second.unionByName(old).unionByName(again), again.unionByName(old)], root):
            run_into(state.training_rows(state.with_event_time(source), EXPERTS, delay="30 days", symbols=SYMBOLS), root)
    return spark.read.parquet(f"{root}/out")


#: Dates before the last one: the first delivery ends before FIRST, the second at SECOND; AGAIN come twice, HELD_BACK a
#: delivery later than due, and LOST after the watermark has passed it.
FIRST, SECOND, AGAIN, HELD_BACK, LOST = 43, 22, (44, 24), 25, 32


@query(
    "stream_late_duplicates",
    """SELECT date_id, time_id, symbol_id, weight, CASE WHEN prior < date_id - 1 THEN 'gap' ELSE 'taken' END AS verdict FROM taken
       UNION ALL SELECT date_id, time_id, symbol_id, weight, 'repeated' FROM marked WHERE again
       UNION ALL SELECT date_id, time_id, symbol_id, weight, CASE WHEN late THEN 'late' ELSE 'stale' END FROM marked WHERE late OR stale --d:weight""",
    ctes=(
        PANEL,
        "bound AS (SELECT max(date_id) AS last FROM panel)",
        f"known AS (SELECT time_id, symbol_id, max(date_id) AS latest FROM panel, bound WHERE date_id <= last - {SECOND} AND date_id NOT IN (last - {HELD_BACK}, last - {LOST}) GROUP BY 1, 2)",
        f"""marked AS (SELECT p.date_id, time_id, symbol_id, weight, date_id = last - {LOST} AS late, date_id = last - {HELD_BACK} AND coalesce(latest, -1) > date_id AS stale, date_id IN (last - {AGAIN[0]}, last - {AGAIN[1]}) AS again
          FROM panel p JOIN bound ON true LEFT JOIN known USING (time_id, symbol_id))""",
        "taken AS (SELECT *, lag(date_id) OVER (PARTITION BY time_id, symbol_id ORDER BY date_id) AS prior FROM marked WHERE NOT late AND NOT stale)",
    ),
)
def stream_late_duplicates(spark, sf):
    """Three deliveries with repeated, stale, late and missing dates; each row comes out with its verdict."""
    root = work_dir(spark)
    rows = panel(spark, sf).select(*KEYS, "weight")
    last = rows.agg(F.max("date_id")).first()[0]
    date = F.col("date_id")
    due = rows.where(~date.isin(last - HELD_BACK, last - LOST))
    first = due.where(date < last - FIRST)
    second = due.where(date.between(last - FIRST, last - SECOND)).unionByName(rows.where(date == last - AGAIN[0]))
    third = due.where(date > last - SECOND).unionByName(rows.where(date.isin(last - HELD_BACK, last - LOST, last - AGAIN[1])))
    with rocksdb(spark):
        for source in deliver(spark, [first, second, third], root):
            run_into(state.delivery_verdicts(state.with_event_time(source), delay="5 days", symbols=SYMBOLS), root)
    return spark.read.parquet(f"{root}/out")


@query(
    "stream_tumbling",
    """SELECT start_s, count(*) AS "rows", sum(weight) AS batch_weight_sum, avg(CASE WHEN feature_03 IS NULL THEN 1e0 ELSE 0e0 END) AS batch_missing_frac
       FROM (SELECT *, 86400 + CAST(date_id AS BIGINT)*86400 + time_id*30 AS start_s FROM panel) WHERE start_s + 30 <= (SELECT max(CAST(date_id AS BIGINT)*86400 + time_id*30) FROM panel) GROUP BY 1 --d:batch_weight_sum batch_missing_frac""",
    ctes=(PANEL,),
)
def stream_tumbling(spark, sf):
    """Batch state on a live stream through tumbling windows: those that the watermark, a day behind, has closed."""
    root = work_dir(spark)
    rows = panel(spark, sf).select(*KEYS, "weight", "feature_03")
    last = rows.agg(F.max("date_id")).first()[0]
    for source in deliver(spark, [rows.where(F.col("date_id") < last - 20), rows.where(F.col("date_id") >= last - 20)], root):
        totals = state.batch_totals(state.with_event_time(source), missing=["feature_03"])
        run_into(totals.select(F.unix_timestamp("window.start").alias("start_s"), "rows", "batch_weight_sum", "batch_missing_frac"), root)
    return spark.read.parquet(f"{root}/out")


@query(
    "prior_state",
    " UNION ALL ".join(
        f"SELECT {k} AS k, {1000 if k == 1 else 0} + sum(weight * {c} * responder_6) AS rhs, 1000 + sum(weight * {c} * {c}) AS diagonal, 0.95e0 AS forgetting FROM oof" for k, c in enumerate(EXPERTS)
    ) + " --d:rhs diagonal forgetting",
    ctes=(PANEL, OOF),
    digits=4,
)
def prior_state(spark, sf):
    """Prior plus out-of-fold Gram as the initial serving state."""
    start = serving.RlsState.from_oof(oof(spark, sf), EXPERTS, alpha=1000.0, forgetting=0.95, prior_feature=EXPERTS[1])
    return start.to_frame(spark).select(F.posexplode("rhs").alias("k", "rhs"), F.col("precision"), "forgetting").select("k", "rhs", F.element_at("precision", F.col("k") * len(EXPERTS) + F.col("k") + 1).alias("diagonal"), "forgetting")


@query("state_artifact")
def state_artifact(spark, sf):
    """State saved to Parquet and loaded again."""
    path = f"{work_dir(spark)}/artifact"
    start = serving.RlsState.from_oof(oof(spark, sf), EXPERTS, alpha=1000.0, forgetting=0.95, prior_feature=EXPERTS[1])
    start.metadata = {"rows": str(oof(spark, sf).count())}
    start.save(spark, path)
    back = serving.RlsState.load(spark, path)
    return spark.createDataFrame([(f, float(b), back.metadata["rows"]) for f, b in zip(back.features, back.beta)], "feature string, beta double, rows string")
