"""Streams against batch results and the serving protocol."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.streaming import serving
from panelkit.streaming.serving import TARGET_LAG, RlsState, Server

KEYS = ["date_id", "time_id", "symbol_id"]
XS = ["a_prediction", "b_prediction"]


def protocol(df, missing_date=None):
    test = df.select(F.concat_ws("-", *KEYS).alias("row_id"), *KEYS, "weight", *XS, F.lit("test").alias("kind"), F.lit(None).cast("double").alias(TARGET_LAG))
    lag = df.select(F.lit(None).cast("string").alias("row_id"), (F.col("date_id") + 1).alias("date_id"), "time_id", "symbol_id", *[F.lit(None).cast("double").alias(c) for c in ("weight", *XS)], F.lit("lag").alias("kind"), F.col("responder_6").alias(TARGET_LAG))
    return test.unionByName(lag)


def run(spark, rows, root, cuts):
    server = Server(spark, f"{root}/server", RlsState.prior(XS, alpha=20.0, forgetting=0.9, prior_feature="a_prediction"))
    low = -1
    for i, high in enumerate([*cuts, 10**6]):
        rows.where((F.col("date_id") >= low) & (F.col("date_id") < high)).write.mode("append").parquet(f"{root}/source")
        low = high
        source = spark.readStream.schema(rows.schema).parquet(f"{root}/source")
        serving.serve(source, server, f"{root}/checkpoint").awaitTermination()
    return server, i


def by_row(server):
    return {r.row_id: r.responder_6 for r in server.predictions().collect()}


def expected(pdf, present):
    """Serving rule in numpy: a delivery updates from exactly one date earlier."""
    p, r = 20.0 * np.eye(2), 20.0 * np.array([1.0, 0.0])
    out = {}
    for d in sorted(present | {d + 1 for d in present}):
        past = pdf[pdf.date_id == d - 1]
        if d - 1 in present:
            x, y, w = past[XS].to_numpy(), past.responder_6.to_numpy(), past.weight.to_numpy()
            p, r = 0.9 * p + x.T @ (x * w[:, None]), 0.9 * r + x.T @ (w * y)
        if d not in present:
            continue
        now = pdf[pdf.date_id == d]
        pred = now[XS].to_numpy() @ np.linalg.solve(p, r)
        out |= {f"{a}-{b}-{c}": v for a, b, c, v in zip(now.date_id, now.time_id, now.symbol_id, pred)}
    return out


def compare(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_stream_equals_day_loop_for_any_cut(spark, toy, tmp_path):
    pdf, df = toy
    want = expected(pdf, set(pdf.date_id))
    for name, cuts in (("one", []), ("three", [5, 12])):
        server, _ = run(spark, protocol(df), str(tmp_path / name), cuts)
        compare(by_row(server), want)


def test_gap_marks_the_date_without_update(spark, toy, tmp_path):
    pdf, df = toy
    server, last = run(spark, protocol(df.where("date_id <> 7 and date_id < 12")), str(tmp_path), [6])
    compare(by_row(server), expected(pdf, set(range(12)) - {7}))
    assert server.state(last).last_update == 12


def test_repeated_batch_changes_nothing(spark, toy, tmp_path):
    _, df = toy
    rows = protocol(df.where("date_id < 6"))
    server = Server(spark, str(tmp_path / "s"), RlsState.prior(XS, alpha=20.0, forgetting=0.9))
    server(rows.where("date_id < 3"), 0)
    server(rows.where("date_id >= 3"), 1)
    first, state = by_row(server), server.state(1)
    server(rows.where("date_id >= 3"), 1)  # the same micro-batch after a failure
    assert by_row(server) == first
    np.testing.assert_array_equal(server.state(1).precision, state.precision)


def test_repeated_delivery_is_ignored():
    from panelkit.operators.stats import Normal

    state = RlsState.prior(["x"], alpha=1.0, forgetting=0.5)
    day = Normal(np.array([[2.0]]), np.array([1.0]), rows=3)
    state.learn(day, 5)
    state.learn(day, 5)
    assert state.precision[0, 0] == 2.5 and state.last_update == 5
    state.learn(None, 6)
    assert state.precision[0, 0] == 2.5 and state.last_update == 6
    state.learn(day, 5)  # a date that comes again after a later one
    state.learn(day, 6)
    assert state.precision[0, 0] == 2.5 and state.last_update == 6


def test_stale_deliveries_through_the_server(spark, toy, tmp_path):
    _, df = toy
    once = Server(spark, str(tmp_path / "a"), RlsState.prior(XS, alpha=20.0, forgetting=0.9))
    again = Server(spark, str(tmp_path / "b"), RlsState.prior(XS, alpha=20.0, forgetting=0.9))
    rows = protocol(df.where("date_id < 5"))
    parts = [rows.where("date_id < 3"), rows.where("date_id = 3"), rows.where("date_id = 4")]
    for k, part in enumerate(parts):
        once(part, k)
    for k, part in enumerate([*parts, parts[1], parts[2]]):
        again(part, k)
    np.testing.assert_allclose(again.state(4).precision, once.state(2).precision)
    assert again.state(4).last_update == once.state(2).last_update


def test_state_round_trip(spark, toy, tmp_path):
    _, df = toy
    state = RlsState.from_oof(df, XS, alpha=5.0, forgetting=0.9, prior_feature="b_prediction")
    state.metadata = {"kind": "test"}
    state.save(spark, str(tmp_path / "a"))
    back = RlsState.load(spark, str(tmp_path / "a"))
    np.testing.assert_array_equal(back.precision, state.precision)
    assert (back.features, back.metadata, back.last_update) == (tuple(XS), {"kind": "test"}, None)
    with pytest.raises(ValueError):
        RlsState.prior([], alpha=1.0)
    with pytest.raises(ValueError):
        RlsState.prior(XS, alpha=1.0, forgetting=1.5)


def test_lags_are_null_before_the_first_delivery(spark, toy):
    _, df = toy
    assert serving.attach_lags(df, None).where(F.col(TARGET_LAG).isNotNull()).count() == 0


# --------------------------------------------------------------------------- keyed state


@pytest.fixture
def rocksdb(spark):
    from panelkit.streaming.state import ROCKSDB

    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.set(name, old)


def drain(spark, make, deliveries, schema, root):
    """Rows that come out of each delivery, and the state rows after it."""
    from panelkit.streaming.state import with_event_time

    seen, held = [], []
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/source")
        source = with_event_time(spark.readStream.schema(schema).parquet(f"{root}/source"))
        query = make(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        now = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").collect())
        before = list(sum(seen, []))
        for r in before:
            now.remove(r)
        seen.append(now)
    return seen, held


def test_verdicts_on_repeated_stale_late_and_missing_dates(spark, rocksdb, tmp_path):
    from panelkit.streaming.state import delivery_verdicts

    rows = lambda *dates: [(d, 0, 1, float(d)) for d in dates]
    other = [(10, 0, 2, 1.0), (10, 0, 2, 2.0)]
    seen, held = drain(
        spark, lambda s: delivery_verdicts(s, delay="3 days"), [rows(10, 11, 11) + other, rows(11, 13, 14), rows(12, 14, 9, 15), rows(30), rows(14, 31)],
        "date_id int, time_id int, symbol_id int, weight double", str(tmp_path),
    )
    told = [[(r[0], r[2], r[4]) for r in part] for part in seen]
    assert sorted(told[0]) == [(10, 1, "taken"), (10, 2, "repeated"), (10, 2, "taken"), (11, 1, "repeated"), (11, 1, "taken")]
    assert sorted(told[1]) == [(11, 1, "repeated"), (13, 1, "gap"), (14, 1, "taken")]
    # the watermark is at date 11: date 12 was never taken but is in time, date 9 is not
    assert sorted(told[2]) == [(9, 1, "late"), (12, 1, "stale"), (14, 1, "repeated"), (15, 1, "taken")]
    assert told[3] == [(30, 1, "gap")]
    assert sorted(told[4]) == [(14, 1, "late"), (31, 1, "taken")]
    assert held[-1] < held[2]  # dates behind the watermark are forgotten


def test_feature_cache_takes_lags_once_and_expires(spark, rocksdb, tmp_path):
    from panelkit.streaming.state import training_rows

    schema = f"date_id int, time_id int, symbol_id int, weight double, a double, kind string, {TARGET_LAG} double"
    test = lambda d, a, s=1: (d, 0, s, 1.0, float(a), "test", None)
    lag = lambda d, y, s=1: (d, 0, s, None, None, "lag", float(y))
    seen, held = drain(
        spark, lambda s: training_rows(s, ["a"], delay="3 days"),
        [
            [test(5, 50), lag(5, 1), *[test(5, 7, s) for s in range(2, 9)]],  # no features of date 4 yet
            [lag(6, 60), lag(6, 61), test(6, 66), test(5, 99)],  # the lag counts once; an older test row changes nothing
            [lag(6, 62), test(8, 80), lag(8, 1)],  # repeated lag; a gap: date 7 is missing
            [test(9, 90), lag(9, 81), test(8, 99)],
            [test(40, 1)],
            [test(41, 2)],
        ],
        schema, str(tmp_path),
    )
    assert [[(r[0], r[4], r[5]) for r in part] for part in seen] == [[], [(6, 50.0, 60.0)], [], [(9, 80.0, 81.0)], [], []]
    assert held[0] > held[-1]  # symbols without a lag are dropped with the watermark


def test_tumbling_windows_close_with_the_watermark(spark, tmp_path):
    from panelkit.streaming.state import batch_totals

    make = lambda s: batch_totals(s, delay="2 days").selectExpr("unix_timestamp(window.start) div 86400 - 1 as date_id", "rows", "batch_weight_sum")
    rows = lambda *dates: [(d, t, 1, float(t)) for d in dates for t in range(3)]
    seen, held = drain(spark, make, [rows(0, 1, 2, 3, 4), rows(4, 5), rows(20, 1)], "date_id int, time_id int, symbol_id int, weight double", str(tmp_path))
    closed = lambda part: sorted({r[0] for r in part})
    assert [closed(p) for p in seen] == [[0, 1, 2], [2, 3], [3, 4, 5]]
    assert {(r[0], r[1]) for r in seen[2]} == {(3, 1), (4, 2), (5, 1)}
    assert held[-1] <= 3 < held[0]


@pytest.mark.parametrize("kind", ["verdicts", "cache"])
def test_neighbouring_symbols_share_state_entries(spark, rocksdb, tmp_path, kind):
    """Results don't depend on the blocks, and state entries go with blocks and dates, not with symbols."""
    from panelkit.streaming.state import delivery_verdicts, training_rows

    symbols = range(-20, 130)
    if kind == "verdicts":
        dates = lambda s: [5, 6, 6] if s % 3 else [5, 7]
        rows = [(d, 0, s, float(s)) for s in symbols for d in dates(s)]
        seen, held = drain(spark, lambda q: delivery_verdicts(q, delay="3 days", symbols=50), [rows, [(7, 0, s, float(s)) for s in symbols]], "date_id int, time_id int, symbol_id int, weight double", str(tmp_path))
        first = [(5, 0, s, float(s), "taken") for s in symbols] + [(6, 0, s, float(s), v) for s in symbols if s % 3 for v in ("taken", "repeated")] + [(7, 0, s, float(s), "gap") for s in symbols if not s % 3]
        assert [sorted(part) for part in seen] == [sorted(first), sorted((7, 0, s, float(s), "taken" if s % 3 else "repeated") for s in symbols)]
    else:
        schema = f"date_id int, time_id int, symbol_id int, weight double, a double, kind string, {TARGET_LAG} double"
        test = lambda d, s: (d, 0, s, 1.0, float(100 * d + s), "test", None)
        lag = lambda d, s: (d, 0, s, None, None, "lag", float(s))
        parts = [[test(d, s) for s in symbols for d in (5, 6)] + [lag(6, s) for s in symbols if s % 3], [lag(d, s) for s in symbols for d in (6, 7)]]
        seen, held = drain(spark, lambda q: training_rows(q, ["a"], delay="3 days", symbols=50), parts, schema, str(tmp_path))
        row = lambda d, s: (d, 0, s, 1.0, float(100 * (d - 1) + s), float(s))
        want = [[row(6, s) for s in symbols if s % 3], [row(7, s) for s in symbols] + [row(6, s) for s in symbols if not s % 3]]
        assert [sorted(part) for part in seen] == [sorted(part) for part in want]
    assert max(held) < len(symbols)
