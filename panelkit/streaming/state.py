"""Keyed state and event-time operators on panel streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelkit.functions import scalar as S
from panelkit.schema import DATE, KEYS, SYMBOL, TARGET, TIME, WEIGHT
from panelkit.streaming.serving import TARGET_LAG

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(df: DataFrame, *, seconds_per_step: int = 30, origin: int = 86_400) -> DataFrame:
    """Event time from the integer clock: one day per date, a fixed step per time.

    ``origin`` keeps the first row after the epoch, where a fresh watermark would call it late.
    """

    seconds = F.lit(origin) + F.col(DATE).cast("long") * 86_400 + F.col(TIME).cast("long") * seconds_per_step
    return df.withColumn("event_time", F.timestamp_seconds(seconds))


def drop_late_duplicates(stream: DataFrame, *, delay: str = "1 day", keys: Sequence[str] = KEYS) -> DataFrame:
    """Repeated deliveries of a key are dropped while the watermark remembers it."""

    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(keys))


def batch_totals(stream: DataFrame, *, width: str = "30 seconds", delay: str = "1 day", missing: Sequence[str] = ()) -> DataFrame:
    """Tumbling batch state of a live stream: rows, weight, mean activity and missingness.

    In append mode each window comes out once, when the watermark has passed its end, and its state is freed.
    """

    fraction = S.missing_count(missing) / float(len(missing)) if missing else F.lit(0.0)
    return (
        stream.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(S.dbl(WEIGHT)).alias("batch_weight_sum"), F.avg(fraction).alias("batch_missing_frac"))
    )


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    """The stream under a watermark that drives timers but doesn't drop late rows: the processor sees and marks them."""

    return stream.withWatermark("event_time", delay).withColumn("event_ms", F.unix_millis("event_time")).drop("event_time")


#: A (time, symbol) of a block that has no date yet.
NONE = -(2**62)


class SymbolBlock(StatefulProcessor):
    """State of a block of neighbouring symbols at one time: a packed entry per event time, and one date a symbol.

    A date and the place of its symbol in the block are one code, date * symbols + place. One timer a block waits for the
    oldest entry, so that calls of the state store go with blocks and event times and not with rows.
    """

    #: Packed fields of an entry besides its codes, and how long after its event time it is kept.
    width, keep_ms = 0, 1

    def __init__(self, symbols: int) -> None:
        self.symbols = symbols

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dates = handle.getValueState("dates", "packed binary")
        self.entries = handle.getMapState("entries", "event_ms long", "codes binary, fields binary")

    def places(self, rows: pd.DataFrame) -> np.ndarray:
        return np.mod(rows[SYMBOL].fillna(0).to_numpy(np.int64), self.symbols)

    def read(self) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The date of each place, and the codes and fields of each event time."""

        dates = np.frombuffer(self.dates.get()[0], np.int64).copy() if self.dates.exists() else np.full(self.symbols, NONE)
        held = {}
        for k, v in self.entries.iterator():
            codes = np.frombuffer(v[0], np.int64)
            held[int(k[0])] = codes, np.frombuffer(v[1]).reshape(len(codes), self.width) if self.width else np.empty((len(codes), 0))
        return dates, held

    def write(self, event_ms: int, codes: np.ndarray, fields: np.ndarray) -> None:
        self.entries.updateValue((int(event_ms),), (codes.astype(np.int64).tobytes(), fields.astype(np.float64).tobytes()))

    def wait(self, event_times) -> None:
        if len(event_times):
            self.handle.registerTimer(int(min(event_times)) + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        times = [int(k[0]) for k in self.entries.keys()]
        for t in times:
            if t + self.keep_ms <= mark:
                self.entries.removeKey((t,))
        self.wait([t for t in times if t + self.keep_ms > mark])
        yield from ()

    def close(self) -> None:
        pass


def _by_blocks(timed: DataFrame, symbols: int):
    return timed.withColumn("__block", S.int_bucket(SYMBOL, symbols)).groupBy(TIME, "__block")


class DeliveryRules(SymbolBlock):
    """Verdict on each delivered date of each (time, symbol) of a block.

    State is the latest date of each symbol and, while the watermark has not passed them, the dates taken; they are
    forgotten behind it, since later copies of them are late anyway.
    """

    def __init__(self, columns: Sequence[str], symbols: int = 1) -> None:
        super().__init__(symbols)
        self.columns = list(columns)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        todo = pd.concat(list(rows))
        todo = todo.assign(__at=self.places(todo)).sort_values(["__at", DATE, "event_ms"], kind="stable")
        dates, times, at = (todo[c].to_numpy(np.int64) for c in (DATE, "event_ms", "__at"))
        latest, held = self.read()
        codes, late = dates * self.symbols + at, times < timers.getCurrentWatermarkInMs()
        again = np.isin(codes, np.concatenate([np.empty(0, np.int64), *[c for c, _ in held.values()]]))
        again[~late] |= pd.Series(codes[~late]).duplicated().to_numpy()
        stale = dates < latest[at]
        new = np.flatnonzero(~(late | again | stale))
        fresh = np.r_[True, at[new][1:] != at[new][:-1]] if len(new) else np.zeros(0, bool)
        before = np.where(fresh, latest[at[new]], np.r_[NONE, dates[new][:-1]] if len(new) else dates[:0])
        gap = np.zeros(len(dates), bool)
        gap[new] = (dates[new] > before + 1) & (before >= 0)
        verdict = np.select([late, again, stale, gap], ["late", "repeated", "stale", "gap"], "taken")
        for t, own in pd.Series(codes[new]).groupby(times[new]):
            self.write(t, np.concatenate([held[t][0], own]) if t in held else own.to_numpy(), np.empty(0))
        if len(new):
            # dates of a symbol rise, so the last one stays
            latest[at[new]] = dates[new]
            self.dates.update((latest.tobytes(),))
            self.wait(times[new])
        yield todo[self.columns].assign(verdict=verdict)


def delivery_verdicts(stream: DataFrame, *, delay: str = "1 day", symbols: int = 1) -> DataFrame:
    """Every row of a stream of panel rows with ``event_time``, and a ``verdict`` on its date for its (time, symbol).

    ``taken``: the first delivery of a date later than all before; ``gap``: the same, but not the day after the last one;
    ``repeated``: a date taken before (or earlier in this micro-batch); ``stale``: a date never taken, but not later than
    the last one taken; ``late``: its event time is behind the watermark. Nothing is dropped: rows that are not taken are a
    side output, told apart by the verdict. ``symbols`` neighbouring symbols share a state group, which changes no
    verdict; a stream keeps the number it began with. Needs the RocksDB state store.
    """

    timed = _timed(stream, delay)
    columns = [c for c in stream.columns if c != "event_time"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema if f.name != "event_time")
    return _by_blocks(timed, symbols).transformWithStateInPandas(DeliveryRules(columns, symbols), outputStructType=f"{kinds}, verdict string", outputMode="Append", timeMode="EventTime")


class FeatureCache(SymbolBlock):
    """Features of each (time, symbol) of a block by date, until the lag of exactly the next date makes a training row.

    A date's first row stays and a lag counts once, so repeated rows change nothing; features that no lag has asked for
    are dropped when the watermark passes the next date.
    """

    def __init__(self, features: Sequence[str], day_ms: int = 86_400_000, symbols: int = 1) -> None:
        super().__init__(symbols)
        self.features, self.width, self.keep_ms = list(features), 1 + len(features), day_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        todo = pd.concat(list(rows))
        todo = todo.assign(__code=todo[DATE].to_numpy(np.int64) * self.symbols + self.places(todo))
        done, entries = self.read()
        names, n = [WEIGHT, *self.features], self.symbols
        open_, test = todo[DATE].to_numpy(np.int64) - done[todo["__code"] % n], (todo["kind"] == "test").to_numpy()
        in_time = (todo["event_ms"] + self.keep_ms > timers.getCurrentWatermarkInMs()).to_numpy()
        fresh = todo.loc[test & in_time & (open_ >= 0), ["event_ms", "__code", *names]]
        held = [pd.DataFrame(v, columns=names).assign(event_ms=t, __code=c) for t, (c, v) in entries.items()]
        known = pd.concat([*held, fresh])[list(fresh.columns)].drop_duplicates("__code").astype({"event_ms": "int64", "__code": "int64"} | dict.fromkeys(names, "float64"))
        lags = todo.loc[(todo["kind"] == "lag").to_numpy() & (open_ > 0), ["__code", TARGET_LAG]].drop_duplicates("__code")
        met = known.assign(__code=known["__code"] + n).merge(lags, on="__code")
        if len(lags):
            np.maximum.at(done, lags["__code"].to_numpy() % n, lags["__code"].to_numpy() // n)
            self.dates.update((done.tobytes(),))
        # a lag of date d uses up all features before d
        left = known[(known["__code"] // n).to_numpy() >= done[known["__code"] % n]]
        kept = {int(t): part for t, part in left.groupby("event_ms", sort=False)}
        for t in entries.keys() - kept.keys():
            self.entries.removeKey((t,))
        added = [t for t, part in kept.items() if t not in entries or not np.array_equal(entries[t][0], part["__code"])]
        for t in added:
            self.write(t, kept[t]["__code"].to_numpy(), kept[t][names].to_numpy())
        self.wait(added)
        if len(met):
            code = met["__code"].to_numpy()
            out = met.assign(**{DATE: code // n, TIME: int(key[0]), SYMBOL: int(key[1]) * n + code % n}).rename(columns={TARGET_LAG: TARGET})
            yield out.sort_values([SYMBOL, DATE])[[*KEYS, *names, TARGET]]


def training_rows(stream: DataFrame, features: Sequence[str], *, delay: str = "1 day", symbols: int = 1) -> DataFrame:
    """Training rows from interleaved test and lag rows with ``event_time``, state per (time, block of symbols) in RocksDB.

    A lag of date d meets the features of date d - 1. Lags sent twice give one row, a lag older than the last one none;
    older or repeated test rows don't overwrite. ``symbols`` neighbouring symbols share a state group, which changes no
    row; a stream keeps the number it began with. Needs ``spark.sql.streaming.stateStore.providerClass`` set to the
    RocksDB provider.
    """

    schema = f"{DATE} long, {TIME} long, {SYMBOL} long, {WEIGHT} double, " + ", ".join(f"{c} double" for c in features) + f", {TARGET} double"
    return _by_blocks(_timed(stream, delay), symbols).transformWithStateInPandas(FeatureCache(features, symbols=symbols), outputStructType=schema, outputMode="Append", timeMode="EventTime")
