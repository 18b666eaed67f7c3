"""Streams: bars from ticks, running features and the trading state, one state a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bars_from_ticks(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes", key: str = "series") -> DataFrame:
    """Open, high, low, close, volume and count by key and window; ticks later than the watermark go."""
    t = ticks.withColumn("_at", F.struct("ts", "tie")).withWatermark("ts", late)
    g = t.groupBy(F.window("ts", width), key)
    out = g.agg(F.min_by("x", "_at").alias("open"), F.max("x").alias("high"), F.min("x").alias("low"), F.max_by("x", "_at").alias("close"), F.sum("x").alias("volume"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


FEATURES = "series long, ts timestamp, tie long, close double, mean double, momentum double"
#: A key that has been silent for so long starts anew; its state is dropped then.
IDLE = 30 * 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trailing(StatefulProcessor):
    """A list of a key's last closes, when the last one was, and a timer that clears both once the watermark has left the key behind."""

    def __init__(self, window: int, idle: int):
        self.window, self.idle = window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closes = handle.getListState("closes", "close double")
        self.seen = handle.getValueState("seen", "ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, out = pd.concat(rows).sort_values(["ts", "tie"]), []
        before = self.seen.get()[0] if self.seen.exists() else None
        last = [c for (c,) in self.closes.get()] if before is not None else []
        if before is not None:
            self.handle.deleteTimer(before + self.idle)
        for ts, tie, close in zip(batch["ts"], batch["tie"], batch["close"]):
            now = ts.value // 1_000_000 if hasattr(ts, "value") else int(ts)
            if before is not None and now - before > self.idle:
                last = []
            out.append((key[0], ts, tie, close, sum([*last, close]) / (len(last) + 1), close - last[0] if len(last) == self.window - 1 else None))
            last, before = [*last, close][-(self.window - 1) :], now if before is None else max(before, now)
        self.closes.put([(c,) for c in last])
        self.seen.update((before,))
        self.handle.registerTimer(before + self.idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.closes.clear()
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def running_features(bars: DataFrame, window: int = 6, key: str = "series", late: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """Trailing mean and momentum of bars(series, ts, tie, close); of one time, in the order of tie, where there is such a column.

    The state of a key is its last ``window`` closes, and goes when the key has been silent for ``idle`` milliseconds of
    event time, after which it starts anew. What is later than the watermark is dropped.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # lists and timers need it
    tie = F.col("tie") if "tie" in bars.columns else F.lit(0).cast("long").alias("tie")
    timed = bars.select(key, "ts", tie, "close").withWatermark("ts", late)
    return timed.groupBy(key).transformWithStateInPandas(Trailing(window, idle), FEATURES, "append", "eventTime")


LEDGER = "run string, ts timestamp, cash double, shares double, nav double"


def trade(signals: DataFrame, enter: float, leave: float, capital: float = 1e6, fraction: float = 0.95) -> DataFrame:
    """Long above ``enter``, flat below ``leave``; cash and shares are the state of a run."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cash, shares = state.get if state.exists else (capital, 0.0)
        rows = []
        for ts, price, s in pd.concat(frames).sort_values("ts")[["ts", "price", "signal"]].itertuples(index=False):
            if shares == 0 and s >= enter:
                shares = fraction * cash / price
                cash -= shares * price
            elif shares > 0 and s < leave:
                cash, shares = cash + shares * price, 0.0
            rows.append((keys[0], ts, cash, shares, cash + shares * price))
        state.update((cash, shares))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEDGER.split(", ")])

    return signals.groupBy("run").applyInPandasWithState(update, LEDGER, "cash double, shares double", "append", GroupStateTimeout.NoTimeout)


def breaches(ledger: DataFrame) -> DataFrame:
    """Rows of a ledger stream that break an invariant which one row can show."""
    return ledger.where((F.col("cash") < -0.01) | ((F.col("shares") == 0) & (F.abs(F.col("nav") - F.col("cash")) > 0.01)) | F.col("nav").isNull() | F.isnan("nav"))
