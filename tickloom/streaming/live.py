"""Keyed streams: each symbol's developing bar, moved by live ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.bars import latest

STATE = "date timestamp, open double, high double, low double, close_price double, volume bigint, ts timestamp, event_id bigint, price double"
BAR = ["date", "open", "high", "low", "close_price", "volume"]
OUT = "symbol string, date timestamp, open double, high double, low double, close_price double, volume bigint, moved boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def moved(bar: dict, price: float, tolerance: float) -> tuple[dict, bool]:
    """The bar with its close at the price, high and low stretched; as it is if the price isn't positive or off the close by more than the tolerance."""
    close = bar["close_price"]
    if not (price is not None and price > 0 and abs(price - close) <= tolerance * close):
        return bar, False
    return bar | {"high": max(bar["high"], price), "low": min(bar["low"], price), "close_price": price}, True


class LiveBar(StatefulProcessor):
    """State of a symbol: its last bar, and the newest tick by (time, id). An older tick that comes late changes nothing."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bar", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        b = initialState.iloc[0]
        self.state.update((*[_plain(b[c]) for c in BAR], None, None, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            top = part.sort_values(["ts", "event_id"]).iloc[-1]
            at = (_plain(top["ts"]), int(top["event_id"]), float(top["price"]))
            newest = at if newest is None or at[:2] > newest[:2] else newest
        if not self.state.exists() or newest is None:  # a symbol without bars has none to move
            return
        held = tuple(self.state.get())
        bar, last = dict(zip(BAR, held)), held[len(BAR) :]
        if last[0] is not None and last[:2] >= newest[:2]:
            newest = last
        self.state.update((*held[: len(BAR)], *newest))
        bar, good = moved(bar, newest[2], self.tolerance)
        yield pd.DataFrame([{"symbol": key[0], **bar, "moved": good}])

    def close(self) -> None:
        pass


def _plain(value):
    return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value


def live_bars(ticks: DataFrame, bars: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """A stream of ticks (symbol, ts, event_id, price) to the moved last bars, a row for each symbol that a batch has ticks of.

    `bars` gives the state at the stream's start. The session's state store has to be RocksDB's.
    """
    zoned = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp"))
    start = zoned(latest(bars.select("symbol", *BAR), ("symbol",), "date"), "date").groupBy("symbol")
    rows = zoned(ticks.select("symbol", "ts", "event_id", "price"), "ts").groupBy("symbol")
    out = rows.transformWithStateInPandas(LiveBar(tolerance), outputStructType=OUT, outputMode="Update", timeMode="None", initialState=start)
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))
