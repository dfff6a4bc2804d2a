"""Chart indicators over bars: each adds columns, null during warm-up, and a registry of them by id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import series as S
from tickloom.operators.features import true_range
from tickloom.schemas import ATR_BARS


def _plain(rows: DataFrame) -> DataFrame:
    return rows.drop("idx", "prev")


def sma(bars: DataFrame, period: int = 20, out: str = "sma") -> DataFrame:
    return _plain(S.rolling(S.indexed(bars), period, {out: S.mean(F.col("close_price"), period)}))


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """middle, upper and lower band: mean plus and minus `width` population deviations."""
    rows = S.rolling(S.indexed(bars), period, {"middle": S.mean(F.col("close_price"), period), "_sd": S.deviation(F.col("close_price"), period, True)})
    return _plain(rows.withColumns({"upper": F.col("middle") + width * F.col("_sd"), "lower": F.col("middle") - width * F.col("_sd")}).drop("_sd"))


def vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price from the first bar on; null before any volume."""
    typical = (F.col("high") + F.col("low") + F.col("close_price")) / 3
    rows = S.running_sums(S.indexed(bars), {"_pv": typical * F.col("volume"), "_v": F.col("volume").cast("double")})
    return _plain(rows.withColumn("vwap", F.col("_pv") / F.nullif("_v", F.lit(0.0))).drop("_pv", "_v"))


def with_ema(rows: DataFrame, period: int, out: str) -> DataFrame:
    """EMA on indexed rows: the mean of the first `period` closes, then towards each close by 2 / (period + 1)."""
    alpha = 2.0 / (period + 1)
    seed = rows.where(F.col("idx") < period).groupBy(F.col("symbol").alias("_symbol")).agg(F.avg("close_price").alias("_seed"))
    joined = rows.join(seed, F.col("symbol") == F.col("_symbol"), "left")
    weight = F.when(F.col("idx") == period - 1, F.col("_seed")).when(F.col("idx") >= period, F.col("close_price") * alpha)
    done = S.recurrence(joined, out, weight, 1 - alpha)
    return done.withColumn(out, F.when(F.col("idx") >= period - 1, F.col(out))).drop("_symbol", "_seed")


def ema(bars: DataFrame, period: int = 21, out: str = "ema") -> DataFrame:
    return _plain(with_ema(S.indexed(bars), period, out))


def atr_wilder(bars: DataFrame, period: int = ATR_BARS, out: str = "atr") -> DataFrame:
    """Wilder's average: starts at the first true range, then moves by 1 / period."""
    rows = S.indexed(bars)
    weight = F.when(F.col("idx") == 0, true_range()).otherwise(true_range() / float(period))
    return _plain(S.recurrence(rows, out, weight, 1 - 1 / period))


def trend_state(bars: DataFrame, fast: int = 21, slow: int = 200) -> DataFrame:
    """bullish, bearish or neutral by two EMAs and the close; null before the slow one has warmed up."""
    rows = with_ema(with_ema(S.indexed(bars), fast, "_fast"), slow, "_slow")
    up = (F.col("_fast") > F.col("_slow")) & (F.col("close_price") > F.col("_fast"))
    down = (F.col("_fast") < F.col("_slow")) & (F.col("close_price") < F.col("_fast"))
    state = F.when(F.col("_slow").isNull(), None).when(up, "bullish").when(down, "bearish").otherwise("neutral")
    return _plain(rows.withColumn("trend", state).drop("_fast", "_slow"))


def latest_trends(bars: DataFrame, frames: dict[str, Callable[[DataFrame], DataFrame]], fast: int = 21, slow: int = 200) -> DataFrame:
    """Newest state per symbol and time frame, where a frame has warmed up."""
    out = None
    for name, roll in frames.items():
        rows = trend_state(roll(bars), fast, slow).where("trend is not null")
        one = rows.groupBy("symbol").agg(F.max_by("trend", "date").alias("trend")).select("symbol", F.lit(name).alias("timeframe"), "trend")
        out = one if out is None else out.unionByName(one)
    return out


def candle_trend(bars: DataFrame) -> DataFrame:
    """up if the close isn't below the one before (the first bar: its own open)."""
    rows = S.indexed(bars)
    return _plain(rows.withColumn("direction", F.when(F.col("close_price") >= F.coalesce("prev", "open"), "up").otherwise("down")))


@dataclass(frozen=True)
class Indicator:
    """An entry of the registry: kind, label and parameters."""

    kind: str
    label: str
    period: int = 20
    width: float = 2.0
    fast: int = 21
    slow: int = 200


# Ids, labels and default periods.
INDICATORS = {
    "sma20": Indicator("sma", "SMA 20", 20), "sma50": Indicator("sma", "SMA 50", 50), "sma200": Indicator("sma", "SMA 200", 200),
    "ema12": Indicator("ema", "EMA 12", 12), "ema21": Indicator("ema", "EMA 21", 21), "ema26": Indicator("ema", "EMA 26", 26), "ema200": Indicator("ema", "EMA 200", 200),
    "bb20": Indicator("bb", "Bollinger Bands", 20), "vwap": Indicator("vwap", "VWAP"), "volume": Indicator("volume", "Volume"), "trend-logic": Indicator("trend-logic", "EMA Trend Friend Pro"),
}
KINDS: dict[str, Callable[[DataFrame, Indicator], DataFrame]] = {
    "sma": lambda bars, i: sma(bars, i.period),
    "ema": lambda bars, i: ema(bars, i.period),
    "bb": lambda bars, i: bollinger(bars, i.period, i.width),
    "vwap": lambda bars, i: vwap(bars),
    "volume": lambda bars, i: bars.withColumn("direction", F.when(F.col("close_price") >= F.col("open"), "up").otherwise("down")),
    "trend-logic": lambda bars, i: trend_state(bars, i.fast, i.slow),
}


def resolve(name: str, overrides: dict[str, dict] | None = None) -> Indicator | None:
    base = INDICATORS.get(name)
    return None if base is None else replace(base, **(overrides or {}).get(name, {}))


def compute(bars: DataFrame, name: str, overrides: dict[str, dict] | None = None) -> DataFrame:
    indicator = resolve(name, overrides)
    if indicator is None:
        raise KeyError(name)
    return KINDS[indicator.kind](bars, indicator)


TIMEFRAMES: dict[str, Callable[[DataFrame], DataFrame]] = {"1h": lambda b: b, "4h": lambda b: B.rollup_minutes(b, 240), "1wk": B.rollup_weekly}
