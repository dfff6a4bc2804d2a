"""Bars: roll-ups, de-duplication, upserts, deltas and merges.

Bars have symbol, date and open, high, low, close_price, volume. Roll-ups are
hash aggregations with map-side partial results; "latest wins" is a max_by
aggregation, not a window, so a key with many versions stays one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators.series import indexed
from tickloom.schemas import BUFFER_DAYS, MONTHS, ROLLUP_MINUTES, STORED_INTERVAL, VALID_PERIODS

OHLC = ("open", "high", "low", "close_price")
KEY = ("symbol", "date", "interval_type")


def ohlcv(order: str = "date") -> list[Column]:
    return [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close_price", order).alias("close_price"), F.sum(F.coalesce("volume", F.lit(0))).alias("volume"),
    ]


def tick_order(ticks: DataFrame) -> Column:
    """By time, then by id where ticks have one."""
    return F.struct("ts", "event_id") if "event_id" in ticks.columns else F.col("ts")


def bars_of_ticks(ticks: DataFrame, minutes: int) -> DataFrame:
    """Ticks (symbol, ts, price, volume, and event_id to order ticks of one time) to n-minute bars."""
    at = tick_order(ticks)
    return ticks.groupBy("symbol", X.floor_minutes(F.col("ts"), minutes).alias("date")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close_price"), F.sum("volume").alias("volume")
    )


def rollup_minutes(bars: DataFrame, n: int) -> DataFrame:
    return bars.groupBy("symbol", X.floor_minutes(F.col("date"), n).alias("bucket")).agg(*ohlcv()).withColumnRenamed("bucket", "date")


def rollup_weekly(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", X.monday(F.col("date")).alias("bucket")).agg(*ohlcv()).withColumnRenamed("bucket", "date")


def rollup(bars: DataFrame, interval: str) -> DataFrame:
    """Stored bars to the requested interval; stored intervals pass through."""
    if interval == "1wk":
        return rollup_weekly(bars)
    return rollup_minutes(bars, ROLLUP_MINUTES[interval]) if interval in ROLLUP_MINUTES else bars


def stored_interval(interval: str | Column) -> str | Column:
    """The coarsest stored interval that can answer the requested one; 1m for unknown ones."""
    if isinstance(interval, Column):
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STORED_INTERVAL.items() for x in kv]), interval), F.lit("1m"))
    return STORED_INTERVAL.get(interval, "1m")


def valid_period(interval: Column, period: Column) -> Column:
    """Whether a chart of the interval may show the period."""
    allowed = F.create_map(*[x for i, ps in VALID_PERIODS.items() for x in (F.lit(i), F.array(*map(F.lit, ps)))])
    return F.coalesce(F.array_contains(F.try_element_at(allowed, interval), period), F.lit(False))


def tick_bars(bars: DataFrame, n: int) -> DataFrame:
    """Every n consecutive bars become one; the last may be short."""
    numbered = indexed(bars).withColumn("bar", F.floor(F.col("idx") / n))
    return numbered.groupBy("symbol", "bar").agg(F.min("date").alias("first_date"), *ohlcv()).select("symbol", F.col("first_date").alias("date"), *OHLC, "volume")


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Per key, the row of the highest `order` (a tie goes to the larger row)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = KEY, order: str = "fetched_at") -> DataFrame:
    """Incoming rows replace stored ones of the same key unless they are older."""
    return latest(stored.unionByName(incoming), keys, order)


def dedup(rows: DataFrame, keys: list[str], position: str, last: bool = False) -> DataFrame:
    """First (or last) row per key by position."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), position).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def minus_period(ts: Column, period: str) -> Column | None:
    """ts less a period such as 5d, 3mo or 2y; None for max and unknown ones."""
    if period in BUFFER_DAYS:
        return (ts - F.make_interval(days=F.lit(int(period[:-1])))).cast("timestamp_ntz")
    return (ts - F.make_interval(months=F.lit(MONTHS[period]))).cast("timestamp_ntz") if period in MONTHS else None


def trim_period(bars: DataFrame, period: str) -> DataFrame:
    """Bars not before the symbol's last bar less the period. The anchor is an aggregate, joined back."""
    if minus_period(F.lit(None), period) is None:
        return bars
    anchor = bars.groupBy(F.col("symbol").alias("_symbol")).agg(minus_period(F.max("date"), period).alias("_from"))
    return bars.join(anchor, (F.col("symbol") == F.col("_symbol")) & (F.col("date") >= F.col("_from"))).drop("_symbol", "_from")


def cutoff(now: Column, period: str) -> Column | None:
    """Loose cutoff of the stored scan: the period and some days for weekends."""
    if period in BUFFER_DAYS:
        return (now - F.make_interval(days=F.lit(BUFFER_DAYS[period]))).cast("timestamp_ntz")
    start = minus_period(now, period)
    return None if start is None else (start - F.make_interval(days=F.lit(7))).cast("timestamp_ntz")


def floor_of(now: Column, stored: str) -> Column | None:
    """How far back a stored interval may be read at all."""
    back = {"1m": F.make_interval(days=F.lit(30)), "5m": F.make_interval(months=F.lit(6)), "1h": F.make_interval(months=F.lit(60))}.get(stored)
    return None if back is None else (now - back).cast("timestamp_ntz")


def read_bars(bars: DataFrame, symbol: str | None, interval: str, period: str, now: Column) -> DataFrame:
    """The chart read: stored interval, cutoff clamped to the floor, roll-up, trim to the period."""
    stored = stored_interval(interval)
    rows = bars.where(F.col("interval_type") == stored)
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    limits = [x for x in (cutoff(now, period), floor_of(now, stored)) if x is not None]
    if limits:
        rows = rows.where(F.col("date") >= (F.greatest(*limits) if len(limits) > 1 else limits[0]))
    return trim_period(rollup(rows, interval), period)


def delta_since(bars: DataFrame, since: Column, last_fetched: Column) -> DataFrame:
    """Bars from `since` on, or none if nothing was fetched after `last_fetched`; the probe is one aggregate row."""
    probe = bars.agg(F.max("fetched_at").alias("_newest"))
    return bars.where(F.col("date") >= since).join(probe, F.col("_newest") > last_fetched).drop("_newest")


def replace_from(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old bars before a symbol's first new bar, and all new bars."""
    first = new.groupBy(F.col("symbol").alias("_symbol")).agg(F.min("date").alias("_first"))
    kept = old.join(first, F.col("symbol") == F.col("_symbol"), "left").where("_first is null or date < _first").drop("_symbol", "_first")
    return kept.unionByName(new)


def live_tick(bars: DataFrame, quotes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Each symbol's last bar moved by its live price: close set, high and low stretched, volume untouched.

    Prices that aren't positive, or off the close by more than the tolerance, leave the bar alone.
    """
    last = latest(bars, ("symbol",), "date")
    q = quotes.select(F.col("symbol").alias("_symbol"), F.col("price").alias("_price"))
    good = F.coalesce((F.col("_price") > 0) & (F.abs(F.col("_price") - F.col("close_price")) <= tolerance * F.col("close_price")), F.lit(False))
    p = F.col("_price")
    return last.join(q, F.col("symbol") == F.col("_symbol"), "left").select(
        "symbol", "date", "open", F.when(good, F.greatest("high", p)).otherwise(F.col("high")).alias("high"), F.when(good, F.least("low", p)).otherwise(F.col("low")).alias("low"),
        F.when(good, p).otherwise(F.col("close_price")).alias("close_price"), "volume", good.alias("moved"),
    )


def delete_series(bars: DataFrame, symbol: str, interval: str) -> DataFrame:
    return bars.where(~((F.col("symbol") == symbol) & (F.col("interval_type") == interval)))


def api_rows(bars: DataFrame, intraday: bool) -> DataFrame:
    """Rows of the read API as JSON: complete prices only; epoch seconds as text for intraday bars, else the ISO date."""
    when = F.unix_timestamp(F.col("date").cast("timestamp")).cast("string") if intraday else F.date_format("date", "yyyy-MM-dd")
    return bars.dropna(subset=list(OHLC)).select("symbol", when.alias("date"), F.to_json(F.struct(when.alias("date"), F.coalesce("volume", F.lit(0)).alias("volume"))).alias("json"), *OHLC)
