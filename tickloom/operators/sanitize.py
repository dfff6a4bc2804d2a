"""Repair of phantom prices in bars, its log, and its reversal.

The witness of a bar is the median of the positive closes among the five bars
before, else the close before. Closes are never changed, so a bar depends on raw
closes only and the operator is a window over rows, not a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import series as S
from tickloom.schemas import OUTLIER_SHARE, WITNESS_BARS


def witness() -> Column:
    frame = S.window().rowsBetween(-WITNESS_BARS, -1)
    median = F.percentile(F.when(F.col("close_price") > 0, F.col("close_price")), F.lit(0.5)).over(frame)
    before = F.lag("close_price").over(S.window())
    return F.coalesce(median, F.when(before > 0, before))


def repaired(close: Column, anchor: Column, share: float = OUTLIER_SHARE) -> dict[str, Column]:
    """New open, low and high of a bar with columns open, high, low; as they are if the close isn't positive."""
    limit = F.abs(close) * share
    off = lambda v: v.isNotNull() & (F.abs(v - close) > limit) & ~F.coalesce(F.abs(v - anchor) <= limit, F.lit(False))
    o, h, low = F.col("open"), F.col("high"), F.col("low")
    o2 = F.when(off(o), F.coalesce(anchor, close)).otherwise(o)
    low2 = F.when(off(low), F.least(o2, close)).otherwise(low)
    high2 = F.when(off(h), F.greatest(o2, close)).otherwise(h)
    good = close > 0
    return {"new_open": F.when(good, o2).otherwise(o), "new_low": F.when(good, F.least(low2, o2, close)).otherwise(low), "new_high": F.when(good, F.greatest(high2, o2, close)).otherwise(h)}


def sanitized(bars: DataFrame, share: float = OUTLIER_SHARE) -> DataFrame:
    """Bars with new_open, new_low, new_high beside the old ones."""
    with_witness = S.rolling(S.indexed(bars), WITNESS_BARS, {"_anchor": witness()})
    return with_witness.withColumns(repaired(F.col("close_price"), F.col("_anchor"), share)).drop("_anchor", "idx", "prev")


def changes(bars: DataFrame, share: float = OUTLIER_SHARE) -> DataFrame:
    """One row per changed bar: what a dry run reports."""
    return sanitized(bars, share).where("not (new_open <=> open and new_low <=> low and new_high <=> high)")


def applied(bars: DataFrame, edits: DataFrame, keys: tuple[str, ...] = ("symbol", "date")) -> DataFrame:
    """Bars with the open, high and low that `edits` (new_* columns, one row a key) has for their key."""
    e = edits.select(*[F.col(k).alias(f"_{k}") for k in keys], "new_open", "new_high", "new_low")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = bars.join(e, on, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("open", "high", "low") else F.col(c) for c in bars.columns])


def reverted(bars: DataFrame, log: DataFrame) -> DataFrame:
    """Old values from a repair log (symbol, date, field, old, position) put back; the last edit of a field wins."""
    last = log.groupBy("symbol", "date").agg(*[F.max_by(F.when(F.col("field") == c, F.col("old")), F.when(F.col("field") == c, F.col("position"))).alias(f"new_{c}") for c in ("open", "high", "low")])
    return applied(bars, last)
