"""Long series in blocks: row numbers, rolling windows with a halo, and linear recurrences as block scans.

A symbol may hold a third of all rows, so no step sorts a symbol's whole history
in one task. Rows are numbered within a month and shifted by the counts of the
months before (a small table). Rolling windows run on blocks of consecutive
rows; the rows that a window reaches back (or ahead) to are copied into the
neighbour block and dropped afterwards. A recurrence y = q y' + w is a sum with
geometric weights inside a block, plus what the blocks before carry over.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLL_BLOCK, SCAN_BLOCK = 4096, 512


def indexed(rows: DataFrame, value: str = "close_price") -> DataFrame:
    """Adds `idx` (from 0, by date within the symbol) and `prev` (the value of the row before)."""
    month = Window.partitionBy("symbol", "_month").orderBy("date")
    local = rows.withColumn("_month", F.date_trunc("month", "date")).withColumns({"_rn": F.row_number().over(month), "_lag": F.lag(value).over(month)})
    by_month = local.groupBy("symbol", "_month").agg(F.count("*").alias("_n"), F.max_by(value, "date").alias("_last"))
    order = Window.partitionBy("symbol").orderBy("_month")
    before = by_month.select("symbol", "_month", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last").over(order).alias("_carried"))
    joined = local.join(before, ["symbol", "_month"])
    return joined.withColumns({"idx": F.col("_before") + F.col("_rn") - 1, "prev": F.coalesce("_lag", "_carried")}).drop("_month", "_rn", "_lag", "_before", "_carried")


def in_blocks(rows: DataFrame, back: int, ahead: int = 0, size: int = ROLL_BLOCK) -> DataFrame:
    """Rows with `_block`; the last `back` rows of a block also go to the next one, the first `ahead` also to the one before."""
    if max(back, ahead) > size:
        raise ValueError(f"a window of over {size} rows needs larger blocks")
    own, at = F.floor(F.col("idx") / size), F.col("idx") % size
    targets = F.array_compact(F.array(own, F.when(at >= size - back, own + 1), F.when(at < ahead, own - 1)))
    return rows.withColumn("_block", F.explode(targets)).withColumn("_halo", F.col("_block") != own)


def rolling(rows: DataFrame, back: int, columns: dict[str, Column], ahead: int = 0, size: int = ROLL_BLOCK) -> DataFrame:
    """Adds columns that are window functions over `window()` frames of at most `back` rows before and `ahead` after."""
    done = in_blocks(rows, back, ahead, size).withColumns(columns)
    return done.where(~F.col("_halo")).drop("_block", "_halo")


def window():
    """Rows of a block in order of date; for the columns given to `rolling`."""
    return Window.partitionBy("symbol", "_block").orderBy("date")


def last_rows(n: int):
    return window().rowsBetween(1 - n, 0)


def full(value: Column, of: Column, n: int) -> Column:
    """value, once the last n rows all have `of`."""
    return F.when(F.count(of).over(last_rows(n)) == n, value)


def mean(x: Column, n: int) -> Column:
    return full(F.avg(x).over(last_rows(n)), x, n)


def deviation(x: Column, n: int, population: bool = False) -> Column:
    return full((F.stddev_pop if population else F.stddev_samp)(x).over(last_rows(n)), x, n)


def recurrence(rows: DataFrame, out: str, weight: Column, q: float) -> DataFrame:
    """Adds out[i] = q * out[i - 1] + weight[i], by idx within the symbol (null weights count 0)."""
    k, order = F.col("idx") % SCAN_BLOCK, Window.partitionBy("symbol", "_scan").orderBy("idx")
    local = rows.withColumn("_scan", F.floor(F.col("idx") / SCAN_BLOCK))
    local = local.withColumn("_local", F.pow(F.lit(q), k) * F.sum(F.coalesce(weight, F.lit(0.0)) * F.pow(F.lit(q), -k)).over(order))
    ends = local.groupBy("symbol", "_scan").agg(F.max_by("_local", "idx").alias("_end"))
    reach = 1 if q == 0 else max(1, ceil(40 / (SCAN_BLOCK * -log(q))))  # beyond, a block's weight is below 1e-17
    blocks = Window.partitionBy("symbol").orderBy("_scan")
    carried = sum((F.coalesce(F.lag("_end", j).over(blocks), F.lit(0.0)) * F.lit(q ** (SCAN_BLOCK * (j - 1))) for j in range(1, reach + 1)), F.lit(0.0))
    ends = ends.select("symbol", "_scan", carried.alias("_carry"))
    return local.join(ends, ["symbol", "_scan"]).withColumn(out, F.col("_local") + F.pow(F.lit(q), k + 1) * F.col("_carry")).drop("_scan", "_local", "_carry")


def running_sums(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds running sums from the first row of the symbol: within the block, plus the totals of the blocks before."""
    local = rows.withColumn("_scan", F.floor(F.col("idx") / ROLL_BLOCK))
    order = Window.partitionBy("symbol", "_scan").orderBy("idx")
    totals = local.groupBy("symbol", "_scan").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in columns.items()])
    blocks = Window.partitionBy("symbol").orderBy("_scan").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("symbol", "_scan", *[F.coalesce(F.sum(f"_t_{n}").over(blocks), F.lit(0.0)).alias(f"_b_{n}") for n in columns])
    local = local.withColumns({f"_s_{n}": F.sum(c).over(order) for n, c in columns.items()})
    done = local.join(totals, ["symbol", "_scan"]).withColumns({n: F.col(f"_s_{n}") + F.col(f"_b_{n}") for n in columns})
    return done.drop("_scan", *[f"_{x}_{n}" for x in "sb" for n in columns])
