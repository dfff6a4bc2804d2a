"""Row numbers, running totals and ranks over a whole table, without sorting it in one task.

The table is range-partitioned and checkpointed once, so that partition numbers
stay put; rows are numbered inside their partition and shifted by the totals of
the partitions before, of which there are as many rows as partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """In the shared folder of spark.checkpoint.dir."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def running_total(rows: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Adds the sum of `amount` up to and including each row, in the given order (which has to be total)."""
    placed = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(amount).alias("_total"))
    before = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(before, "_part").withColumn(out, local + F.col("_before")).drop("_part", "_before")


def numbered(rows: DataFrame, order: list[str], out: str = "row") -> DataFrame:
    """Adds the row number from 0. Rows are shuffled once, into ranges: each range is sorted and counted where it lies, however large it is."""
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))  # partition * 2 ** 33 + place in it
    part = F.shiftright("_id", 33)
    totals = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_total"))  # a row a partition
    before = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.col("_id").bitwiseAND(F.lit(2**33 - 1))
    return placed.join(F.broadcast(checkpointed(before)), part == F.col("_part")).withColumn(out, at + F.col("_before")).drop("_id", "_part", "_before")


def average_ranks(rows: DataFrame, columns: list[str], suffix: str = "_rank") -> DataFrame:
    """Adds each value's mean rank from 1, ties shared; values are counted first, so a frequent one is one row a task."""
    for c in columns:
        counts = running_total(rows.groupBy(c).agg(F.count("*").alias("_n")), [c], "_n", "_upto")
        ranks = counts.select(F.col(c).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(f"{c}{suffix}"))
        rows = rows.join(ranks, F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
    return rows
