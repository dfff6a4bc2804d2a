"""Backward as-of join with a staleness limit, by time buckets.

A match is at most `minutes` old, so with buckets of that width it lies in the
row's own bucket or the one before. Right rows go to two buckets; left and right
rows of a bucket meet in one window. One shuffle and one sort, in groups that
time bounds: no symbol's whole history meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.schemas import STALE_MINUTES


def asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: str = "symbol", minutes: int = STALE_MINUTES, age: str = "age_minutes") -> DataFrame:
    """Each left row with the newest right row not after it and at most `minutes` old; others drop. Adds `age`.

    Of right rows of one time, the one of the largest remaining columns counts.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = minutes * 60_000_000
    l_cols, r_cols = left.columns, [c for c in right.columns if c != by]
    lefts = left.select(F.col(by).alias("_by"), micros(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*l_cols).alias("_l"), F.lit(None).cast(right.select(F.struct(*r_cols).alias("x")).schema["x"].dataType).alias("_r"))
    rights = right.groupBy(by, right_ts).agg(F.max(F.struct(*r_cols)).alias("_r")).select(F.col(by).alias("_by"), micros(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_l"].dataType).alias("_l"), "_r")
    bucket = F.floor(F.col("_t") / width)
    both = lefts.withColumn("_bucket", bucket).unionByName(rights.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))))
    seen = Window.partitionBy("_by", "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_r").alias("r"))), ignorenulls=True).over(seen)
    matched = both.withColumn("_m", newest).where(f"_side = 1 and _m is not null and _t - _m.t <= {width}")
    return matched.select("_l.*", *[F.col(f"_m.r.{c}").alias(c) for c in r_cols], ((F.col("_t") - F.col("_m.t")) / F.lit(60_000_000.0)).alias(age))
