"""Streams over files of ticks: tumbling bars, merges into a bar table, deltas by committed offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickloom.operators.bars import KEY, tick_order
from tickloom.streaming import store


def tumbling_ohlc(ticks: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Bars of a tumbling window; the same expression serves batch and stream. With a watermark, state is bounded, and ticks that come later than it are left out."""
    at = tick_order(ticks)
    if watermark is not None:
        ticks = ticks.withColumn("_at", at).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        at = F.col("_at")
    out = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close_price"), F.sum("volume").alias("volume")
    )
    return out.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("date"), "open", "high", "low", "close_price", "volume")


def file_stream(like: DataFrame, path: str, **options) -> DataFrame:
    """A stream over the Parquet files of a folder, in the order of their arrival."""
    return like.sparkSession.readStream.schema(like.schema).options(**options).parquet(path)


def drain(writer: DataStreamWriter) -> None:
    """Runs a stream over what is there, then stops it; started again on its checkpoint, it goes on from there."""
    writer.trigger(availableNow=True).start().awaitTermination()


def merged_into(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = KEY, order: str | None = None, **options) -> DataStreamWriter:
    """A stream whose batches are merged into the table at `path` (see :mod:`tickloom.streaming.store`).

    Without `order`, rows of a later batch replace those of an earlier one: for streams in update mode.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.merge(path, batch if order else batch.withColumn("_batch", F.lit(batch_id)), batch_id, checkpoint, keys, order or "_batch", **options)
        store.vacuum(batch.sparkSession, path)

    return stream.writeStream.outputMode("append" if order else "update").foreachBatch(write).option("checkpointLocation", checkpoint)


def upsert_bars(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = KEY, order: str = "fetched_at") -> DataStreamWriter:
    """Versions of bars, merged into the table: the newest of each key stays."""
    return merged_into(stream, path, checkpoint, keys, order)


def read_upserted(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The current rows, with the columns of `like`."""
    return store.read(spark, path, None if like is None else like.schema)


def poll(stream: DataFrame, state: str) -> DataFrame:
    """Rows that came since the last poll with this `state` folder, by the offsets committed there; a poll without news has none."""
    spark, done = stream.sparkSession, []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/rows/{batch_id}")  # again, should the commit have been lost
        done.append(f"{state}/rows/{batch_id}")

    drain(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/offsets"))
    return spark.read.schema(stream.schema).parquet(*done) if done else spark.createDataFrame([], stream.schema)


def in_deliveries(rows: DataFrame, path: str, number: Column, count: int, after: Callable[[int], None]) -> None:
    """Appends the rows numbered 0, 1, ... count - 1 to the files at `path`, one delivery after another, and calls `after` behind each."""
    marked = rows.withColumn("_delivery", number)
    for k in range(count):
        marked.where(F.col("_delivery") == k).drop("_delivery").write.mode("append").parquet(path)
        after(k)
