"""Queries that run as streams: rows of the tables are delivered as files, and every stream is stopped and started again on its checkpoint between deliveries."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import bars as B
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.session import fresh_path
from tickloom.streaming import ohlc, store

DELIVERIES = 4


def _delivery(rows: DataFrame, time: str) -> tuple:
    """Numbers rows by their time into `DELIVERIES` equal spans; every seventh event comes late, by up to a thirtieth of the whole span. Also a watermark that covers it."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    first, last = rows.agg(F.min(seconds), F.max(seconds)).first()
    span = (last - first) or 1.0 if first is not None else 1.0
    comes = seconds - F.lit(first or 0.0) + F.when(F.col("event_id") % 7 == 0, span / 30).otherwise(0.0)
    return F.least(F.floor(comes / span * DELIVERIES), F.lit(DELIVERIES - 1)), f"{int(span / 15) + 1} seconds"


@query("sink_upsert_bars", A.ctes("rewrites") + " SELECT symbol, date, interval_type, arg_max(open, fetched_at) AS open, arg_max(close_price, fetched_at) AS close_price, arg_max(volume, fetched_at) AS volume, max(fetched_at) AS fetched_at FROM rewrites GROUP BY symbol, date, interval_type")
def _(spark, d):
    """Versions of bars in batches; each rewrites the parts that it touches, and one that comes twice changes nothing."""
    rows, path = A.rewrites(spark, d), fresh_path(spark)
    late = F.minute("fetched_at") >= 30
    for k, batch in enumerate((rows.where(~late), rows.where(late))):
        for _ in range(2):
            store.merge(path, batch, k)
        store.vacuum(spark, path)
    return store.read(spark, path, rows.schema)


@query("stream_developing_bar", A.ctes("rewrites") + " SELECT symbol, date, arg_max(close_price, fetched_at) AS close_price FROM rewrites WHERE date >= TIMESTAMP '2024-01-29' GROUP BY symbol, date")
def _(spark, d):
    """A stream of versions into the bar table; the newest version of the developing bar replaces the others."""
    rows = A.rewrites(spark, d).where(F.col("date") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    top = fresh_path(spark)
    drain = lambda _: ohlc.drain(ohlc.upsert_bars(ohlc.file_stream(rows, f"{top}/in"), f"{top}/bars", f"{top}/checkpoint"))
    ohlc.in_deliveries(rows, f"{top}/in", F.floor(F.minute("fetched_at") / 15), DELIVERIES, drain)
    return store.read(spark, f"{top}/bars", rows.schema).select("symbol", "date", "close_price")


@query("stream_tumbling_ohlc", A.ctes("ticks") + """ SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS date, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close_price, sum(volume)::BIGINT AS volume
FROM ticks GROUP BY symbol, time_bucket(INTERVAL 5 MINUTE, ts)""")
def _(spark, d):
    """Bars of a stream with a watermark; late ticks within it change their bar."""
    ticks, top = A.ticks(spark, d), fresh_path(spark)
    number, watermark = _delivery(ticks, "ts")
    part = F.date_format("date", "yyyy-MM-dd")

    def drain(_: int) -> None:
        bars = ohlc.tumbling_ohlc(ohlc.file_stream(ticks, f"{top}/in"), "5 minutes", watermark)
        ohlc.drain(ohlc.merged_into(bars, f"{top}/bars", f"{top}/checkpoint", ("symbol", "date"), part=part))

    ohlc.in_deliveries(ticks, f"{top}/in", number, DELIVERIES, drain)
    return store.read(spark, f"{top}/bars", ohlc.tumbling_ohlc(ticks, "5 minutes").schema)


@query("stream_ticker_cron", "SELECT event_id, CASE WHEN isodow(ts) <= 5 AND hour(ts) BETWEEN 13 AND 20 THEN 'regular' WHEN isodow(ts) = 7 AND hour(ts) IN (22, 23) THEN 'globex' END AS timer, time_bucket(INTERVAL 5 MINUTE, ts) AS fires_at FROM events")
def _(spark, d):
    """A stream that tells which timer takes each event, and when; appended to files once, restarts included."""
    events, top = A.table(spark, d, "events").select("event_id", "ts"), fresh_path(spark)
    number, _ = _delivery(events, "ts")
    timed = lambda rows: rows.select("event_id", X.ingestion_timer(F.col("ts")).alias("timer"), X.floor_minutes(F.col("ts"), 5).alias("fires_at"))

    def drain(_: int) -> None:
        stream = timed(ohlc.file_stream(events, f"{top}/in"))
        ohlc.drain(stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint"))

    ohlc.in_deliveries(events, f"{top}/in", number, DELIVERIES, drain)
    return spark.read.schema(timed(events).schema).parquet(f"{top}/out")


@query("stream_delta_since", A.ctes("rewrites") + " SELECT symbol, date, close_price, fetched_at FROM rewrites WHERE date >= TIMESTAMP '2024-01-25' AND (SELECT max(fetched_at) FROM rewrites) > TIMESTAMP '2024-01-20'")
def _(spark, d):
    """Polls between deliveries: each gives the rows since the last one, by committed offsets, and the last one, without news, none."""
    rows = A.rewrites(spark, d).select("symbol", "date", "close_price", "fetched_at")
    top, found = fresh_path(spark), []
    poll = lambda _: found.append(ohlc.poll(ohlc.file_stream(rows, f"{top}/in"), f"{top}/client"))
    ohlc.in_deliveries(rows, f"{top}/in", F.floor(F.minute("fetched_at") / 15), DELIVERIES, poll)
    poll(DELIVERIES)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where(F.col("date") >= F.lit("2024-01-25").cast("timestamp_ntz"))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@query("stream_live_tick_merge", A.ctes("ticks", "tight") + """, l AS (SELECT symbol, max(date) AS date, arg_max(open, date) AS open, arg_max(high, date) AS high, arg_max(low, date) AS low, arg_max(close_price, date) AS c, arg_max(volume, date) AS volume FROM tight GROUP BY symbol),
q AS (SELECT symbol, 100.0::DOUBLE + arg_max(price, ts) / 500 AS p FROM ticks GROUP BY symbol),
j AS (SELECT l.*, p, p > 0 AND abs(p - c) <= 0.01::DOUBLE * c AS moved FROM l JOIN q ON l.symbol = q.symbol)
SELECT symbol, date, open, CASE WHEN moved THEN greatest(high, p) ELSE high END AS high, CASE WHEN moved THEN least(low, p) ELSE low END AS low, CASE WHEN moved THEN p ELSE c END AS close_price, volume, moved FROM j""")
def _(spark, d):
    """Keyed state: each symbol's last bar, moved by the newest tick; late ticks change nothing."""
    from tickloom.streaming import live

    ticks = A.ticks(spark, d).withColumn("price", F.lit(100.0) + F.col("price") / 500)
    bars, top = A.tight_bars(spark, d), fresh_path(spark)
    number, _ = _delivery(ticks, "ts")

    def drain(_: int) -> None:
        out = live.live_bars(ohlc.file_stream(ticks, f"{top}/in"), bars)
        ohlc.drain(ohlc.merged_into(out, f"{top}/bars", f"{top}/checkpoint", ("symbol",), part=F.lit("all")))

    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", live.PROVIDER):
        ohlc.in_deliveries(ticks, f"{top}/in", number, DELIVERIES, drain)
    return store.read(spark, f"{top}/bars").drop("_batch")


@query("live_tick_batch", A.ctes("ticks", "tight") + """, l AS (SELECT symbol, max(date) AS date, arg_max(close_price, date) AS c FROM tight GROUP BY symbol), q AS (SELECT symbol, 100.0::DOUBLE + arg_max(price, ts) / 500 AS p FROM ticks GROUP BY symbol)
SELECT l.symbol, date, CASE WHEN p > 0 AND abs(p - c) <= 0.01::DOUBLE * c THEN p ELSE c END AS close_price FROM l JOIN q ON l.symbol = q.symbol""")
def _(spark, d):
    """The same from tables, as a join of last bars and newest ticks."""
    quotes = A.ticks(spark, d).groupBy("symbol").agg((F.lit(100.0) + F.max_by("price", B.tick_order(A.ticks(spark, d))) / 500).alias("price"))
    return B.live_tick(A.tight_bars(spark, d).drop("interval_type"), quotes).select("symbol", "date", "close_price")
