"""Queries over bars: scans, filters, roll-ups, upserts, deltas and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import bars as B
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.schemas import VALID_PERIODS

OHLCV = "symbol, date, open, high, low, close_price, volume"
NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _agg_sql(view: str, bucket: str, *more: str) -> str:
    return f"""{A.ctes(view)} SELECT symbol, {bucket} AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close_price, date) AS close_price, sum(volume)::BIGINT AS volume
FROM {view} GROUP BY symbol, {bucket}"""


@query("proj_bars", A.ctes("bars") + " SELECT date, open, high, low, close_price, volume FROM bars")
def _(spark, d):
    return A.bars_1h(spark, d).select("date", *B.OHLC, "volume")


@query("sort_bars", A.ctes("bars") + f" SELECT {OHLCV}, row_number() OVER (PARTITION BY symbol ORDER BY date) AS position FROM bars")
def _(spark, d):
    from tickloom.operators.series import indexed

    return indexed(A.bars_1h(spark, d)).select(*OHLCV.split(", "), (F.col("idx") + 1).alias("position"))


@query("agg_ohlc_nmin", _agg_sql("bars", "date_trunc('day', date) + to_hours(CAST(floor(hour(date) / 4) * 4 AS BIGINT))"))
def _(spark, d):
    return B.rollup_minutes(A.bars_1h(spark, d), 240)


@query("agg_ohlc_15min", _agg_sql("bars5", "time_bucket(INTERVAL 15 MINUTE, date)"))
def _(spark, d):
    return B.rollup_minutes(A.bars_5m(spark, d), 15)


@query("agg_ohlc_30min", _agg_sql("bars5", "time_bucket(INTERVAL 30 MINUTE, date)"))
def _(spark, d):
    return B.rollup_minutes(A.bars_5m(spark, d), 30)


@query("agg_ohlc_weekly", _agg_sql("bars", "date_trunc('week', date)::TIMESTAMP"))
def _(spark, d):
    return B.rollup_weekly(A.bars_1h(spark, d))


@query(
    "agg_tick_bars",
    A.ctes("bars")
    + """, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) // 10 AS bar FROM bars)
SELECT symbol, min(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close_price, date) AS close_price, sum(volume)::BIGINT AS volume FROM n GROUP BY symbol, bar""",
)
def _(spark, d):
    return B.tick_bars(A.bars_1h(spark, d), 10)


@query(
    "agg_minute_merge",
    A.ctes("ticks")
    + """ SELECT symbol, date_trunc('minute', ts) AS date, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close_price, sum(volume)::BIGINT AS volume
FROM ticks GROUP BY symbol, date_trunc('minute', ts)""",
)
def _(spark, d):
    return B.bars_of_ticks(A.ticks(spark, d), 1)


@query("agg_max_date", A.ctes("bars") + " SELECT symbol, '1h' AS interval_type, max(date) AS max_date FROM bars GROUP BY symbol")
def _(spark, d):
    return A.bars_1h(spark, d).groupBy("symbol", "interval_type").agg(F.max("date").alias("max_date"))


@query("agg_max_fetched", A.ctes("rewrites") + " SELECT symbol, interval_type, max(fetched_at) AS max_fetched FROM rewrites GROUP BY ALL")
def _(spark, d):
    return A.rewrites(spark, d).groupBy("symbol", "interval_type").agg(F.max("fetched_at").alias("max_fetched"))


@query("agg_count_by_interval", A.ctes("bars", "bars5") + " SELECT interval_type, count(*) AS n FROM (SELECT '1h' AS interval_type FROM bars UNION ALL SELECT '5m' FROM bars5) GROUP BY interval_type")
def _(spark, d):
    return A.bars_1h(spark, d).unionByName(A.bars_5m(spark, d)).groupBy("interval_type").agg(F.count("*").alias("n"))


@query("agg_distinct", A.ctes("bars") + " SELECT symbol, count(DISTINCT date::DATE) AS trading_days FROM bars GROUP BY symbol")
def _(spark, d):
    return A.bars_1h(spark, d).groupBy("symbol").agg(F.countDistinct(F.to_date("date")).alias("trading_days"))


@query("agg_dedup_first", A.ctes("rewrites") + " SELECT symbol, date, arg_min(close_price, fetched_at) AS close_price, min(fetched_at) AS fetched_at FROM rewrites GROUP BY symbol, date")
def _(spark, d):
    return B.dedup(A.rewrites(spark, d).select("symbol", "date", "close_price", "fetched_at"), ["symbol", "date"], "fetched_at")


@query("agg_dedup_last", A.ctes("rewrites") + " SELECT symbol, date, arg_max(close_price, fetched_at) AS close_price, max(fetched_at) AS fetched_at FROM rewrites GROUP BY symbol, date")
def _(spark, d):
    return B.dedup(A.rewrites(spark, d).select("symbol", "date", "close_price", "fetched_at"), ["symbol", "date"], "fetched_at", last=True)


@query("sink_upsert_snapshot", A.ctes("ticks") + " SELECT symbol, arg_max(price, ts) AS price, arg_max(volume, ts) AS volume, max(ts) AS timestamp FROM ticks GROUP BY symbol")
def _(spark, d):
    t = A.ticks(spark, d).select("symbol", "price", "volume", F.col("ts").alias("timestamp"))
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    return B.upsert(t.where(F.col("timestamp") < half), t.where(F.col("timestamp") >= half), ("symbol",), "timestamp")


@query("stream_late_rows", A.ctes("rewrites") + " SELECT symbol, date, count(*) AS versions, arg_max(volume, fetched_at) AS volume FROM rewrites GROUP BY symbol, date")
def _(spark, d):
    return A.rewrites(spark, d).groupBy("symbol", "date").agg(F.count("*").alias("versions"), F.max_by("volume", "fetched_at").alias("volume"))


@query("sink_delete_series", A.ctes("bars") + f" SELECT {OHLCV} FROM bars WHERE NOT (symbol = 'click')")
def _(spark, d):
    return B.delete_series(A.bars_1h(spark, d), "click", "1h").select(*OHLCV.split(", "))


@query(
    "sink_api_json",
    A.ctes("bars")
    + """ SELECT symbol, epoch(date)::BIGINT::VARCHAR AS date, '{"date":"' || epoch(date)::BIGINT || '","volume":' || volume || '}' AS json, open, high, low, close_price FROM bars
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close_price IS NOT NULL""",
)
def _(spark, d):
    return B.api_rows(A.bars_1h(spark, d), True)


@query("filter_period_db", A.ctes("bars") + f" SELECT {OHLCV} FROM bars WHERE date >= TIMESTAMP '{NOW}' - INTERVAL 12 DAY")
def _(spark, d):
    return A.bars_1h(spark, d).where(F.col("date") >= B.cutoff(_now(), "5d")).select(*OHLCV.split(", "))


@query("filter_lookback_floor", A.ctes("bars") + f" SELECT {OHLCV} FROM bars WHERE date >= greatest(TIMESTAMP '{NOW}' - INTERVAL 1 YEAR - INTERVAL 7 DAY, TIMESTAMP '{NOW}' - INTERVAL 30 DAY)")
def _(spark, d):
    return A.bars_1h(spark, d).where(F.col("date") >= F.greatest(B.cutoff(_now(), "1y"), B.floor_of(_now(), "1m"))).select(*OHLCV.split(", "))


@query("filter_period_anchor", A.ctes("bars") + f" SELECT {OHLCV} FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS m FROM bars) WHERE date >= m - INTERVAL 5 DAY")
def _(spark, d):
    return B.trim_period(A.bars_1h(spark, d), "5d").select(*OHLCV.split(", "))


@query(
    "top_last_bar",
    A.ctes("bars") + " SELECT symbol, max(date) AS date, arg_max(close_price, date) AS close_price FROM bars GROUP BY symbol",
)
def _(spark, d):
    return B.latest(A.bars_1h(spark, d).select("symbol", "date", "close_price"), ("symbol",), "date")


@query("filter_since", A.ctes("bars").replace("FROM ticks GROUP BY symbol", "FROM ticks GROUP BY symbol") + f""", s AS (SELECT * FROM bars WHERE date >= TIMESTAMP '2024-01-20 06:00:00')
SELECT symbol, date_trunc('day', date) + to_hours(CAST(floor(hour(date) / 4) * 4 AS BIGINT)) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close_price, date) AS close_price, sum(volume)::BIGINT AS volume
FROM s GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY symbol, date_trunc('day', date) + to_hours(CAST(floor(hour(date) / 4) * 4 AS BIGINT))"))
def _(spark, d):
    return B.rollup_minutes(A.bars_1h(spark, d).where(F.col("date") >= F.lit("2024-01-20 06:00:00").cast("timestamp_ntz")), 240)


@query(
    "chart_read",
    A.ctes("bars")
    + f""", r AS (SELECT symbol, date_trunc('day', date) + to_hours(CAST(floor(hour(date) / 4) * 4 AS BIGINT)) AS b, * EXCLUDE (symbol) FROM bars WHERE date >= TIMESTAMP '{NOW}' - INTERVAL 1 MONTH - INTERVAL 7 DAY),
g AS (SELECT symbol, b AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close_price, date) AS close_price, sum(volume)::BIGINT AS volume FROM r GROUP BY symbol, b)
SELECT {OHLCV} FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS m FROM g) WHERE date >= m - INTERVAL 1 MONTH""",
)
def _(spark, d):
    return B.read_bars(A.bars_1h(spark, d), None, "4h", "1mo", _now()).select(*OHLCV.split(", "))


@query("filter_null_ohlc", A.ctes("bars") + " SELECT symbol, date, close_price FROM (SELECT *, CASE WHEN volume % 7 = 0 THEN NULL ELSE open END AS o FROM bars) WHERE o IS NOT NULL")
def _(spark, d):
    return A.bars_1h(spark, d).withColumn("open", F.when(F.col("volume") % 7 != 0, F.col("open"))).dropna(subset=list(B.OHLC)).select("symbol", "date", "close_price")


@query("filter_valid_period", """SELECT event_id, interval, period FROM (SELECT event_id, ['1m', '5m', '15m', '30m', '1h', '4h', '1d', '1wk', '2h'][event_id % 9 + 1] AS interval, ['1d', '5d', '10d', '14d', '1mo', '3mo', '6mo', '1y', '2y', 'max'][event_id // 9 % 10 + 1] AS period FROM events)
WHERE CASE interval WHEN '1m' THEN period IN ('1d', '5d') WHEN '5m' THEN period IN ('1d', '5d', '10d', '14d', '1mo', '3mo') WHEN '15m' THEN period IN ('1d', '5d', '10d', '14d', '1mo', '3mo') WHEN '30m' THEN period IN ('1d', '5d', '10d', '14d', '1mo', '3mo')
WHEN '1h' THEN period <> 'max' WHEN '4h' THEN period <> 'max' WHEN '1d' THEN true WHEN '1wk' THEN period NOT IN ('1d', '5d', '10d', '14d') ELSE false END""")
def _(spark, d):
    """Requests of an interval and a period, dealt out by id; 2h isn't served."""
    dealt = lambda key, values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    i = F.col("event_id")
    asked = A.table(spark, d, "events").select("event_id", dealt(i, (*VALID_PERIODS, "2h")).alias("interval"), dealt(F.floor(i / 9), VALID_PERIODS["1d"]).alias("period"))
    return asked.where(B.valid_period(F.col("interval"), F.col("period")))


@query("filter_dynamic_groups", A.ctes("bars", "bars5") + " SELECT DISTINCT symbol, interval_type FROM (SELECT symbol, '1h' AS interval_type FROM bars UNION ALL SELECT symbol, '5m' FROM bars5) WHERE symbol <> 'view'")
def _(spark, d):
    return A.bars_1h(spark, d).unionByName(A.bars_5m(spark, d)).where("symbol <> 'view'").select("symbol", "interval_type").distinct().orderBy("symbol", "interval_type")


@query("filter_time_range", A.ctes("bars") + " SELECT symbol, date, volume FROM bars WHERE date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-08' AND volume > 0")
def _(spark, d):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-08", "2024-01-03"))
    return A.bars_1h(spark, d).where(F.col("date").between(F.least(a, b), F.greatest(a, b)) & (F.col("volume") > 0)).select("symbol", "date", "volume")


@query("set_replace_merge", A.ctes("bars") + """, n AS (SELECT symbol, date, close_price + 1 AS close_price FROM bars WHERE date >= TIMESTAMP '2024-01-28'), f AS (SELECT symbol, min(date) AS first FROM n GROUP BY symbol)
SELECT b.symbol, b.date, b.close_price FROM bars b LEFT JOIN f ON b.symbol = f.symbol WHERE f.first IS NULL OR b.date < f.first UNION ALL SELECT * FROM n""")
def _(spark, d):
    b = A.bars_1h(spark, d).select("symbol", "date", "close_price")
    new = b.where(F.col("date") >= F.lit("2024-01-28").cast("timestamp_ntz")).withColumn("close_price", F.col("close_price") + 1)
    return B.replace_from(b, new)


@query("stream_live_merge", A.ctes("ticks", "bars") + """, n AS (SELECT symbol, date_trunc('minute', ts) AS date, arg_max(price, ts) AS close_price FROM ticks WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY symbol, date_trunc('minute', ts)),
f AS (SELECT symbol, min(date) AS first FROM n GROUP BY symbol)
SELECT b.symbol, b.date, b.close_price FROM bars b LEFT JOIN f ON b.symbol = f.symbol WHERE f.first IS NULL OR b.date < f.first UNION ALL SELECT * FROM n""")
def _(spark, d):
    live = B.bars_of_ticks(A.ticks(spark, d).where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")), 1)
    return B.replace_from(A.bars_1h(spark, d).select("symbol", "date", "close_price"), live.select("symbol", "date", "close_price"))


@query("limit_pages", A.ctes("bars") + f" SELECT {OHLCV} FROM bars ORDER BY symbol, date LIMIT 1000 OFFSET 1000")
def _(spark, d):
    return A.bars_1h(spark, d).select(*OHLCV.split(", ")).orderBy("symbol", "date").offset(1000).limit(1000)


@query("proj_volume_color", A.ctes("bars") + " SELECT symbol, date, volume, CASE WHEN close_price >= open THEN 'up' ELSE 'down' END AS direction FROM bars")
def _(spark, d):
    return A.bars_1h(spark, d).select("symbol", "date", "volume", F.when(F.col("close_price") >= F.col("open"), "up").otherwise("down").alias("direction"))


@query("proj_line_series", A.ctes("bars") + " SELECT symbol, date, close_price AS value FROM bars")
def _(spark, d):
    return A.bars_1h(spark, d).select("symbol", "date", F.col("close_price").alias("value"))


@query("proj_close_label", A.ctes("bars5") + """, g AS (SELECT coalesce(epoch(max(date) FILTER (WHERE r = 2)) - epoch(max(date) FILTER (WHERE r = 1)), 60)::BIGINT AS step FROM (SELECT date, row_number() OVER (ORDER BY date) AS r FROM bars5))
SELECT date, strftime(date + to_seconds(step), '%H:%M') AS label FROM bars5, g""")
def _(spark, d):
    b = A.bars_5m(spark, d).select("date")
    first = b.orderBy("date").limit(2).agg((F.unix_timestamp(F.max("date").cast("timestamp")) - F.unix_timestamp(F.min("date").cast("timestamp"))).alias("gap"))
    step = first.select(F.when(F.col("gap") > 0, F.col("gap")).otherwise(60).alias("step"))
    return b.crossJoin(F.broadcast(step)).select("date", F.date_format(F.col("date") + F.make_interval(secs=F.col("step")), "HH:mm").alias("label"))


@query("join_quote_lookup", A.ctes("ticks") + " SELECT w.symbol, t.price, t.volume FROM (VALUES ('click'), ('purchase'), ('nosuch')) w(symbol) LEFT JOIN (SELECT symbol, arg_max(price, ts) AS price, arg_max(volume, ts) AS volume FROM ticks GROUP BY symbol) t ON w.symbol = t.symbol")
def _(spark, d):
    wanted = spark.createDataFrame([("click",), ("purchase",), ("nosuch",)], "symbol string")
    newest = B.latest(A.ticks(spark, d).select("symbol", "price", "volume", "ts"), ("symbol",), "ts").drop("ts")
    return wanted.join(newest, "symbol", "left")


@query("proj_quote_fallback", A.ctes("ticks") + """, s AS (SELECT symbol, arg_max(price, ts) AS price, arg_max(volume, ts) AS volume FROM ticks GROUP BY symbol),
l AS (SELECT symbol, CASE WHEN symbol < 'login' THEN price + 1 END AS price, volume + 5 AS volume, price AS pc FROM s WHERE symbol <> 'view')
SELECT s.symbol, CASE WHEN l.price IS NOT NULL THEN l.price ELSE s.price END AS price, CASE WHEN l.price IS NOT NULL THEN l.volume ELSE s.volume END AS volume, l.pc AS previous_close FROM s LEFT JOIN l ON s.symbol = l.symbol""")
def _(spark, d):
    s = B.latest(A.ticks(spark, d).select("symbol", "price", "volume", "ts"), ("symbol",), "ts").drop("ts")
    live = s.where("symbol <> 'view'").select(F.col("symbol").alias("s2"), F.when(F.col("symbol") < "login", F.col("price") + 1).alias("live_price"), (F.col("volume") + 5).alias("live_volume"), F.col("price").alias("previous_close"))
    on = F.col("live_price").isNotNull()
    return s.join(live, F.col("symbol") == F.col("s2"), "left").select("symbol", F.when(on, F.col("live_price")).otherwise(F.col("price")).alias("price"), F.when(on, F.col("live_volume")).otherwise(F.col("volume")).alias("volume"), "previous_close")


@query("proj_change", A.ctes("bars") + """, c AS (SELECT symbol, date, close_price AS price, CASE WHEN volume % 5 = 0 THEN 0 ELSE open END AS prev FROM bars)
SELECT symbol, date, price - nullif(prev, 0) AS change, floor((price - nullif(prev, 0)) / nullif(prev, 0) * 100 * 10000 + 0.5) / 10000 AS change_pct FROM c""")
def _(spark, d):
    prev = F.nullif(F.when(F.col("volume") % 5 != 0, F.col("open")).otherwise(0.0), F.lit(0.0))
    change = F.col("close_price") - prev
    return A.bars_1h(spark, d).select("symbol", "date", change.alias("change"), X.rounded(change / prev * 100, 4).alias("change_pct"))
