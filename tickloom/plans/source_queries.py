"""Queries over sources: vendor documents, logs and files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.plans import adapters as A
from tickloom.plans.feature_queries import r6, six
from tickloom.plans.registry import query
from tickloom.session import fresh_path
from tickloom.sources import database_files, paged
from tickloom.sources import readers as R

TWO = "floor({0} * 100 + 0.5) / 100"


def charts(spark, d):
    """One chart document per symbol and month, built from hourly bars, some with a missing price or volume."""
    b = A.bars_1h(spark, d).withColumn("month", F.date_trunc("month", "date"))
    row = F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), F.when(F.col("volume") % 11 != 0, F.col("open")).alias("open"), "high", "low", F.col("close_price").alias("close"), F.when(F.col("volume") % 13 != 0, F.col("volume")).alias("volume"))
    per = b.groupBy("symbol", "month").agg(F.array_sort(F.collect_list(row)).alias("r"))
    list_of = lambda k: F.transform("r", lambda x: x[k])
    last = F.element_at("r", -1)
    meta = F.struct(F.col("symbol").alias("symbol"), last["close"].alias("regularMarketPrice"), F.lit(1234).cast("long").alias("regularMarketVolume"), F.when(F.col("symbol") < "login", F.lit(7.5)).alias("previousClose"), F.lit(9.5).alias("chartPreviousClose"))
    quote = F.struct(*[list_of(k).alias(k) for k in ("open", "high", "low", "close", "volume")])
    doc = F.struct(F.struct(F.array(F.struct(meta.alias("meta"), list_of("t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    return per.select("symbol", "month", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def last_charts(spark, d):
    """The newest chart document of each symbol."""
    return charts(spark, d).groupBy("symbol").agg(F.max_by("json", "month").alias("json"))


def _round(*names: str) -> str:
    return ", ".join(f"{TWO.format(c)} AS {c}" for c in names)


@query("src_chart_json", A.ctes("bars") + f" SELECT symbol, date, {_round('open', 'high', 'low', 'close_price')}, CASE WHEN volume % 13 <> 0 THEN volume ELSE 0 END AS volume FROM bars WHERE volume % 11 <> 0")
def _(spark, d):
    return R.chart_bars(charts(spark, d), True)


@query("src_chart_json_daily", A.ctes("bars") + f""" SELECT symbol, day AS date, {_round('open', 'high', 'low', 'close_price')}, CASE WHEN volume % 13 <> 0 THEN volume ELSE 0 END AS volume
FROM (SELECT *, date_trunc('day', date)::TIMESTAMP AS day, row_number() OVER (PARTITION BY symbol, date_trunc('day', date) ORDER BY date) AS r FROM bars WHERE volume % 11 <> 0) WHERE r = 1""")
def _(spark, d):
    return R.chart_bars(charts(spark, d), False)


@query("src_live_1m", A.ctes("bars") + " SELECT symbol, date, open, high, low, close_price, CASE WHEN volume % 13 <> 0 THEN volume ELSE 0 END AS volume FROM bars WHERE volume % 11 <> 0")
def _(spark, d):
    return R.live_minutes(charts(spark, d))


@query("src_live_quote", A.ctes("bars") + " SELECT symbol, arg_max(close_price, date) AS price, 1234::BIGINT AS volume, CASE WHEN symbol < 'login' THEN 7.5::DOUBLE ELSE 9.5::DOUBLE END AS previous_close FROM bars GROUP BY symbol")
def _(spark, d):
    return R.live_quotes(last_charts(spark, d))


@query("src_last_tick", A.ctes("bars") + " SELECT symbol, arg_max(close_price, date) AS price, 1234::BIGINT AS volume FROM bars GROUP BY symbol")
def _(spark, d):
    return R.last_ticks(last_charts(spark, d))


@query("src_last_price", A.ctes("bars") + " SELECT symbol, arg_max(close_price, date) AS price FROM bars GROUP BY symbol UNION ALL SELECT 'none', -1.0::DOUBLE")
def _(spark, d):
    docs = last_charts(spark, d).unionByName(spark.createDataFrame([("none", "{}")], "symbol string, json string"))
    return docs.select("symbol", R.last_price(F.col("json")).alias("price"))


@query("src_history_bars", A.ctes("bars") + f" SELECT symbol, date, {_round('open', 'high', 'low', 'close_price')}, CASE WHEN volume % 17 = 0 THEN 0 ELSE volume END AS volume FROM bars")
def _(spark, d):
    rows = A.bars_1h(spark, d).withColumn("volume", F.when(F.col("volume") % 17 == 0, "n/a").otherwise(F.col("volume").cast("string")))
    return R.history_bars(rows, True)


def chains(spark, d):
    """One chain document per underlying, expiry and five strikes, of all contracts; one strike of 0 in each."""
    c = A.contracts(spark, d).withColumn("strikes", F.floor(F.col("strike") / 25))
    row = F.struct("strike", F.col("implied_volatility").alias("impliedVolatility"), F.col("open_interest").cast("double").alias("openInterest"), F.col("volume").cast("double").alias("volume"))
    side = lambda s: F.collect_list(F.when(F.col("side") == s, row))
    zero = F.array(F.struct(F.lit(0.0).alias("strike"), F.lit(0.5).alias("impliedVolatility"), F.lit(1.0).alias("openInterest"), F.lit(1.0).alias("volume")))
    per = c.groupBy("underlying", "days_out", "strikes").agg(side("call").alias("calls"), side("put").alias("puts"))
    option = F.struct(F.col("days_out").cast("long").alias("expirationDate"), F.concat("calls", zero).alias("calls"), "puts")
    return per.select("underlying", F.to_json(F.struct(F.array(F.col("days_out").cast("long")).alias("expirationDates"), F.array(option).alias("options"))).alias("json"))


CHAIN = A.ctes("contracts") + " SELECT underlying, days_out::BIGINT AS expiration, side, strike, {iv} AS implied_volatility, open_interest, volume FROM contracts"


@query("src_option_chain", CHAIN.format(iv=r6("implied_volatility")))
def _(spark, d):
    from tickloom.functions import expr as X

    return R.option_chain(chains(spark, d)).withColumn("implied_volatility", X.rounded("implied_volatility", 6))


@query("src_option_expirations", A.ctes("contracts") + " SELECT DISTINCT underlying, days_out::BIGINT AS expiration FROM contracts")
def _(spark, d):
    return R.option_expirations(chains(spark, d)).distinct()


def log_lines(spark, d):
    """A repair log in text, from hourly bars: every third line has a bare date, every fifth is a heading."""
    b = A.bars_1h(spark, d)
    at = F.when(F.col("volume") % 3 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
    text = F.concat(F.lit("  "), F.col("symbol"), F.lit(" 1h "), at, F.lit(": open "), F.floor("open").cast("string"), F.lit("->1.0, low "), F.floor("low").cast("string"), F.lit("->0.5"))
    return b.select(F.when(F.col("volume") % 5 == 0, F.lit("== 1h ==")).otherwise(text).alias("value"), F.unix_timestamp(F.col("date").cast("timestamp")).alias("position"))


LOG = A.ctes("bars") + """, e AS (SELECT symbol, '1h' AS interval_type, CASE WHEN volume % 3 = 0 THEN date_trunc('day', date)::TIMESTAMP ELSE date END AS date, f AS field, CASE WHEN f = 'open' THEN floor(open) ELSE floor(low) END AS old, epoch(date)::BIGINT * 8 + k AS position
FROM bars, (VALUES ('open', 0), ('low', 1)) x(f, k) WHERE volume % 5 <> 0)"""


@query("src_repair_log", LOG + " SELECT * FROM e")
def _(spark, d):
    return R.repair_log(log_lines(spark, d))


@query("agg_edit_counts", LOG + " SELECT symbol, interval_type, count(*) AS n FROM e GROUP BY symbol, interval_type")
def _(spark, d):
    return R.repair_log(log_lines(spark, d)).groupBy("symbol", "interval_type").agg(F.count("*").alias("n")).orderBy("symbol", "interval_type")


@query("src_parquet", "SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderstatus = 'O'")
def _(spark, d):
    """A range and an equality, both pushed down to the scan, and three columns."""
    recent = (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "O")
    return A.table(spark, d, "orders").where(recent).select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


BARS = "symbol, date, open, high, low, close_price, volume"


def _database(spark, d):
    """The hourly bars, written to a database and read again in four ranges of dates."""
    from tickloom.sources.sinks import write_jdbc_bars

    url, rows = R.jdbc_url(spark), A.bars_1h(spark, d).withColumn("date", F.col("date").cast("timestamp"))
    if url is None:
        path = fresh_path(spark)
        return database_files.read_files(spark, path, rows.schema, "date", database_files.write_files(rows, path, "date", 4))
    first, last = rows.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    name = f"bars_{uuid.uuid4().hex}"
    write_jdbc_bars(rows, url, name)
    return R.read_jdbc_bars(spark, url, name, 4, first, last) if first is not None else rows


def _bars(rows):
    return rows.select(*BARS.split(", ")).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("src_jdbc_bars", A.ctes("bars") + f" SELECT {BARS} FROM bars WHERE symbol = 'purchase' AND date >= TIMESTAMP '2024-01-10'")
def _(spark, d):
    return _bars(_database(spark, d).where((F.col("symbol") == "purchase") & (F.col("date") >= F.lit("2024-01-10").cast("timestamp"))))


@query("src_jdbc_between", A.ctes("bars") + f" SELECT {BARS} FROM bars WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 12:00:00'")
def _(spark, d):
    return _bars(_database(spark, d).where(F.col("date").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-06 12:00:00").cast("timestamp"))))


PAGE = "event_id bigint, event_type string, value double"


@query("src_rest_paged", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    """All events in pages, read until one is short."""
    path = fresh_path(spark)
    paged.write_pages(A.table(spark, d, "events").select("event_id", "event_type", "value"), path, ["event_id"])
    return paged.read_pages(spark, path, PAGE)


@query("src_rest_filtered", "SELECT event_id, value FROM events WHERE event_type = 'click' AND value >= 50")
def _(spark, d):
    """One type's pages: the equality goes into the request, the range stays with Spark."""
    path = fresh_path(spark)
    paged.write_pages(A.table(spark, d, "events").select("event_id", "event_type", "value"), path, ["event_id"], by="event_type")
    return paged.read_pages(spark, path, PAGE, columns="event_type").where("event_type = 'click' and value >= 50").select("event_id", "value")


@query("src_csv", A.ctes("bars") + f" SELECT symbol, date, {r6('open')} AS open, {r6('close_price')} AS close_price, volume FROM bars")
def _(spark, d):
    """Bars written as CSV with a header, and read by a fixed schema: columns by place, types as declared."""
    from tickloom.sources.sinks import fresh_path, write_csv

    path = fresh_path(spark)
    write_csv(A.bars_1h(spark, d).select("symbol", "date", "open", "close_price", "volume"), path)
    rows = R.read_csv(spark, path, "symbol string, date timestamp_ntz, open double, close_price double, volume bigint")
    return rows.select("symbol", "date", *six(rows, "open", "close_price"), "volume")


@query("sink_csv", "SELECT event_type AS name, count(*) AS n, " + r6("avg(value)") + " AS mean FROM events GROUP BY event_type")
def _(spark, d):
    """A summary written as CSV, read back as text and cast, so that what was written is what is tested."""
    from tickloom.sources.sinks import fresh_path, write_csv

    path = fresh_path(spark)
    rows = A.table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    write_csv(rows, path)
    back = spark.read.option("header", True).csv(path).select("name", F.col("n").cast("long").alias("n"), F.col("mean").cast("double").alias("mean"))
    return back.select("name", "n", *six(back, "mean"))


@query("sink_parquet", A.ctes("bars") + " SELECT symbol, interval_type, count(*) AS n, max(date) AS last_date, sum(volume)::BIGINT AS volume FROM (SELECT *, '1h' AS interval_type FROM bars UNION ALL SELECT *, '1h' FROM bars WHERE volume % 2 = 0) GROUP BY symbol, interval_type")
def _(spark, d):
    """Bars appended in two writes, partitioned by interval; the read prunes folders by it."""
    from tickloom.sources.sinks import fresh_path, write_bars

    path, rows = fresh_path(spark), A.bars_1h(spark, d)
    write_bars(rows, path)
    write_bars(rows.where("volume % 2 = 0"), path)
    stored = spark.read.parquet(path).where("interval_type = '1h'")
    return stored.groupBy("symbol", "interval_type").agg(F.count("*").alias("n"), F.max("date").alias("last_date"), F.sum("volume").alias("volume"))


@query("sink_ddl", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS price, NULL::BIGINT AS pcr, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, value, event_id, event_type FROM events WHERE event_id % 2 = 1")
def _(spark, d):
    """Rows of an older schema (a legacy price, no pcr) and a newer one in one table: columns added, a legacy one copied and dropped."""
    from tickloom.sources.sinks import add_columns, copy_column, fresh_path, write_rows

    path, e = fresh_path(spark), A.table(spark, d, "events")
    write_rows(e.where("event_id % 2 = 0").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("spot"), "event_type"), f"{path}/v=1")
    write_rows(e.where("event_id % 2 = 1").select("event_id", F.col("value").alias("price"), F.col("event_id").alias("pcr"), "event_type"), f"{path}/v=2")
    both = spark.read.option("mergeSchema", True).parquet(path)
    return copy_column(add_columns(both, {"pcr": "bigint", "price": "double"}), "spot", "price").select("event_id", "price", "pcr", "event_type")


@query("proj_normalize_cols", A.ctes("bars") + " SELECT symbol, open, high, low, close_price AS close, volume FROM bars")
def _(spark, d):
    from tickloom.operators.profile import normalized_columns

    rows = A.bars_1h(spark, d).select("symbol", F.col("open").alias("Open"), F.col("high").alias("HIGH"), F.col("low").alias("Low"), F.col("close_price").alias("Close"), F.col("volume").alias("Volume"))
    return normalized_columns(rows).select("symbol", "open", "high", "low", "close", "volume")


@query("join_arrays_positional", """SELECT event_id, x AS pos, CASE WHEN x < event_id % 4 THEN event_id + x END AS a, CASE WHEN x < event_id % 3 + 1 THEN event_type || x END AS b FROM (SELECT event_id, event_type, unnest(range(0, greatest(event_id % 4, event_id % 3 + 1)))::INT AS x FROM events)""")
def _(spark, d):
    """Each event's two arrays, of unequal length, by position; the shorter one gives nulls."""
    i = F.col("event_id")
    upto = lambda n, f: F.transform(F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), n.cast("int")), f)
    arrays = A.table(spark, d, "events").select("event_id", upto(i % 4, lambda x: i + x).alias("a"), upto(i % 3 + 1, lambda x: F.concat("event_type", x.cast("string"))).alias("b"))
    return arrays.select("event_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "r")).select("event_id", "pos", "r.*")
