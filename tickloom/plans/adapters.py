"""The engine's inputs derived from the warehouse tables; each view also as a DuckDB CTE for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("value").alias("price"), (1 + F.col("event_id") % 100).alias("volume"), "ts", "event_id")


def bars_1h(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_of_ticks(ticks(spark, d), 60).withColumn("interval_type", F.lit("1h"))


def bars_5m(spark: SparkSession, d: str) -> DataFrame:
    return B.bars_of_ticks(ticks(spark, d).withColumn("symbol", F.lit("ALL")), 5).withColumn("interval_type", F.lit("5m"))


def tight_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars whose prices lie close together, so that some stay under the outlier threshold."""
    return bars_1h(spark, d).withColumns({c: F.lit(100.0) + F.col(c) / 1000 for c in ("open", "high", "low", "close_price")})


def rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Several versions of each (symbol, hour), by fetched_at."""
    return ticks(spark, d).select("symbol", X.floor_minutes(F.col("ts"), 60).alias("date"), F.lit("1h").alias("interval_type"), F.col("price").alias("open"), F.col("price").alias("close_price"), "volume", F.col("ts").alias("fetched_at"))


def contracts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_linenumber")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(
        F.col("l_returnflag").alias("underlying"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("side"),
        (F.floor(F.col("p_retailprice") / 5) * 5).cast("double").alias("strike"),
        F.col("l_quantity").cast("long").alias("open_interest"),
        (F.col("l_discount") + F.col("l_tax")).cast("double").alias("implied_volatility"),
        F.col("l_linenumber").cast("long").alias("volume"),
        (F.col("l_suppkey") % 45).cast("int").alias("days_out"),
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'signup'")
    price = F.when(F.col("event_id") % 11 != 0, F.col("value"))
    return e.select(F.col("event_id").alias("id"), F.lit("ALL").alias("symbol"), F.col("ts").alias("computed_at"), price.alias("etf_price"), (price * 41.2).alias("futures_price"), F.lit(41.2).alias("conversion_ratio"), F.lit("2024-02-02,2024-02-09").alias("expirations_used"))


LABELS = ("call_wall", "put_wall", "zero_gamma", "significant_pos", "significant_neg")


def levels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'signup'")
    rows = e.select("event_id", "value", F.posexplode(F.array(*map(F.lit, LABELS))).alias("i", "label"))
    strike = F.when(F.col("event_id") % 7 != 0, X.rounded(F.col("value") * (0.9 + 0.05 * F.col("i"))))
    gex = ((F.col("event_id") * 7919 + F.col("i") * 104729) % 2001 - 1000).cast("double")
    return rows.select((F.col("event_id") * 5 + F.col("i")).alias("id"), F.col("event_id").alias("gamma_exposure_id"), strike.alias("strike_etf"), X.rounded(strike * 41.2).alias("strike_futures"), gex.alias("gex"), F.when(F.col("event_id") % 5 != 0, gex / 2).alias("gex_0dte"), "label")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Made-up out-of-sample rows: a target and two models' predictions per order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("oos_idx"), (F.col("o_totalprice").cast("double") - 150000.0).alias("y_true"))
    noise = lambda k: (F.col("oos_idx") * k % 1009 - 504).cast("double")
    return o.select("oos_idx", "y_true", (F.col("y_true") / 1000 + noise(7919)).alias("base_pred"), (F.col("y_true") / 900 + noise(104729)).alias("gex_pred"))


#: The same views in DuckDB; combine with `ctes`.
SQL = {
    "ticks": "SELECT event_type AS symbol, value AS price, 1 + event_id % 100 AS volume, ts, event_id FROM events",
    "bars": """SELECT symbol, date_trunc('hour', ts) AS date, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close_price, sum(volume)::BIGINT AS volume
        FROM ticks GROUP BY symbol, date_trunc('hour', ts)""",
    "bars5": """SELECT 'ALL' AS symbol, date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 5) * 5 AS BIGINT)) AS date, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close_price, sum(volume)::BIGINT AS volume
        FROM ticks GROUP BY ALL""",
    "tight": "SELECT symbol, date, 100.0::DOUBLE + open / 1000 AS open, 100.0::DOUBLE + high / 1000 AS high, 100.0::DOUBLE + low / 1000 AS low, 100.0::DOUBLE + close_price / 1000 AS close_price, volume FROM bars",
    "rewrites": "SELECT symbol, date_trunc('hour', ts) AS date, '1h' AS interval_type, price AS open, price AS close_price, volume, ts AS fetched_at FROM ticks",
    "contracts": """SELECT l_returnflag AS underlying, CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS side, (floor(p_retailprice / 5) * 5)::DOUBLE AS strike, l_quantity::BIGINT AS open_interest,
        (l_discount + l_tax)::DOUBLE AS implied_volatility, l_linenumber::BIGINT AS volume, (l_suppkey % 45)::INT AS days_out FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "snapshots": """SELECT event_id AS id, 'ALL' AS symbol, ts AS computed_at, CASE WHEN event_id % 11 != 0 THEN value END AS etf_price, CASE WHEN event_id % 11 != 0 THEN value END * 41.2::DOUBLE AS futures_price,
        41.2::DOUBLE AS conversion_ratio, '2024-02-02,2024-02-09' AS expirations_used FROM events WHERE event_type = 'signup'""",
    "levels": """SELECT event_id * 5 + i AS id, event_id AS gamma_exposure_id, s AS strike_etf, floor(s * 41.2::DOUBLE * 100 + 0.5) / 100 AS strike_futures, g AS gex, CASE WHEN event_id % 5 != 0 THEN g / 2 END AS gex_0dte, label
        FROM (SELECT event_id, i, ['call_wall', 'put_wall', 'zero_gamma', 'significant_pos', 'significant_neg'][i + 1] AS label,
            CASE WHEN event_id % 7 != 0 THEN floor(value * (0.9::DOUBLE + 0.05::DOUBLE * i) * 100 + 0.5) / 100 END AS s, ((event_id * 7919 + i * 104729) % 2001 - 1000)::DOUBLE AS g
            FROM events, (SELECT unnest(range(0, 5)) AS i) WHERE event_type = 'signup')""",
    "oos": """SELECT oos_idx, y_true, y_true / 1000 + (oos_idx * 7919 % 1009 - 504)::DOUBLE AS base_pred, y_true / 900 + (oos_idx * 104729 % 1009 - 504)::DOUBLE AS gex_pred
        FROM (SELECT o_orderkey AS oos_idx, o_totalprice::DOUBLE - 150000.0::DOUBLE AS y_true FROM orders)""",
}
NEEDS = {"bars": ["ticks"], "bars5": ["ticks"], "tight": ["ticks", "bars"], "rewrites": ["ticks"]}


def ctes(*names: str) -> str:
    """WITH clause of the named views and what they need; ends without a comma."""
    out: list[str] = []
    for n in names:
        out += [x for x in [*NEEDS.get(n, []), n] if x not in out]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in out)
