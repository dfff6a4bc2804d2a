"""Readers: chart JSON, option chains, repair logs, and typed files.

Vendor documents are text columns (one document a row); they are parsed by
from_json with a fixed schema, so nothing is inferred and bad ones become null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.schemas import BARS, CHART_JSON, OPTION_JSON

#: The log's line and its edits.
LOG_LINE = r"^\s+(\S+)\s+(\S+)\s+(.+?):\s+(.+)$"
LOG_EDIT = r"(open|high|low)\s+([-\d.]+)->([-\d.]+)"


def _chart(doc: Column) -> Column:
    return F.get(F.from_json(doc, CHART_JSON)["chart"]["result"], 0)


def chart_bars(docs: DataFrame, intraday: bool, doc: str = "json") -> DataFrame:
    """Bars of chart documents (symbol, json): parallel arrays zipped by position, rows without all prices dropped,
    the first row of a timestamp kept, prices rounded to 2, null volume 0, daily bars at the start of their day."""
    c = docs.select("symbol", _chart(F.col(doc)).alias("c"))
    quote = F.get(F.col("c.indicators.quote"), 0)
    rows = c.select("symbol", F.posexplode(F.arrays_zip(F.col("c.timestamp").alias("t"), *[quote[k].alias(k) for k in ("open", "high", "low", "close", "volume")])).alias("pos", "r")).select("symbol", "pos", "r.*")
    rows = rows.dropna(subset=["t", "open", "high", "low", "close"])
    at = F.timestamp_seconds("t").cast("timestamp_ntz")
    rows = rows.withColumn("date", at if intraday else F.date_trunc("day", at).cast("timestamp_ntz"))
    first = rows.groupBy("symbol", "date").agg(F.min_by(F.struct("open", "high", "low", "close", "volume"), "pos").alias("r"))
    return first.select("symbol", "date", *[X.rounded(f"r.{a}").alias(b) for a, b in (("open", "open"), ("high", "high"), ("low", "low"), ("close", "close_price"))], F.coalesce("r.volume", F.lit(0)).alias("volume"))


def live_minutes(docs: DataFrame, doc: str = "json") -> DataFrame:
    """1-minute bars of live chart documents: rows without all prices dropped, timestamps floored to the minute, neighbours of one minute merged.

    A minute that returns after another one is a bar of its own, as in the
    document. Neighbours are found inside the document's arrays, which a vendor bounds: no shuffle.
    """
    c = docs.select("symbol", _chart(F.col(doc)).alias("c"))
    quote = F.get(F.col("c.indicators.quote"), 0)
    zipped = F.arrays_zip(F.col("c.timestamp").alias("t"), *[quote[k].alias(k) for k in ("open", "high", "low", "close", "volume")])
    complete = F.filter(zipped, lambda x: x["t"].isNotNull() & x["open"].isNotNull() & x["high"].isNotNull() & x["low"].isNotNull() & x["close"].isNotNull())
    once = lambda x: F.explode(F.array(x))  # noqa: E731  (computed once a document, not once for each use)
    minute = lambda i: F.floor(F.get("r", i)["t"] / 60) * 60
    firsts = F.filter(F.sequence(F.lit(0), F.size("r") - 1), lambda i: (i == 0) | (minute(i) != minute(i - 1)))
    found = c.select("symbol", once(complete).alias("r")).where("size(r) > 0").select("symbol", "r", once(firsts).alias("firsts"))

    def bar(k: Column) -> Column:
        first, until = F.get("firsts", k), F.coalesce(F.get("firsts", k + 1), F.size("r"))
        part = F.slice("r", first + 1, until - first)
        volume = F.aggregate(part, F.lit(0).cast("long"), lambda total, x: total + F.coalesce(x["volume"], F.lit(0)))
        high, low = F.array_max(F.transform(part, lambda x: x["high"])), F.array_min(F.transform(part, lambda x: x["low"]))
        return F.struct(F.timestamp_seconds(minute(first)).cast("timestamp_ntz").alias("date"), F.get("r", first)["open"].alias("open"), high.alias("high"), low.alias("low"), F.get("r", until - 1)["close"].alias("close_price"), volume.alias("volume"))

    return found.select("symbol", F.inline(F.transform(F.sequence(F.lit(0), F.size("firsts") - 1), bar)))


def last_ticks(docs: DataFrame, doc: str = "json") -> DataFrame:
    """Last price and volume of chart documents; values that aren't finite and non-negative are null."""
    meta = lambda k: X.finite(F.get_json_object(F.col(doc), f"$.chart.result[0].meta.{k}"))
    price, volume = meta("regularMarketPrice"), meta("regularMarketVolume")
    return docs.select("symbol", F.when(price >= 0, price).alias("price"), F.when(volume >= 0, volume).cast("long").alias("volume"))


def live_quotes(docs: DataFrame, doc: str = "json") -> DataFrame:
    """Live price, volume, and the previous close, or the chart's previous close where that is missing."""
    m = _chart(F.col(doc))["meta"]
    return docs.select("symbol", m["regularMarketPrice"].alias("price"), m["regularMarketVolume"].alias("volume"), F.coalesce(m["previousClose"], m["chartPreviousClose"]).alias("previous_close"))


def last_price(doc: Column) -> Column:
    """The market price of a chart document, -1 if absent."""
    return F.coalesce(X.finite(F.get_json_object(doc, "$.chart.result[0].meta.regularMarketPrice")), F.lit(-1.0))


def option_expirations(docs: DataFrame, doc: str = "json") -> DataFrame:
    return docs.select("underlying", F.explode(F.from_json(doc, OPTION_JSON)["expirationDates"]).alias("expiration"))


def option_chain(docs: DataFrame, doc: str = "json") -> DataFrame:
    """Contracts of chain documents (underlying, json): calls and puts as rows; strikes that aren't positive go, missing numbers are 0."""
    parsed = docs.select("underlying", F.explode(F.from_json(doc, OPTION_JSON)["options"]).alias("o"))
    sides = F.explode(F.array(F.struct(F.lit("call").alias("side"), F.col("o.calls").alias("c")), F.struct(F.lit("put").alias("side"), F.col("o.puts").alias("c")))).alias("s")
    rows = parsed.select("underlying", F.col("o.expirationDate").alias("expiration"), sides).select("underlying", "expiration", "s.side", F.explode("s.c").alias("r"))
    number = lambda k: F.coalesce(X.finite(F.col(f"r.{k}")), F.lit(0.0))
    out = rows.select("underlying", "expiration", "side", number("strike").alias("strike"), number("impliedVolatility").alias("implied_volatility"), number("openInterest").cast("long").alias("open_interest"), number("volume").cast("long").alias("volume"))
    return out.where("strike > 0")


def history_bars(rows: DataFrame, intraday: bool) -> DataFrame:
    """A vendor history frame as bars: prices rounded to 2, volume 0 if it isn't a number, daily bars at the start of their day."""
    at = F.col("date") if intraday else F.date_trunc("day", "date").cast("timestamp_ntz")
    volume = F.coalesce(X.finite(F.col("volume")), F.lit(0.0)).cast("long")
    return rows.select("symbol", at.alias("date"), *[X.rounded(c).alias(c) for c in ("open", "high", "low", "close_price")], volume.alias("volume"))


def repair_log(lines: DataFrame, exclude: tuple[str, ...] = (), line: str = "value") -> DataFrame:
    """Field edits of log lines (a text column, and `position` in the file): symbol, interval_type, date, field, old, position."""
    got = lines.select("position", *[F.regexp_extract(line, LOG_LINE, k).alias(n) for k, n in ((1, "symbol"), (2, "interval_type"), (3, "at"), (4, "edits"))]).where("symbol <> ''")
    if exclude:
        got = got.where(~F.col("interval_type").isin(*exclude))
    date = X.parsed_time(F.col("at"))
    pairs = F.posexplode(F.arrays_zip(F.regexp_extract_all("edits", F.lit(LOG_EDIT), F.lit(1)).alias("field"), F.regexp_extract_all("edits", F.lit(LOG_EDIT), F.lit(2)).alias("old")))
    rows = got.withColumn("date", date).where("date is not null").select("symbol", "interval_type", "date", "position", pairs.alias("k", "e"))
    return rows.select("symbol", "interval_type", "date", F.col("e.field").alias("field"), F.col("e.old").try_cast("double").alias("old"), (F.col("position") * 8 + F.col("k")).alias("position"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BARS).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_jdbc_bars(spark: SparkSession, url: str, table: str, parts: int, lower: str, upper: str, **options: str) -> DataFrame:
    """Bars of a database, read in `parts` ranges of `date` (a timestamp: ranges need one); filters and columns are pushed down by the source."""
    given = {"partitionColumn": "date", "lowerBound": lower, "upperBound": upper, "numPartitions": str(parts)} | options
    return spark.read.format("jdbc").options(url=url, dbtable=table, **given).load()


def jdbc_url(spark: SparkSession) -> str | None:
    """The database of spark.tickloom.jdbc.url; where that is unset, in local mode one in the memory of this process, and on a cluster none, as the executors wouldn't reach it."""
    url = spark.conf.get("spark.tickloom.jdbc.url", None)
    if url is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        return None
    if url is None:
        system = spark._jvm.java.lang.System
        system.setProperty("derby.stream.error.file", f"{system.getProperty('java.io.tmpdir')}/derby.log")  # not in the working folder
    return url or "jdbc:derby:memory:tickloom;create=true"


def tickers(setting: str) -> list[str]:
    """Symbols of a comma-separated setting, trimmed and upper-cased, empty ones dropped."""
    return [t for t in (x.strip().upper() for x in re.split(",", setting)) if t]
