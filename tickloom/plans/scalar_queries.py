"""Queries over scalar functions, predicates and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators.bars import stored_interval
from tickloom.operators.profile import REQUIRED
from tickloom.plans import adapters as A
from tickloom.plans.feature_queries import r6
from tickloom.plans.registry import query
from tickloom.schemas import STORED_INTERVAL

EVENTS = "(SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM events)"
MINUTE = "(hour(et) * 60 + minute(et))"
GATES = {
    "filter_market_open": (X.market_open, f"isodow(et) <= 5 AND {MINUTE} >= 570 AND {MINUTE} < 960"),
    "filter_premarket": (X.premarket, f"isodow(et) <= 5 AND {MINUTE} >= 540 AND {MINUTE} < 570"),
    "filter_postclose": (X.postclose, f"isodow(et) <= 5 AND {MINUTE} >= 960 AND {MINUTE} < 990"),
    "filter_intraday_gate": (X.intraday_gate, f"isodow(et) <= 5 AND {MINUTE} >= 570 AND {MINUTE} <= 975"),
    "filter_daily_gate": (X.daily_gate, "hour(et) = 16 AND minute(et) BETWEEN 25 AND 40"),
}
for _name, (_gate, _sql) in GATES.items():
    query(_name, f"SELECT event_id, ts FROM {EVENTS} WHERE {_sql}")(lambda spark, d, gate=_gate: A.table(spark, d, "events").where(gate(F.col("ts"))).select("event_id", "ts"))


@query("stream_gex_cron", f"SELECT event_id, CASE WHEN {GATES['filter_premarket'][1]} THEN 'premarket' WHEN {GATES['filter_market_open'][1]} THEN 'regular' WHEN {GATES['filter_postclose'][1]} THEN 'postclose' ELSE 'closed' END AS session FROM {EVENTS}")
def _(spark, d):
    ts = F.col("ts")
    session = F.when(X.premarket(ts), "premarket").when(X.market_open(ts), "regular").when(X.postclose(ts), "postclose").otherwise("closed")
    return A.table(spark, d, "events").select("event_id", session.alias("session"))


SYMBOLS = ("ES=F", "NQ=F", "SPY", "QQQ", "BTC-USD", "^VIX")
LIST = "(VALUES " + ", ".join(f"('{s}')" for s in SYMBOLS) + ") t(symbol)"
#: Each event's symbol, dealt out by its id.
WATCHED = "(SELECT event_id, ['ES=F', 'NQ=F', 'SPY', 'QQQ', 'BTC-USD', '^VIX'][event_id % 6 + 1] AS symbol FROM events)"


def _dealt(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _watched(spark, d):
    return A.table(spark, d, "events").select("event_id", _dealt(F.col("event_id"), SYMBOLS).alias("symbol"))


@query("filter_session_symbols", f"SELECT e.event_id, t.symbol FROM {EVENTS} e, {LIST} WHERE ends_with(t.symbol, '=F') OR ({GATES['filter_intraday_gate'][1]})")
def _(spark, d):
    e = A.table(spark, d, "events").select("event_id", "ts")
    each = e.withColumn("symbol", F.explode(F.array(*map(F.lit, SYMBOLS))))
    return each.where(F.col("symbol").endswith("=F") | X.intraday_gate(F.col("ts"))).select("event_id", "symbol")


@query("filter_ticker_groups", f"SELECT event_id, symbol, CASE WHEN symbol IN ('BTC-USD', 'ETH-USD') THEN 'crypto' ELSE 'other' END AS kind FROM {WATCHED}")
def _(spark, d):
    return _watched(spark, d).withColumn("kind", F.when(F.col("symbol").isin("BTC-USD", "ETH-USD"), "crypto").otherwise("other"))


@query("proj_display_name", f"SELECT event_id, CASE symbol WHEN 'ES=F' THEN '/ES' WHEN 'NQ=F' THEN '/NQ' WHEN '^VIX' THEN 'VIX' ELSE regexp_replace(symbol, '-USD$', '') END AS name FROM {WATCHED}")
def _(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {"ES=F": "/ES", "NQ=F": "/NQ", "^VIX": "VIX"}.items() for x in kv])
    return _watched(spark, d).select("event_id", F.coalesce(F.try_element_at(names, F.col("symbol")), F.regexp_replace("symbol", "-USD$", "")).alias("name"))


@query("proj_stored_interval", """SELECT event_id, interval, CASE WHEN interval IN ('15m', '30m', '5m') THEN '5m' WHEN interval IN ('1h', '4h') THEN '1h' WHEN interval IN ('1d', '1wk') THEN '1d' ELSE '1m' END AS stored
FROM (SELECT event_id, ['1m', '5m', '15m', '30m', '1h', '4h', '1d', '1wk', '7m'][event_id % 9 + 1] AS interval FROM events)""")
def _(spark, d):
    """The interval that each request reads; an unknown one (7m) reads minutes."""
    rows = A.table(spark, d, "events").select("event_id", _dealt(F.col("event_id"), (*STORED_INTERVAL, "7m")).alias("interval"))
    return rows.withColumn("stored", stored_interval(F.col("interval")))


@query("proj_ticker_list", "SELECT event_id, unnest(list_filter(list_transform(string_split(' ' || event_type || ', spy ,,' || event_id || '=f ', ','), lambda x: upper(trim(x))), lambda x: x <> '')) AS symbol FROM events")
def _(spark, d):
    setting = F.concat(F.lit(" "), F.col("event_type"), F.lit(", spy ,,"), F.col("event_id").cast("string"), F.lit("=f "))
    return A.table(spark, d, "events").select("event_id", F.explode(X.ticker_list(setting)).alias("symbol"))


@query("proj_numeric_coerce", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || value ELSE value::VARCHAR END AS DOUBLE) AS value FROM events")
def _(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return A.table(spark, d, "events").select("event_id", raw.try_cast("double").alias("value"))


@query("filter_valid_number", "SELECT event_id, value FROM events WHERE event_id % 4 <> 0 AND event_id % 5 <> 0")
def _(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, "NaN").when(F.col("event_id") % 5 == 0, "Infinity").otherwise(F.col("value").cast("string"))
    rows = A.table(spark, d, "events").select("event_id", X.finite(v).alias("value"))
    return rows.where("value >= 0")


@query("fn_math", f"""SELECT event_id, {r6('exp(-0.5 * (value / 100) * (value / 100)) / sqrt(2 * pi())')} AS pdf, floor(value * 100 + 0.5) / 100 AS round2, floor(value * 10000 + 0.5) / 10000 AS round4, least(greatest(value, 10), 400) AS clipped,
{r6('ln(value)')} AS ln, {r6('ln(1 + value)')} AS log1p, {r6('sin(value)')} AS sin, {r6('sqrt(value)')} AS sqrt, sign(value - 200)::DOUBLE AS sign, {r6('pow(value / 100, 3)')} AS cube FROM events""")
def _(spark, d):
    v = F.col("value")
    six = lambda c, n: X.rounded(c, 6).alias(n)
    return A.table(spark, d, "events").select("event_id", six(X.norm_pdf(v / 100), "pdf"), X.rounded(v).alias("round2"), X.rounded(v, 4).alias("round4"), F.least(F.greatest(v, F.lit(10.0)), F.lit(400.0)).alias("clipped"), six(X.ln(v), "ln"), six(X.log1p(v), "log1p"), six(F.sin(v), "sin"), six(F.sqrt(v), "sqrt"), F.signum(v - 200).alias("sign"), six(F.pow(v / 100, F.lit(3)), "cube"))


@query("fn_median_mean", f"SELECT event_type, {r6('quantile_cont(value, 0.5)')} AS median, {r6('coalesce(avg(value), 0)')} AS mean FROM events GROUP BY event_type")
def _(spark, d):
    from tickloom.operators.quantiles import quantiles

    e = A.table(spark, d, "events").select("event_type", "value")
    means = e.groupBy("event_type").agg(X.rounded(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"))
    medians = quantiles(e, "value", {"median": 0.5}, ["event_type"]).select(F.col("event_type").alias("_type"), X.rounded("median", 6).alias("median"))
    return means.join(medians, F.col("event_type").eqNullSafe(F.col("_type"))).select("event_type", "median", "mean")


@query("fn_date", """SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS weekday, ts::DATE AS day, hour(et) AS et_hour, (ts - INTERVAL 3 MONTH) AS minus_3mo, (ts - INTERVAL 5 DAY) AS minus_5d, date_trunc('week', ts)::TIMESTAMP AS monday,
time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, floor(epoch(ts))::BIGINT AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, make_timestamp(floor(epoch(ts))::BIGINT * 1000000) AS back FROM """ + EVENTS)
def _(spark, d):
    ts = F.col("ts")
    seconds = F.unix_timestamp(ts.cast("timestamp"))
    from tickloom.operators.bars import minus_period

    return A.table(spark, d, "events").select(
        "event_id", *[f(ts).cast("long").alias(n) for f, n in ((F.hour, "hour"), (F.minute, "minute"), (F.weekday, "weekday"))], F.to_date(ts).alias("day"), F.hour(X.exchange_time(ts)).cast("long").alias("et_hour"),
        minus_period(ts, "3mo").alias("minus_3mo"), minus_period(ts, "5d").alias("minus_5d"), X.monday(ts).alias("monday"), X.floor_minutes(ts, 15).alias("quarter"), seconds.alias("seconds"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("text"), F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("back"),
    )


@query("fn_date_parse", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts)::TIMESTAMP WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS parsed FROM events""")
def _(spark, d):
    """Times in three formats, one of them two hours east of Greenwich, and texts that are no time."""
    ts, k = F.col("ts"), F.col("event_id") % 4
    second = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    text = F.when(k == 0, second).when(k == 1, F.date_format(ts, "yyyy-MM-dd")).when(k == 2, F.concat(second, F.lit("+02:00"))).otherwise("soon")
    return A.table(spark, d, "events").select("event_id", X.parsed_time(text).alias("parsed"))


@query("fn_string", """SELECT event_id, upper(event_type) AS up, string_split(upper(event_type) || ',' || event_id, ',')[1] AS head, ends_with(event_type, 'n') AS ends, regexp_extract(props, '(\\d+)', 1) AS digits, regexp_replace(event_type, 'i.*$', '') AS cut, regexp_matches(props, '^\\{.*\\}$') AS braces,
(CASE WHEN value >= 200 THEN '+' ELSE '' END) || (floor(value)::BIGINT) || 'M' AS label FROM events""")
def _(spark, d):
    e = A.table(spark, d, "events")
    return e.select(
        "event_id", F.upper("event_type").alias("up"), F.get(F.split(F.concat_ws(",", F.upper("event_type"), F.col("event_id").cast("string")), ","), 0).alias("head"), F.col("event_type").endswith("n").alias("ends"), F.regexp_extract("props", r"(\d+)", 1).alias("digits"),
        F.regexp_replace("event_type", "i.*$", "").alias("cut"), F.col("props").rlike(r"^\{.*\}$").alias("braces"), F.concat(F.when(F.col("value") >= 200, "+").otherwise(""), F.floor("value").cast("string"), F.lit("M")).alias("label"),
    )


@query("fn_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing FROM events")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("fn_array", "SELECT event_type, block, len(l) AS n, list_sum(l)::BIGINT AS total, list_max(l) AS top, l[1] AS first, l[1000000] AS beyond FROM (SELECT event_type, event_id // 1000 AS block, list(event_id ORDER BY event_id) AS l FROM events GROUP BY ALL)")
def _(spark, d):
    """Arrays of the ids of a type within blocks of 1,000 ids, so that none grows with the table."""
    a = A.table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 1000).alias("block")).agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    return a.select("event_type", "block", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_max("l").alias("top"), F.get("l", F.lit(0)).alias("first"), F.get("l", F.lit(999999)).alias("beyond"))


@query("fn_map", "SELECT event_type, count(*) AS hits, coalesce(CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' END, 'other') AS code FROM events GROUP BY event_type")
def _(spark, d):
    codes = F.create_map(F.lit("click"), F.lit("c"), F.lit("view"), F.lit("v"))
    return A.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("hits")).withColumn("code", F.coalesce(F.try_element_at(codes, F.col("event_type")), F.lit("other")))


@query("fn_null", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, 0) AS filled, value / nullif(event_id % 4, 0) AS guarded FROM events")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("value")), F.lit(0.0)).alias("filled"), X.ratio(F.col("value"), (F.col("event_id") % 4).cast("double")).alias("guarded"))


@query("set_diff_required", """SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'open' END, CASE WHEN event_id // 2 % 2 = 0 THEN 'high' END, CASE WHEN event_id // 4 % 2 = 0 THEN 'low' END, CASE WHEN event_id // 8 % 2 = 0 THEN 'close' END, CASE WHEN event_id // 16 % 2 = 0 THEN 'volume' END], lambda x: x IS NOT NULL).array_to_string(',') AS missing FROM events""")
def _(spark, d):
    """The required columns that a frame lacks; each event stands for a frame that has those of its id's bits."""
    required = F.array(*map(F.lit, REQUIRED))
    given = F.array_compact(F.array(*[F.when(F.floor(F.col("event_id") / 2**k) % 2 == 1, name) for k, name in enumerate(REQUIRED)]))
    return A.table(spark, d, "events").select("event_id", F.array_join(F.array_except(required, given), ",").alias("missing"))
