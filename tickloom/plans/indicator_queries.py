"""Queries over chart indicators and volume profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import indicators as I
from tickloom.operators import profile as P
from tickloom.plans import adapters as A
from tickloom.plans.feature_queries import r6, six
from tickloom.plans.registry import query


def _bars(spark, d):
    return A.bars_1h(spark, d).drop("interval_type")


@query("win_sma", A.ctes("bars") + f" SELECT symbol, date, {r6('CASE WHEN count(close_price) OVER w = 20 THEN avg(close_price) OVER w END')} AS sma FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    rows = I.sma(_bars(spark, d), 20)
    return rows.select("symbol", "date", *six(rows, "sma"))


@query("win_bollinger", A.ctes("bars") + f""", b AS (SELECT symbol, date, CASE WHEN count(close_price) OVER w = 20 THEN avg(close_price) OVER w END AS m, stddev_pop(close_price) OVER w AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, date, {r6('m')} AS middle, {r6('(m + 2 * s)')} AS upper, {r6('(m - 2 * s)')} AS lower FROM b""")
def _(spark, d):
    rows = I.bollinger(_bars(spark, d))
    return rows.select("symbol", "date", *six(rows, "middle", "upper", "lower"))


@query("win_vwap", A.ctes("bars") + f" SELECT symbol, date, {r6('(sum((high + low + close_price) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0))')} AS vwap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    rows = I.vwap(_bars(spark, d))
    return rows.select("symbol", "date", *six(rows, "vwap"))


def _ema_sql(name: str, period: int, source: str = "n") -> str:
    return f"""{name} AS (SELECT symbol, i, avg(close_price) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW) AS e FROM {source} WHERE i <= {period} QUALIFY i = {period}
UNION ALL SELECT {source}.symbol, {source}.i, {name}.e + ({source}.close_price - {name}.e) * 2.0::DOUBLE / {period + 1} FROM {name} JOIN {source} ON {source}.symbol = {name}.symbol AND {source}.i = {name}.i + 1)"""


NUMBERED = A.ctes("bars").replace("WITH ", "WITH RECURSIVE ", 1) + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars)"


@query("win_ema", NUMBERED + ", " + _ema_sql("e12", 12) + f" SELECT n.symbol, n.date, {r6('e12.e')} AS ema FROM n LEFT JOIN e12 ON n.symbol = e12.symbol AND n.i = e12.i")
def _(spark, d):
    rows = I.ema(_bars(spark, d), 12)
    return rows.select("symbol", "date", *six(rows, "ema"))


WILDER = NUMBERED + """, tr AS (SELECT symbol, i, date, CASE WHEN i = 1 THEN high - low ELSE greatest(high - low, abs(high - lag(close_price) OVER w), abs(low - lag(close_price) OVER w)) END AS t FROM n WINDOW w AS (PARTITION BY symbol ORDER BY i)),
wilder AS (SELECT symbol, i, t AS a FROM tr WHERE i = 1 UNION ALL SELECT tr.symbol, tr.i, tr.t / 14 + wilder.a * (13.0::DOUBLE / 14) FROM wilder JOIN tr ON tr.symbol = wilder.symbol AND tr.i = wilder.i + 1)"""


@query("win_atr_wilder", WILDER + f" SELECT tr.symbol, tr.date, {r6('wilder.a')} AS atr FROM tr JOIN wilder ON tr.symbol = wilder.symbol AND tr.i = wilder.i")
def _(spark, d):
    rows = I.atr_wilder(_bars(spark, d))
    return rows.select("symbol", "date", *six(rows, "atr"))


TREND = NUMBERED + ", " + _ema_sql("fast", 21) + ", " + _ema_sql("slow", 200) + """, state AS (SELECT n.symbol, n.date, CASE WHEN s.e IS NULL THEN NULL WHEN f.e > s.e AND close_price > f.e THEN 'bullish' WHEN f.e < s.e AND close_price < f.e THEN 'bearish' ELSE 'neutral' END AS trend
FROM n LEFT JOIN fast f ON n.symbol = f.symbol AND n.i = f.i LEFT JOIN slow s ON n.symbol = s.symbol AND n.i = s.i)"""


@query("win_trend_state", TREND + " SELECT * FROM state")
def _(spark, d):
    return I.trend_state(_bars(spark, d)).select("symbol", "date", "trend")


@query("join_ema_by_time", NUMBERED + ", " + _ema_sql("fast", 21) + ", " + _ema_sql("slow", 200) + f" SELECT n.symbol, n.date, {r6('f.e')} AS fast, {r6('s.e')} AS slow FROM n JOIN fast f ON n.symbol = f.symbol AND n.i = f.i JOIN slow s ON n.symbol = s.symbol AND n.i = s.i")
def _(spark, d):
    from tickloom.operators import series as S

    rows = I.with_ema(I.with_ema(S.indexed(_bars(spark, d)), 21, "fast"), 200, "slow").where("fast is not null and slow is not null")
    return rows.select("symbol", "date", *six(rows, "fast", "slow"))


@query("win_trend_latest", TREND + " SELECT symbol, '1h' AS timeframe, arg_max(trend, date) AS trend FROM state WHERE trend IS NOT NULL GROUP BY symbol")
def _(spark, d):
    """Only the hourly frame has the 200 bars that the slow average needs."""
    return I.latest_trends(_bars(spark, d), I.TIMEFRAMES)


@query("win_candle_trend", A.ctes("bars") + " SELECT symbol, date, CASE WHEN close_price >= coalesce(lag(close_price) OVER (PARTITION BY symbol ORDER BY date), open) THEN 'up' ELSE 'down' END AS direction FROM bars")
def _(spark, d):
    return I.candle_trend(_bars(spark, d)).select("symbol", "date", "direction")


TICK = 0.01
SEGMENTS = WILDER.replace("FROM bars)", "FROM tight)", 1).replace(A.ctes("bars").replace("WITH ", "WITH RECURSIVE ", 1), A.ctes("tight").replace("WITH ", "WITH RECURSIVE ", 1)) + f""",
k AS (SELECT n.symbol, n.volume, wilder.a AS atr, floor(open / {TICK}::DOUBLE + 0.5)::BIGINT AS o, floor(high / {TICK}::DOUBLE + 0.5)::BIGINT AS h, floor(low / {TICK}::DOUBLE + 0.5)::BIGINT AS l, floor(close_price / {TICK}::DOUBLE + 0.5)::BIGINT AS c FROM n JOIN wilder ON n.symbol = wilder.symbol AND n.i = wilder.i WHERE volume > 0),
kk AS (SELECT *, h - l AS reach, greatest(o, c) AS bt, least(o, c) AS bb, (h - l) - (greatest(o, c) - least(o, c)) AS wick FROM k),
km AS (SELECT *, least(greatest(0.7::DOUBLE + (0.5::DOUBLE - wick / nullif(reach, 0)::DOUBLE) * 0.3::DOUBLE, 0.5::DOUBLE), 0.8::DOUBLE) AS bw, CASE WHEN reach <= 0 THEN 'flat' WHEN atr > 0 AND reach * {TICK}::DOUBLE > 3 * atr THEN 'even' ELSE 'body' END AS kind FROM kk),
segs AS (SELECT symbol, floor((h + l) / 2.0 + 0.5)::BIGINT AS lo, floor((h + l) / 2.0 + 0.5)::BIGINT AS hi, volume::DOUBLE AS amount FROM km WHERE kind = 'flat'
UNION ALL SELECT symbol, l, h, volume::DOUBLE FROM km WHERE kind = 'even'
UNION ALL SELECT symbol, bb, bt, CASE WHEN wick = 0 THEN volume::DOUBLE ELSE volume * bw END FROM km WHERE kind = 'body'
UNION ALL SELECT symbol, bt + 1, h, volume * (1 - bw) * (h - bt) / wick FROM km WHERE kind = 'body' AND wick > 0 AND h > bt
UNION ALL SELECT symbol, l, bb - 1, volume * (1 - bw) * (bb - l) / wick FROM km WHERE kind = 'body' AND wick > 0 AND bb > l),
prof AS (SELECT symbol, t AS bucket, sum(v) AS volume FROM (SELECT symbol, unnest(range(lo, hi + 1)) AS t, amount / (hi - lo + 1) AS v FROM segs) GROUP BY symbol, t)"""
PER_ROW = 4
GRID = SEGMENTS + f""", rowed AS (SELECT symbol, (bucket // {PER_ROW})::BIGINT AS bucket, sum(volume) AS volume FROM prof GROUP BY 1, 2), ends AS (SELECT symbol, min(bucket) AS a, max(bucket) AS b FROM rowed GROUP BY symbol),
grid AS (SELECT g.symbol, g.bucket, coalesce(r.volume, 0) AS volume, a, b FROM (SELECT symbol, a, b, unnest(range(a, b + 1)) AS bucket FROM ends) g LEFT JOIN rowed r ON g.symbol = r.symbol AND g.bucket = r.bucket)"""


def _gauss(sigma: float) -> str:
    return "(VALUES " + ", ".join(f"({k - len(P.kernel(sigma)) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(P.kernel(sigma))) + ") gk(k, w)"


def _smooth_sql(sigma: float) -> str:
    return f""", smooth AS (SELECT t.symbol, t.bucket, sum(s.volume * w) AS volume FROM grid t CROSS JOIN {_gauss(sigma)} JOIN grid s ON s.symbol = t.symbol AND s.bucket = least(greatest(t.bucket + k, t.a), t.b) GROUP BY t.symbol, t.bucket)"""


def _profile(spark, d):
    return P.volume_profile(A.tight_bars(spark, d).drop("interval_type"), TICK)


def _runs(spark, d):
    """The profile in buckets of `PER_ROW` ticks, ATR over all bars."""
    return P.runs(P.segments(I.atr_wilder(A.tight_bars(spark, d).drop("interval_type")), TICK), PER_ROW)


@query("agg_volume_profile", SEGMENTS + f" SELECT symbol, bucket, {r6('volume')} AS volume FROM prof")
def _(spark, d):
    rows = _profile(spark, d)
    return rows.select("symbol", "bucket", *six(rows, "volume"))


@query("agg_volume_profile_rows", GRID + _smooth_sql(1.5 / PER_ROW) + f" SELECT g.symbol, g.bucket, {r6('g.volume')} AS volume, {r6('s.volume')} AS smoothed FROM grid g JOIN smooth s ON g.symbol = s.symbol AND g.bucket = s.bucket")
def _(spark, d):
    rows = P.volume_profile_rows(A.tight_bars(spark, d).drop("interval_type"), PER_ROW, TICK)
    return rows.select("symbol", "bucket", *six(rows, "volume", "smoothed"))


@query("win_gaussian_smooth", GRID + _smooth_sql(1.5) + f" SELECT symbol, bucket, {r6('volume')} AS volume FROM smooth WHERE volume > 0")
def _(spark, d):
    rows = P.points(P.smoothed_runs(_runs(spark, d), 1.5).where("smoothed > 0").select("symbol", "lo", "hi", F.col("smoothed").alias("volume")))
    return rows.select("symbol", "bucket", *six(rows, "volume"))


@query("agg_poc", GRID + f" SELECT symbol, bucket AS poc, {r6('volume')} AS poc_volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bucket) AS r FROM grid) WHERE r = 1")
def _(spark, d):
    rows = P.point_of_control(_runs(spark, d))
    return rows.select("symbol", "poc", *six(rows, "poc_volume"))


@query("agg_value_area", GRID + """, v AS (SELECT symbol, list(volume ORDER BY bucket) AS v, list(bucket ORDER BY bucket) AS bk, sum(volume) AS total FROM grid GROUP BY symbol),
start AS (SELECT symbol, v, bk, total, list_position(v, list_max(v))::BIGINT AS poc FROM v),
walk AS (SELECT symbol, v, bk, total, poc, poc AS lo, poc AS hi, v[poc] AS acc, 0 AS step FROM start
UNION ALL SELECT symbol, v, bk, total, poc, CASE WHEN down THEN lo - 1 ELSE lo END, CASE WHEN down THEN hi ELSE hi + 1 END, acc + CASE WHEN down THEN lv ELSE hv END, step + 1
FROM (SELECT *, lv >= hv AND lo > 1 AS down FROM (SELECT *, CASE WHEN lo > 1 THEN v[lo - 1] ELSE -1 END AS lv, CASE WHEN hi < len(v) THEN v[hi + 1] ELSE -1 END AS hv FROM walk)) WHERE acc < total * 0.7::DOUBLE AND (down OR hi < len(v)))
SELECT symbol, bk[lo] AS value_low, bk[poc] AS poc, bk[hi] AS value_high FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY step DESC) AS r FROM walk) WHERE r = 1""")
def _(spark, d):
    return P.value_area(_runs(spark, d))


@query("profile_conserves_volume", A.ctes("bars") + " SELECT symbol, sum(volume)::BIGINT AS volume FROM bars GROUP BY symbol")
def _(spark, d):
    return _profile(spark, d).groupBy("symbol").agg(F.floor(F.sum("volume") + 0.5).cast("long").alias("volume"))


@query("udf_indicator_registry", A.ctes("bars") + """, c AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)
SELECT id, label, sum(greatest(n - warm + 1, 0))::BIGINT AS n FROM c, (VALUES ('sma20', 'SMA 20', 20), ('sma50', 'SMA 50', 50), ('sma200', 'SMA 200', 200), ('ema12', 'EMA 12', 12), ('ema21', 'EMA 21', 21), ('ema26', 'EMA 26', 26), ('ema200', 'EMA 200', 200),
('bb20', 'Bollinger Bands', 20), ('vwap', 'VWAP', 1), ('volume', 'Volume', 1), ('trend-logic', 'EMA Trend Friend Pro', 200)) i(id, label, warm) GROUP BY id, label""")
def _(spark, d):
    """Every registered indicator, as one row per id: how many bars it has warmed up on."""
    out = None
    for name, i in I.INDICATORS.items():
        rows = I.compute(_bars(spark, d), name)
        column = {"bb": "middle", "volume": "direction", "trend-logic": "trend"}.get(i.kind, i.kind)
        one = rows.agg(F.lit(name).alias("id"), F.lit(i.label).alias("label"), F.count(column).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("fn_round_to_tick", A.ctes("ticks") + " SELECT event_id, floor(price / 0.25::DOUBLE + 0.5)::BIGINT AS tick FROM ticks")
def _(spark, d):
    return A.ticks(spark, d).select("event_id", X.tick_index(F.col("price"), 0.25).alias("tick"))
