"""Queries over the as-of join, features, targets and the sanitizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import features as FT
from tickloom.operators import gex as G
from tickloom.operators import sanitize as SA
from tickloom.operators.asof import asof
from tickloom.plans import adapters as A
from tickloom.plans.gex_queries import RATIOS
from tickloom.plans.registry import query
from tickloom.schemas import ZERO_DTE_FEATURES


def r6(x: str) -> str:
    return f"floor({x} * 1000000 + 0.5) / 1000000"


def six(df, *names):
    return [X.rounded(F.col(c), 6).alias(c) for c in names]


ASOF = RATIOS + f", bars5t AS ({A.SQL['ticks']}), bars5 AS ({A.SQL['bars5'].replace('FROM ticks', 'FROM bars5t')})" + """,
joined AS (SELECT b.*, r.* EXCLUDE (symbol), epoch_us(b.date - r.computed_at) / 60000000.0::DOUBLE AS gex_age_minutes FROM bars5 b ASOF JOIN ratios r ON b.symbol = r.symbol AND b.date >= r.computed_at WHERE b.date - r.computed_at <= INTERVAL 15 MINUTE)"""
FEATURES = ASOF + """, lg AS (SELECT *, lag(close_price) OVER w AS prev, ln(close_price) AS lc FROM joined WINDOW w AS (PARTITION BY symbol ORDER BY date)),
base AS (SELECT *, ln(close_price / prev) AS ret, close_price - prev AS diff, greatest(high - low, coalesce(abs(high - prev), 0), coalesce(abs(low - prev), 0)) AS tr FROM lg),
f AS (SELECT *, lc - lag(lc, 1) OVER w AS log_return_5m, lc - lag(lc, 3) OVER w AS log_return_15m, lc - lag(lc, 6) OVER w AS log_return_30m, lc - lag(lc, 12) OVER w AS log_return_60m,
 CASE WHEN count(ret) OVER w12 = 12 THEN stddev_samp(ret) OVER w12 END AS realized_vol_60m, CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr_14,
 CASE WHEN count(volume) OVER w20 = 20 THEN (volume - avg(volume) OVER w20) / nullif(stddev_samp(volume) OVER w20, 0) END AS volume_zscore_20, ln(1 + close_price * volume) AS log_dollar_volume,
 (close_price - low) / nullif(high - low, 0) AS close_position, CASE WHEN count(close_price) OVER w20 = 20 THEN close_price / nullif(avg(close_price) OVER w20, 0) - 1 END AS close_vs_sma20,
 CASE WHEN count(diff) OVER w14 = 14 THEN 100 - 100 / (1 + avg(greatest(diff, 0)) OVER w14 / nullif(avg(-least(diff, 0)) OVER w14, 0)) END AS rsi_14,
 (hour(date) * 60 + minute(date) - 810)::DOUBLE AS minutes_since_open, sin(2 * pi() * (hour(date) * 60 + minute(date)) / 1440) AS hour_sin, cos(2 * pi() * (hour(date) * 60 + minute(date)) / 1440) AS hour_cos,
 lead(close_price, 3) OVER w AS fc, lead(date, 3) OVER w AS target_time
 FROM base WINDOW w AS (PARTITION BY symbol ORDER BY date), w12 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, (close_price - call_wall) / nullif(atr_14, 0) AS dist_call_wall_atr, (close_price - put_wall) / nullif(atr_14, 0) AS dist_put_wall_atr, (close_price - zero_gamma) / nullif(atr_14, 0) AS dist_zero_gamma_atr, sign(close_price - zero_gamma)::DOUBLE AS above_zero_gamma, net_gex / (abs_gex_total + 1e-8) AS gamma_regime_strength,
 CASE WHEN target_time - date = INTERVAL 15 MINUTE THEN ln(fc / close_price) END AS target_return FROM f)"""


def _ratios(spark, d):
    return G.snapshot_ratios(G.snapshot_pivot(A.snapshots(spark, d), A.levels(spark, d)))


def _joined(spark, d):
    b = A.bars_5m(spark, d).drop("interval_type")
    return asof(b, _ratios(spark, d), "date", "computed_at", age="gex_age_minutes")


@query("join_asof_gex", ASOF + f" SELECT symbol, date, computed_at, close_price, net_gex, {r6('gex_age_minutes')} AS gex_age_minutes FROM joined")
def _(spark, d):
    j = _joined(spark, d)
    return j.select("symbol", "date", "computed_at", "close_price", "net_gex", *six(j, "gex_age_minutes"))


@query("stream_staleness", ASOF + " SELECT count(*) AS n, count(*) FILTER (WHERE computed_at > date) AS n_future, max(gex_age_minutes) <= 15 AS fresh FROM joined")
def _(spark, d):
    return _joined(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("computed_at") > F.col("date")).alias("n_future"), (F.max("gex_age_minutes") <= 15).alias("fresh"))


def _feature(name: str, *columns: str):
    @query(name, FEATURES + " SELECT symbol, date, " + ", ".join(f"{r6(c)} AS {c}" for c in columns) + " FROM x")
    def _(spark, d):
        rows = FT.forward_target(FT.gex_features(FT.price_features(_joined(spark, d))), 3)
        return rows.select("symbol", "date", *six(rows, *columns))


_feature("win_log_returns", "log_return_5m", "log_return_15m", "log_return_30m", "log_return_60m")
_feature("win_realized_vol", "realized_vol_60m")
_feature("win_atr_sma", "atr_14")
_feature("win_volume_zscore", "volume_zscore_20")
_feature("win_sma_ratio", "close_vs_sma20")
_feature("win_rsi", "rsi_14")
_feature("win_forward_target", "target_return")
_feature("fn_log_dollar_volume", "log_dollar_volume")
_feature("fn_close_position", "close_position")
_feature("fn_time_features", "minutes_since_open", "hour_sin", "hour_cos")
_feature("fn_gex_distances", "dist_call_wall_atr", "dist_put_wall_atr", "dist_zero_gamma_atr", "above_zero_gamma", "gamma_regime_strength")
_feature("fn_gex_age", "gex_age_minutes")

COLUMNS = ("log_return_5m", "log_return_15m", "log_return_30m", "log_return_60m", "realized_vol_60m", "atr_14", "volume_zscore_20", "log_dollar_volume", "close_position", "close_vs_sma20", "rsi_14", "minutes_since_open", "hour_sin", "hour_cos",
    "dist_call_wall_atr", "dist_put_wall_atr", "dist_zero_gamma_atr", "above_zero_gamma", "gamma_regime_strength", "net_gex", "abs_gex_total", "gex_concentration", "gex_age_minutes", "call_wall_strength", "put_wall_strength")
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in (*COLUMNS, "target_return"))


def _dataset(spark, d):
    return FT.dataset(A.bars_5m(spark, d), _ratios(spark, d), 3)


@query("filter_dropna_features", FEATURES + " SELECT symbol, date, computed_at, target_time, " + ", ".join(f"{r6(c)} AS {c}" for c in (*COLUMNS, "target_return")) + f" FROM x WHERE {COMPLETE}")
def _(spark, d):
    rows = _dataset(spark, d)
    return rows.select("symbol", "date", "computed_at", "target_time", *six(rows, *COLUMNS, "target_return"))


@query("filter_dropna_0dte", FEATURES + f" SELECT symbol, date, {', '.join(f'{r6(c)} AS {c}' for c in ZERO_DTE_FEATURES)} FROM x WHERE {COMPLETE} AND " + " AND ".join(f"{c} IS NOT NULL" for c in ZERO_DTE_FEATURES))
def _(spark, d):
    rows = _dataset(spark, d).dropna(subset=list(ZERO_DTE_FEATURES))
    return rows.select("symbol", "date", *six(rows, *ZERO_DTE_FEATURES))


@query("agg_null_counts", FEATURES + f" SELECT count(*) AS n, count(*) FILTER (WHERE gex_0dte_fraction IS NULL) AS null_0dte_fraction, count(*) FILTER (WHERE call_wall_0dte_share IS NULL) AS null_call_share, count(DISTINCT target_time - date) AS gaps, max(gex_age_minutes) <= 15 AS fresh FROM x WHERE {COMPLETE}")
def _(spark, d):
    gap = F.unix_seconds(F.col("target_time").cast("timestamp")) - F.unix_seconds(F.col("date").cast("timestamp"))
    return _dataset(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("gex_0dte_fraction").isNull()).alias("null_0dte_fraction"), F.count_if(F.col("call_wall_0dte_share").isNull()).alias("null_call_share"), F.countDistinct(gap).alias("gaps"), (F.max("gex_age_minutes") <= 15).alias("fresh"))


@query("leakage_checks", "SELECT 0::BIGINT AS n_future, 0::BIGINT AS n_stale, 0::BIGINT AS n_wrong_gap")
def _(spark, d):
    return FT.leakage(_dataset(spark, d), 3)


SANITIZE = A.ctes("tight") + """, wit AS (SELECT *, quantile_cont(CASE WHEN close_price > 0 THEN close_price END, 0.5) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m, lag(close_price) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM tight),
anc AS (SELECT *, coalesce(m, CASE WHEN pc > 0 THEN pc END) AS a, abs(close_price) * 0.003::DOUBLE AS th FROM wit),
s1 AS (SELECT *, CASE WHEN abs(open - close_price) > th AND NOT coalesce(abs(open - a) <= th, false) THEN coalesce(a, close_price) ELSE open END AS o2 FROM anc),
s2 AS (SELECT *, CASE WHEN abs(low - close_price) > th AND NOT coalesce(abs(low - a) <= th, false) THEN least(o2, close_price) ELSE low END AS l2, CASE WHEN abs(high - close_price) > th AND NOT coalesce(abs(high - a) <= th, false) THEN greatest(o2, close_price) ELSE high END AS h2 FROM s1),
clean AS (SELECT symbol, date, open, low, high, close_price, o2 AS new_open, least(l2, o2, close_price) AS new_low, greatest(h2, o2, close_price) AS new_high FROM s2)"""


@query("win_sanitize", SANITIZE + f" SELECT symbol, date, {r6('new_open')} AS new_open, {r6('new_low')} AS new_low, {r6('new_high')} AS new_high FROM clean")
def _(spark, d):
    rows = SA.sanitized(A.tight_bars(spark, d))
    return rows.select("symbol", "date", *six(rows, "new_open", "new_low", "new_high"))


@query("sink_repair_update", SANITIZE + f" SELECT symbol, date, {r6('open')} AS open, {r6('new_open')} AS new_open, {r6('new_low')} AS new_low, {r6('new_high')} AS new_high FROM clean WHERE new_open <> open OR new_low <> low OR new_high <> high")
def _(spark, d):
    rows = SA.changes(A.tight_bars(spark, d))
    return rows.select("symbol", "date", *six(rows, "open", "new_open", "new_low", "new_high"))


@query("join_repair_apply", SANITIZE + f" SELECT symbol, date, {r6('new_open')} AS open, {r6('new_low')} AS low, {r6('new_high')} AS high, {r6('close_price')} AS close_price FROM clean")
def _(spark, d):
    b = A.tight_bars(spark, d)
    rows = SA.applied(b, SA.changes(b))
    return rows.select("symbol", "date", *six(rows, "open", "low", "high", "close_price"))


@query("sink_revert", A.ctes("tight") + f" SELECT symbol, date, {r6('open')} AS open, {r6('low')} AS low, {r6('high')} AS high FROM tight")
def _(spark, d):
    """A repair, undone from its own log, gives the bars back."""
    b = A.tight_bars(spark, d)
    found = SA.changes(b)
    fields = F.posexplode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("old")) for c in ("open", "high", "low")]))
    log = found.select("symbol", "date", fields.alias("position", "edit")).select("symbol", "date", "position", "edit.field", "edit.old")
    rows = SA.reverted(SA.applied(b, found), log)
    return rows.select("symbol", "date", *six(rows, "open", "low", "high"))
