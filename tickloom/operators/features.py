"""The feature matrix: price and volume features, gamma features, and the forward target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import series as S
from tickloom.operators.asof import asof
from tickloom.schemas import ATR_BARS, BASELINE_FEATURES, GEX_FEATURES, GRID_MINUTES, ROLLING, RSI_BARS, VOL_BARS, ZERO_DTE_FEATURES


def true_range():
    """Range against the close before; nulls don't count, so the first bar has its own range."""
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev")))


def price_features(bars: DataFrame) -> DataFrame:
    """Rolling features over the rows as they are (rows that the as-of join left), by date within the symbol; `idx` numbers them."""
    log_close = F.ln(F.when(F.col("close_price") > 0, F.col("close_price")))
    rows = S.indexed(bars).withColumns({"_log": log_close, "_tr": true_range(), "_ret": F.ln(F.col("close_price") / F.nullif("prev", F.lit(0.0))), "_diff": F.col("close_price") - F.col("prev"), "_v": F.col("volume").cast("double")})
    gain, loss = F.when(F.col("_diff").isNotNull(), F.greatest("_diff", F.lit(0.0))), F.when(F.col("_diff").isNotNull(), -F.least("_diff", F.lit(0.0)))
    up, down = S.mean(gain, RSI_BARS), S.mean(loss, RSI_BARS)
    columns = {f"log_return_{k * 5}m": F.col("_log") - F.lag("_log", k).over(S.window()) for k in (1, 3, 6, 12)}
    columns |= {
        "realized_vol_60m": S.deviation(F.col("_ret"), VOL_BARS),
        "atr_14": S.mean(F.col("_tr"), ATR_BARS),
        "volume_zscore_20": (F.col("_v") - S.mean(F.col("_v"), ROLLING)) / F.nullif(S.deviation(F.col("_v"), ROLLING), F.lit(0.0)),
        "close_vs_sma20": F.col("close_price") / F.nullif(S.mean(F.col("close_price"), ROLLING), F.lit(0.0)) - 1,
        "rsi_14": 100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))),
    }
    minute = X.minute_of_day(F.col("date"))
    angle = minute * (2.0 * 3.141592653589793) / 1440
    plain = {
        "log_dollar_volume": F.log1p(F.col("close_price") * F.col("volume")),
        "close_position": (F.col("close_price") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)),
        "minutes_since_open": (minute - 810).cast("double"),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }
    return S.rolling(rows, ROLLING, columns).withColumns(plain).drop("_log", "_tr", "_ret", "_diff", "_v", "prev")


def gex_features(rows: DataFrame) -> DataFrame:
    off = lambda level: X.ratio(F.col("close_price") - F.col(level), F.col("atr_14"))
    out = {f"dist_{x}_atr": off(x) for x in ("call_wall", "put_wall", "zero_gamma")}
    return rows.withColumns(out | {"above_zero_gamma": F.signum(F.col("close_price") - F.col("zero_gamma")), "gamma_regime_strength": F.col("net_gex") / (F.col("abs_gex_total") + 1e-8)})


def forward_target(rows: DataFrame, horizon: int) -> DataFrame:
    """target_return: log return `horizon` rows ahead, only where those rows are exactly that many grid steps apart. Rows that are numbered (`idx`) are taken as they are."""
    ahead = S.rolling(rows if "idx" in rows.columns else S.indexed(rows), 0, {"_close": F.lead("close_price", horizon).over(S.window()), "target_time": F.lead("date", horizon).over(S.window())}, ahead=horizon)
    gap = F.unix_seconds(F.col("target_time").cast("timestamp")) - F.unix_seconds(F.col("date").cast("timestamp"))
    target = F.when((gap == horizon * GRID_MINUTES * 60) & (F.col("close_price") > 0) & (F.col("_close") > 0), F.ln(F.col("_close") / F.col("close_price")))
    return ahead.withColumn("target_return", target).drop("_close", "idx", "prev")


def dataset(bars: DataFrame, snapshots: DataFrame, horizon: int, complete: bool = True) -> DataFrame:
    """Bars joined to fresh snapshots (computed_at and the ratios of a snapshot), with features and target."""
    joined = asof(bars.select("symbol", "date", "open", "high", "low", "close_price", "volume"), snapshots, "date", "computed_at", age="gex_age_minutes")
    rows = forward_target(gex_features(price_features(joined)), horizon)
    names = [*BASELINE_FEATURES, *GEX_FEATURES]
    kept = rows.select("symbol", "date", "computed_at", "target_time", "target_return", *names, *ZERO_DTE_FEATURES)
    return kept.dropna(subset=[*names, "target_return"]) if complete else kept


def leakage(rows: DataFrame, horizon: int) -> DataFrame:
    """Counts that must be 0: snapshots after their bar, stale ones, targets at a wrong distance."""
    age = F.unix_micros(F.col("date").cast("timestamp")) - F.unix_micros(F.col("computed_at").cast("timestamp"))
    gap = F.unix_seconds(F.col("target_time").cast("timestamp")) - F.unix_seconds(F.col("date").cast("timestamp"))
    return rows.agg(F.count_if(age < 0).alias("n_future"), F.count_if(age > 15 * 60_000_000).alias("n_stale"), F.count_if(gap != horizon * GRID_MINUTES * 60).alias("n_wrong_gap"))
