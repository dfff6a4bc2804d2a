"""Table schemas (Spark DDL) and the constants of the domain."""

BARS = "symbol string, date timestamp_ntz, interval_type string, open double, high double, low double, close_price double, volume bigint, fetched_at timestamp_ntz"
MARKET_DATA = "symbol string, price double, volume bigint, timestamp timestamp_ntz"
GAMMA_EXPOSURE = "id bigint, symbol string, computed_at timestamp_ntz, etf_price double, futures_price double, conversion_ratio double, expirations_used string, market_open boolean, pcr_volume double, pcr_oi double, iv_atm double, iv_skew double"
GAMMA_LEVELS = "id bigint, gamma_exposure_id bigint, strike_etf double, strike_futures double, gex double, gex_call double, gex_put double, gex_0dte double, gex_1dte double, gex_weekly double, gex_monthly double, label string"
CHART_JSON = """struct<chart:struct<result:array<struct<
    meta:struct<symbol:string,regularMarketPrice:double,regularMarketVolume:bigint,previousClose:double,chartPreviousClose:double>,
    timestamp:array<bigint>,
    indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>>>>>>"""
OPTION_JSON = """struct<expirationDates:array<bigint>,options:array<struct<expirationDate:bigint,
    calls:array<struct<strike:double,impliedVolatility:double,openInterest:double,volume:double>>,
    puts:array<struct<strike:double,impliedVolatility:double,openInterest:double,volume:double>>>>>"""

# Must equal the reference's for equal results.
RISK_FREE, MAX_EXPIRATIONS, MAX_DAYS_OUT, MIN_YEARS, MIN_IV = 0.05, 4, 30, 1 / 365, 0.01
FUTURES_OF = {"QQQ": "NQ=F", "SPY": "ES=F", "IWM": "RTY=F", "DIA": "YM=F"}
OUTLIER_SHARE, WITNESS_BARS, SANITIZED_INTERVALS = 0.003, 5, ("1m", "2m", "5m")
GRID_MINUTES, STALE_MINUTES, ROLLING, ATR_BARS, RSI_BARS, VOL_BARS = 5, 15, 20, 14, 14, 12
TICK, BODY_WEIGHT, EXTREME_ATR, SIGMA_TICKS = 0.25, 0.7, 3.0, 1.5
HORIZONS = (1, 3, 6, 12, 24)
PERIODS_PER_YEAR, BOOTSTRAP_BLOCK, BOOTSTRAP_SAMPLES = 252 * 26, 73, 1000
STORED_INTERVAL = {"1m": "1m", "5m": "5m", "15m": "5m", "30m": "5m", "1h": "1h", "4h": "1h", "1d": "1d", "1wk": "1d"}
ROLLUP_MINUTES = {"15m": 15, "30m": 30, "4h": 240}
BUFFER_DAYS = {"1d": 8, "5d": 12, "10d": 17, "14d": 21}
MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60, "10y": 120}
VALID_PERIODS = {
    "1m": ("1d", "5d"),
    "5m": ("1d", "5d", "10d", "14d", "1mo", "3mo"),
    "15m": ("1d", "5d", "10d", "14d", "1mo", "3mo"),
    "30m": ("1d", "5d", "10d", "14d", "1mo", "3mo"),
    "1h": ("1d", "5d", "10d", "14d", "1mo", "3mo", "6mo", "1y", "2y"),
    "4h": ("1d", "5d", "10d", "14d", "1mo", "3mo", "6mo", "1y", "2y"),
    "1d": ("1d", "5d", "10d", "14d", "1mo", "3mo", "6mo", "1y", "2y", "max"),
    "1wk": ("1mo", "3mo", "6mo", "1y", "2y", "max"),
}
BASELINE_FEATURES = ("log_return_5m", "log_return_15m", "log_return_30m", "log_return_60m", "realized_vol_60m", "atr_14", "volume_zscore_20", "log_dollar_volume", "close_position", "close_vs_sma20", "rsi_14", "minutes_since_open", "hour_sin", "hour_cos")
TRAINING_BASELINE = ("log_return_5m", "log_return_15m", "log_return_30m", "log_return_60m", "realized_vol_60m", "atr_14", "volume_zscore_20", "log_dollar_volume", "close_position", "rsi_14", "hour_sin", "hour_cos")
GEX_FEATURES = ("dist_call_wall_atr", "dist_put_wall_atr", "dist_zero_gamma_atr", "above_zero_gamma", "gamma_regime_strength", "net_gex", "abs_gex_total", "gex_concentration", "gex_age_minutes", "call_wall_strength", "put_wall_strength")
FLOW_FEATURES = ("pcr_volume", "pcr_oi", "iv_atm", "iv_skew")
ZERO_DTE_FEATURES = ("gex_0dte_fraction", "gex_0dte_polarity", "call_wall_0dte_share", "put_wall_0dte_share")
