"""Scalar expressions as Columns: rounding, guarded division, option maths, exchange sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.schemas import MIN_YEARS, RISK_FREE

EXCHANGE_ZONE = "America/New_York"
#: How logs write times.
LOG_DATES = ("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def rounded(x: Column | str, places: int = 2) -> Column:
    """Half up, by floor: the same on every engine, unlike round() on doubles. What is too large to have a fraction, infinite or no number stays (floor() gives a long)."""
    x = F.col(x) if isinstance(x, str) else x
    scale = F.lit(float(10**places))
    up = (x * scale + F.lit(0.5)).cast("double")
    return F.when(F.abs(up) < F.lit(2.0**53), F.floor(up).cast("double")).otherwise(up) / scale


def ln(x: Column) -> Column:
    """Natural logarithm: -Infinity at 0 and NaN below, where the built-in gives null."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def log1p(x: Column) -> Column:
    """ln(1 + x), accurate near 0; -Infinity at -1 and NaN below."""
    return F.when(x == -1, F.lit(float("-inf"))).when(x < -1, F.lit(float("nan"))).otherwise(F.log1p(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0.0))


def finite(x: Column) -> Column:
    """x as a double; null if it isn't a finite number."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def norm_pdf(x: Column) -> Column:
    return F.exp(F.lit(-0.5) * x * x) / F.sqrt(F.lit(2.0) * F.pi())


def bs_gamma(spot: Column, strike: Column, years: Column, iv: Column, rate: float = RISK_FREE) -> Column:
    """Black-Scholes gamma; 0 unless spot, strike, time and volatility are all positive."""
    good = (spot > 0) & (strike > 0) & (years > 0) & (iv > 0)
    spread = F.when(good, iv) * F.sqrt(F.when(good, years))
    d1 = (F.ln(F.when(good, spot / strike)) + (F.lit(rate) + iv * iv / 2) * years) / spread
    return F.coalesce(norm_pdf(d1) / (spot * spread), F.lit(0.0))


def years_to_expiry(days: Column) -> Column:
    return F.greatest(days / F.lit(365.0), F.lit(MIN_YEARS))


def dte_bucket(days: Column) -> Column:
    return F.when(days <= 0, "0dte").when(days == 1, "1dte").when(days <= 7, "weekly").otherwise("monthly")


def exchange_time(utc: Column) -> Column:
    return F.from_utc_timestamp(utc.cast("timestamp"), EXCHANGE_ZONE)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def exchange_weekday(utc: Column) -> Column:
    return F.weekday(exchange_time(utc)) < 5


def between_minutes(utc: Column, start: int, stop: int) -> Column:
    """Weekday and start <= minute of the exchange's day < stop."""
    m = minute_of_day(exchange_time(utc))
    return exchange_weekday(utc) & (m >= start) & (m < stop)


def market_open(utc: Column) -> Column:
    return between_minutes(utc, 570, 960)


def premarket(utc: Column) -> Column:
    return between_minutes(utc, 540, 570)


def postclose(utc: Column) -> Column:
    return between_minutes(utc, 960, 990)


def intraday_gate(utc: Column) -> Column:
    """09:30 to 16:15, to the minute."""
    return between_minutes(utc, 570, 976)


def daily_gate(utc: Column) -> Column:
    """16:25 to 16:40 on any day."""
    t = exchange_time(utc)
    return (F.hour(t) == 16) & F.minute(t).between(25, 40)


def floor_minutes(ts: Column, n: int) -> Column:
    """Start of the n-minute bucket since midnight."""
    day = F.date_trunc("day", ts)
    return (day + F.make_interval(mins=(F.floor(minute_of_day(ts) / n) * n).cast("int"))).cast("timestamp_ntz")


def monday(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("timestamp_ntz")


def tick_index(price: Column, tick: float) -> Column:
    return F.floor(price / F.lit(tick) + F.lit(0.5)).cast("long")


def ingestion_timer(ts: Column) -> Column:
    """The timer that fires in the 5-minute slot of a UTC time: regular (Monday to Friday, 13 to 20 h) or globex (Sunday, 22 and 23 h)."""
    day, hour = F.weekday(ts), F.hour(ts)
    return F.when((day <= 4) & hour.between(13, 20), "regular").when((day == 6) & hour.isin(22, 23), "globex")


def ticker_list(setting: Column) -> Column:
    """The symbols of a comma-separated setting, trimmed and upper-cased, empty ones dropped."""
    return F.filter(F.transform(F.split(setting, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def parsed_time(text: Column) -> Column:
    """A time in one of the formats of the logs, at Greenwich where it names no zone; null for others."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in LOG_DATES]).cast("timestamp_ntz")
