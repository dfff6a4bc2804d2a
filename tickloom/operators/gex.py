"""Dealer gamma exposure: per-strike aggregation, flow statistics, walls and flip, snapshots.

Contracts have underlying, side (call or put), days_out, strike,
implied_volatility, open_interest, volume. The only shuffle of contracts is the
aggregation per (underlying, strike), with map-side partial sums; all later
steps work on strikes, of which an underlying has few hundreds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators.order import checkpointed
from tickloom.schemas import MAX_DAYS_OUT, MAX_EXPIRATIONS, MIN_IV

BUCKETS = ("0dte", "1dte", "weekly", "monthly")


def near_expirations(contracts: DataFrame, max_days: int = MAX_DAYS_OUT, most: int = MAX_EXPIRATIONS) -> DataFrame:
    """Contracts of the first expirations in reach: the distinct (underlying, days_out) are ranked, then joined back."""
    near = contracts.where(F.col("days_out").between(0, max_days))
    listed = near.select("underlying", "days_out").distinct()
    first = listed.withColumn("k", F.row_number().over(Window.partitionBy("underlying").orderBy("days_out"))).where(F.col("k") <= most).drop("k")
    return near.join(first, ["underlying", "days_out"], "left_semi")


def gex_by_strike(contracts: DataFrame, spot: float, futures: float) -> DataFrame:
    """Per strike with an eligible contract (open interest, and volatility of MIN_IV or more): call, put and total exposure, and the same by days-to-expiry bucket, rounded to 2."""
    gamma = X.bs_gamma(F.lit(spot), F.col("strike"), X.years_to_expiry(F.col("days_out")), F.col("implied_volatility"))
    amount = gamma * F.col("open_interest") * 100 * spot
    eligible = (F.col("strike") > 0) & (F.col("open_interest") > 0) & (F.col("implied_volatility") >= MIN_IV)
    signed = F.when(F.col("side") == "call", amount).otherwise(-amount)
    bucket = X.dte_bucket(F.col("days_out"))
    sums = contracts.where(eligible).groupBy("underlying", "strike").agg(
        F.sum(F.when(F.col("side") == "call", amount).otherwise(0.0)).alias("gex_call"),
        F.sum(F.when(F.col("side") == "put", -amount).otherwise(0.0)).alias("gex_put"),
        *[F.sum(F.when(bucket == b, signed).otherwise(0.0)).alias(f"gex_{b}") for b in BUCKETS],
    )
    ratio = X.rounded(F.lit(futures) / spot, 4)
    return sums.select(
        "underlying", X.rounded("strike").alias("strike_etf"), X.rounded(F.col("strike") * ratio).alias("strike_futures"), X.rounded(F.col("gex_call") + F.col("gex_put")).alias("gex"),
        *[X.rounded(c).alias(c) for c in ("gex_call", "gex_put", *(f"gex_{b}" for b in BUCKETS))],
    )


def put_call_ratios(contracts: DataFrame) -> DataFrame:
    total = lambda side, c: F.coalesce(F.sum(F.when(F.col("side") == side, F.col(c).cast("double"))), F.lit(0.0))
    pick = lambda c: X.rounded(total("put", c) / F.greatest(total("call", c), F.lit(1.0)), 4)
    return contracts.groupBy("underlying").agg(pick("volume").alias("pcr_volume"), pick("open_interest").alias("pcr_oi"))


def _mean_iv(side: str, *more):
    keep = (F.col("side") == side) & (F.col("implied_volatility") >= MIN_IV)
    for m in more:
        keep = keep & m
    return F.avg(F.when(keep, F.col("implied_volatility")))


def iv_by_strike(contracts: DataFrame) -> DataFrame:
    """Mean call and put volatility of the strikes that have both."""
    return contracts.groupBy("underlying", "strike").agg(_mean_iv("call").alias("call_iv"), _mean_iv("put").alias("put_iv")).where("call_iv is not null and put_iv is not null")


def iv_atm(contracts: DataFrame, spot: float) -> DataFrame:
    """Mean of call and put volatility at the two-sided strike nearest the spot; the lower strike on ties."""
    nearest = F.struct(F.abs(F.col("strike") - spot).alias("off"), F.col("strike"))
    return iv_by_strike(contracts).groupBy("underlying").agg(X.rounded(F.min_by((F.col("call_iv") + F.col("put_iv")) / 2, nearest), 4).alias("iv_atm"))


def iv_skew(contracts: DataFrame, spot: float) -> DataFrame:
    puts = _mean_iv("put", F.col("strike").between(0.90 * spot, 0.97 * spot))
    calls = _mean_iv("call", F.col("strike").between(1.03 * spot, 1.10 * spot))
    return contracts.groupBy("underlying").agg(X.rounded(puts - calls, 4).alias("iv_skew"))


def walls(strikes: DataFrame, side: str) -> DataFrame:
    """Largest positive (call) or most negative (put) exposure; the lowest strike on ties."""
    gex = F.col("gex")
    sign = gex > 0 if side == "call" else gex < 0
    order = F.struct((-gex if side == "call" else gex).alias("o"), F.col("strike_etf"))
    rest = [c for c in strikes.columns if c != "underlying"]
    best = strikes.where(sign).groupBy("underlying").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select("underlying", *[F.col(f"r.{c}").alias(c) for c in rest])


def significant(strikes: DataFrame, positive: bool, most: int = 3) -> DataFrame:
    """The next largest strikes of one sign after the wall, in order."""
    gex = F.col("gex")
    order = Window.partitionBy("underlying").orderBy(-gex if positive else gex, "strike_etf")
    return strikes.where(gex > 0 if positive else gex < 0).withColumn("k", F.row_number().over(order)).where(F.col("k").between(2, most + 1)).withColumn("k", F.col("k") - 1)


def gamma_flip(strikes: DataFrame, spot: float) -> DataFrame:
    """Where the running exposure over strikes changes sign, interpolated; the crossing nearest the spot, the lower on ties."""
    order = Window.partitionBy("underlying").orderBy("strike_etf")
    run = strikes.withColumn("cum", F.sum("gex").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lag = {c: F.lag(c).over(order) for c in ("cum", "strike_etf", "strike_futures")}
    run = run.select("underlying", "strike_etf", "strike_futures", "cum", *[v.alias(f"_{c}") for c, v in lag.items()]).where("_cum * cum < 0")
    weight = F.abs("_cum") / (F.abs("_cum") + F.abs("cum"))
    at = lambda c: F.col(f"_{c}") + weight * (F.col(c) - F.col(f"_{c}"))
    found = run.select("underlying", at("strike_etf").alias("e"), at("strike_futures").alias("f"), "strike_etf")
    best = found.groupBy("underlying").agg(F.min_by(F.struct("e", "f"), F.struct(F.abs(F.col("e") - spot).alias("off"), F.col("strike_etf"))).alias("r"))
    return best.select("underlying", X.rounded("r.e").alias("strike_etf"), X.rounded("r.f").alias("strike_futures"))


LEVEL = ("underlying", "label", "place", "strike_etf", "strike_futures", "gex", "gex_call", "gex_put", *(f"gex_{b}" for b in BUCKETS))


def key_levels(strikes: DataFrame, spot: float) -> DataFrame:
    """call_wall, put_wall, zero_gamma (exposures 0), and up to three significant strikes of either sign.

    Strikes are few hundred rows an underlying; they are aggregated once, for all five kinds of level to read.
    """
    strikes = checkpointed(strikes)
    tag = lambda df, label, place: df.withColumns({"label": F.lit(label), "place": place}).select(*LEVEL)
    flip = gamma_flip(strikes, spot).withColumns({c: F.lit(0.0) for c in LEVEL[5:]})
    out = tag(walls(strikes, "call"), "call_wall", F.lit(1))
    out = out.unionByName(tag(walls(strikes, "put"), "put_wall", F.lit(1))).unionByName(tag(flip, "zero_gamma", F.lit(1)))
    out = out.unionByName(tag(significant(strikes, True), "significant_pos", F.col("k")))
    return out.unionByName(tag(significant(strikes, False), "significant_neg", F.col("k")))


def snapshot_pivot(snapshots: DataFrame, levels: DataFrame, null_as_zero: bool = False) -> DataFrame:
    """Levels of a snapshot as columns, with sums; null 0DTE stays null, or counts as 0 where any level has it."""
    j = snapshots.select("id", "symbol", "computed_at", "etf_price").join(levels.select("gamma_exposure_id", "label", "strike_etf", "gex", "gex_0dte"), F.col("id") == F.col("gamma_exposure_id"))
    pick = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    zero = F.col("gex_0dte")
    any_zero = F.max(zero.isNotNull())
    filled = (lambda x: F.when(any_zero, F.coalesce(x, F.lit(0.0)))) if null_as_zero else (lambda x: x)
    return j.groupBy("symbol", "computed_at").agg(
        pick("call_wall", "strike_etf").alias("call_wall"), pick("put_wall", "strike_etf").alias("put_wall"), pick("zero_gamma", "strike_etf").alias("zero_gamma"),
        pick("call_wall", "gex").alias("call_wall_gex"), pick("put_wall", "gex").alias("put_wall_gex"), filled(pick("call_wall", "gex_0dte")).alias("call_wall_0dte_gex"), filled(pick("put_wall", "gex_0dte")).alias("put_wall_0dte_gex"),
        F.sum("gex").alias("net_gex"), F.sum(F.abs("gex")).alias("abs_gex_total"), F.sum(F.col("gex") * F.col("gex")).alias("sum_gex_squared"), F.sum(zero).alias("net_gex_0dte_raw"), F.sum(F.abs(zero)).alias("abs_gex_0dte_total"),
    )


def snapshot_ratios(pivot: DataFrame) -> DataFrame:
    share = lambda a, b: X.ratio(a, F.col(b))
    return pivot.select(
        "symbol", "computed_at", "call_wall", "put_wall", "zero_gamma", "net_gex", "abs_gex_total",
        share(F.col("sum_gex_squared") / F.nullif("abs_gex_total", F.lit(0.0)), "abs_gex_total").alias("gex_concentration"),
        share(F.abs("call_wall_gex"), "abs_gex_total").alias("call_wall_strength"), share(F.abs("put_wall_gex"), "abs_gex_total").alias("put_wall_strength"),
        share(F.col("abs_gex_0dte_total"), "abs_gex_total").alias("gex_0dte_fraction"), share(F.col("net_gex_0dte_raw"), "abs_gex_0dte_total").alias("gex_0dte_polarity"),
        share(F.col("call_wall_0dte_gex"), "abs_gex_total").alias("call_wall_0dte_share"), share(F.col("put_wall_0dte_gex"), "abs_gex_total").alias("put_wall_0dte_share"),
    )


def with_usable_levels(snapshots: DataFrame, levels: DataFrame, strict: bool = True) -> DataFrame:
    """Snapshots that have a level with usable strikes; strict: both strikes and both prices."""
    good = levels.where("strike_futures is not null" + (" and strike_etf is not null" if strict else "")).select("gamma_exposure_id")
    rows = snapshots.where("etf_price is not null and futures_price is not null") if strict else snapshots
    return rows.join(good, rows["id"] == good["gamma_exposure_id"], "left_semi")


def latest_valid(snapshots: DataFrame, levels: DataFrame) -> DataFrame:
    """Newest snapshot per symbol, valid ones first. Validity is a semi-join, picked by one aggregation."""
    valid = with_usable_levels(snapshots, levels, strict=False).select(F.col("id").alias("_id"))
    marked = snapshots.join(valid, snapshots["id"] == valid["_id"], "left").withColumn("valid", F.col("_id").isNotNull()).drop("_id")
    rest = [c for c in marked.columns if c != "symbol"]
    best = marked.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("valid", "computed_at")).alias("r"))
    return best.select("symbol", *[F.col(f"r.{c}").alias(c) for c in rest])


def fallback(snapshots: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest strictly valid snapshot per symbol as a new closed-market row (flow columns dropped), and its complete levels."""
    good = with_usable_levels(snapshots, levels)
    keep = ["id", "computed_at", "etf_price", "futures_price", "conversion_ratio", "expirations_used"]
    best = good.groupBy("symbol").agg(F.max_by(F.struct(*keep), "computed_at").alias("r")).select("symbol", *[F.col(f"r.{c}").alias(c) for c in keep])
    parent = best.select(F.col("id").alias("from_id"), "symbol", "etf_price", "futures_price", "conversion_ratio", "expirations_used", F.lit(False).alias("market_open"))
    whole = levels.where("strike_etf is not null and strike_futures is not null")
    return parent, whole.join(parent.select(F.col("from_id").alias("gamma_exposure_id")), "gamma_exposure_id", "left_semi")


def clean_up(snapshots: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels with strikes only; snapshots with prices that still have a level."""
    kept = levels.where("strike_etf is not null and strike_futures is not null")
    left = snapshots.where("etf_price is not null and futures_price is not null")
    return left.join(kept.select(F.col("gamma_exposure_id").alias("id")).distinct(), "id", "left_semi"), kept


def orphans(snapshots: DataFrame, levels: DataFrame) -> DataFrame:
    """Snapshots without a level (NOT IN; level keys are never null)."""
    return snapshots.join(levels.where("gamma_exposure_id is not null").select(F.col("gamma_exposure_id").alias("id")), "id", "left_anti")
