"""Volume profile: a bar's volume spread over price ticks, smoothing, point of control, value area.

Prices become integer tick indices first, so ties and neighbours are exact. A bar
gives up to three segments of ticks. A profile is kept as a step function over
ticks, found from the ends of the segments by a prefix sum: its rows follow the
bars, and one bad price adds a run, not the ticks in between. Rows for every
tick or bucket are made only where they are the result.
"""

from __future__ import annotations

from math import ceil, exp

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators.indicators import atr_wilder
from tickloom.schemas import ATR_BARS, BODY_WEIGHT, EXTREME_ATR, SIGMA_TICKS, TICK
from tickloom.session import stored

REQUIRED = ("open", "high", "low", "close", "volume")


def normalized_columns(rows: DataFrame) -> DataFrame:
    """Lower-case OHLCV names; raises if one is missing."""
    out = rows.withColumnsRenamed({c: c.lower() for c in rows.columns})
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def segments(bars: DataFrame, tick: float = TICK, body_weight: float = BODY_WEIGHT, extreme: float = EXTREME_ATR) -> DataFrame:
    """(symbol, lo, hi, amount) of bars with an `atr` column: tick ranges over which a volume is spread evenly."""
    snap = {f"_{c}": X.tick_index(F.col(c), tick) for c in ("open", "high", "low")} | {"_close": X.tick_index(F.col("close_price"), tick)}
    b = bars.where("volume > 0").dropna(subset=["open", "high", "low", "close_price"]).withColumns(snap)
    o, h, low, c, v = (F.col(x) for x in ("_open", "_high", "_low", "_close", "volume"))
    reach = h - low
    top, bottom = F.greatest(o, c), F.least(o, c)
    wick = reach - (top - bottom)
    share = F.least(F.greatest(body_weight + (0.5 - wick / F.nullif(reach, F.lit(0))) * 0.3, F.lit(0.5)), F.lit(0.8))
    body = F.when(wick == 0, v.cast("double")).otherwise(v * share)
    rest = v * (1 - share)
    piece = lambda lo, hi, amount: F.struct(lo.alias("lo"), hi.alias("hi"), amount.cast("double").alias("amount"))
    middle = F.floor((h + low) / 2 + F.lit(0.5)).cast("long")
    three = F.array(
        piece(bottom, top, body),
        F.when((wick > 0) & (h > top), piece(top + 1, h, rest * (h - top) / F.nullif(wick, F.lit(0)))),
        F.when((wick > 0) & (bottom > low), piece(low, bottom - 1, rest * (bottom - low) / F.nullif(wick, F.lit(0)))),
    )
    flat = F.array(piece(middle, middle, v))
    even = F.array(piece(low, h, v))
    parts = F.when(reach <= 0, flat).when((F.col("atr") > 0) & (reach * tick > extreme * F.col("atr")), even).otherwise(F.array_compact(three))
    return b.select("symbol", F.explode(parts).alias("s")).select("symbol", "s.lo", "s.hi", "s.amount")


def bucketed(parts: DataFrame, per_row: int) -> DataFrame:
    """(symbol, lo, hi, amount): segments of ticks as up to three stretches of buckets of `per_row` ticks, `amount` in each bucket."""
    lo, hi = F.col("lo"), F.col("hi")
    each = F.col("amount") / (hi - lo + 1)
    first, last = F.floor(lo / per_row), F.floor(hi / per_row)
    piece = lambda a, b, amount: F.struct(a.alias("lo"), b.alias("hi"), amount.cast("double").alias("amount"))
    inner = F.when(last - first > 1, piece(first + 1, last - 1, each * per_row))
    several = F.array_compact(F.array(piece(first, first, each * (per_row * (first + 1) - lo)), inner, piece(last, last, each * (hi - per_row * last + 1))))
    pieces = F.when(first == last, F.array(piece(first, last, F.col("amount")))).otherwise(several)
    return parts.select("symbol", F.explode(pieces).alias("s")).select("symbol", "s.*")


def runs(parts: DataFrame, per_row: int = 1) -> DataFrame:
    """The profile as a step function: (symbol, lo, hi, volume), `volume` in each bucket from lo to hi; gaps are runs of 0.

    Each stretch adds its amount where it begins and takes it back behind its end; a
    prefix sum gives the steps. Sums are decimals, so what is taken back leaves
    exactly 0. Rows follow the ends of segments, not the range of prices.
    """
    amount = F.col("amount").cast("decimal(38,18)")
    ends = bucketed(parts, per_row).select("symbol", F.inline(F.array(F.struct(F.col("lo").alias("at"), amount.alias("step")), F.struct((F.col("hi") + 1).alias("at"), (-amount).alias("step")))))
    steps = ends.groupBy("symbol", "at").agg(F.sum("step").alias("step")).where("step <> 0")
    order = Window.partitionBy("symbol").orderBy("at")
    levels = steps.select("symbol", F.col("at").alias("lo"), (F.lead("at").over(order) - 1).alias("hi"), F.sum("step").over(order).cast("double").alias("volume"))
    return levels.where("hi is not null")


def runs_of(grid: DataFrame) -> DataFrame:
    """Rows (symbol, bucket, volume) as runs, with runs of 0 for missing buckets."""
    after = F.lead("bucket").over(Window.partitionBy("symbol").orderBy("bucket"))
    run = lambda lo, hi, v: F.struct(lo.alias("lo"), hi.alias("hi"), v.cast("double").alias("volume"))
    gap = F.when(F.col("after") > F.col("bucket") + 1, run(F.col("bucket") + 1, F.col("after") - 1, F.lit(0.0)))
    both = F.array_compact(F.array(run(F.col("bucket"), F.col("bucket"), F.col("volume")), gap))
    return grid.withColumn("after", after).select("symbol", F.inline(both))


def points(steps: DataFrame) -> DataFrame:
    """A row for every bucket of the runs."""
    rest = [c for c in steps.columns if c not in ("symbol", "lo", "hi")]
    return steps.select("symbol", F.explode(F.sequence("lo", "hi")).alias("bucket"), *rest)


def spread(parts: DataFrame, per_row: int = 1) -> DataFrame:
    """(symbol, bucket, volume) of the buckets with volume."""
    return points(runs(parts, per_row).where("volume <> 0"))


def volume_profile(bars: DataFrame, tick: float = TICK, **options) -> DataFrame:
    """Ticks with their volume; ATR over all bars, empty ones included."""
    return spread(segments(atr_wilder(bars, ATR_BARS), tick, **options))


def profile_runs(bars: DataFrame, per_row: int, tick: float = TICK, sigma_ticks: float = SIGMA_TICKS, **options) -> DataFrame:
    """Runs of buckets of `per_row` ticks with raw and smoothed volume; ATR over traded bars only."""
    return smoothed_runs(runs(segments(atr_wilder(bars.where("volume > 0"), ATR_BARS), tick, **options), per_row), sigma_ticks / per_row)


def volume_profile_rows(bars: DataFrame, per_row: int, tick: float = TICK, sigma_ticks: float = SIGMA_TICKS, **options) -> DataFrame:
    """The same with a row for every bucket from the lowest to the highest."""
    return points(profile_runs(bars, per_row, tick, sigma_ticks, **options))


def dense(profile: DataFrame) -> DataFrame:
    """Missing buckets between the lowest and the highest, with volume 0."""
    return points(runs_of(profile))


def kernel(sigma: float) -> list[float]:
    half = max(1, ceil(3 * sigma))
    w = [exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def smoothed_runs(steps: DataFrame, sigma: float) -> DataFrame:
    """Runs with `smoothed`, the volume under a normalised Gaussian; positions beyond the edge read the edge bucket.

    Inside a run nothing changes. A step of d at bucket b changes the buckets that
    see it: t reads the share of the kernel at b - t and above of d, where it
    would have read all of it (t from b on) or nothing. So each step hands
    2 * half corrections out, and rows follow the steps, not the range of prices.
    """
    w = kernel(sigma)
    half = len(w) // 2
    share = [sum(w[j + half :]) - (1.0 if j <= 0 else 0.0) for j in range(1 - half, half + 1)]  # of the step, by j = b - t
    order = Window.partitionBy("symbol").orderBy("lo")
    ends = steps.groupBy("symbol").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    step = steps.select("symbol", "lo", (F.col("volume") - F.lag("volume").over(order)).alias("step")).where("step <> 0")
    seen = F.array(*[F.struct((F.col("lo") - j).alias("at"), (F.col("step") * x).alias("change")) for j, x in zip(range(1 - half, half + 1), share)], F.struct((F.col("lo") + half).alias("at"), F.lit(0.0).alias("change")))
    changes = step.select("symbol", F.inline(seen)).select("symbol", "at", "change", F.lit(None).cast("double").alias("level"))
    levels = steps.select("symbol", F.col("lo").alias("at"), F.lit(0.0).alias("change"), F.col("volume").alias("level"))
    rows = changes.union(levels).groupBy("symbol", "at").agg(F.sum("change").alias("change"), F.max("level").alias("level")).join(ends, "symbol").where("at between first and last")
    by_place = Window.partitionBy("symbol").orderBy("at")
    level = F.last("level", ignorenulls=True).over(by_place)
    return rows.select("symbol", F.col("at").alias("lo"), F.coalesce(F.lead("at").over(by_place) - 1, F.col("last")).alias("hi"), level.alias("volume"), F.greatest(level + F.col("change"), F.lit(0.0)).alias("smoothed"))


def smoothed(grid: DataFrame, sigma: float) -> DataFrame:
    """(symbol, bucket, volume): a dense grid, smoothed."""
    return points(smoothed_runs(runs_of(grid), sigma)).select("symbol", "bucket", F.col("smoothed").alias("volume"))


def _as_runs(profile: DataFrame) -> DataFrame:
    return runs_of(profile) if "bucket" in profile.columns else profile


def point_of_control(profile: DataFrame) -> DataFrame:
    """Bucket of the largest volume; the lowest on ties. Takes runs or a grid."""
    best = _as_runs(profile).groupBy("symbol").agg(F.max_by(F.struct("lo", "volume"), F.struct("volume", -F.col("lo"))).alias("p"))
    return best.select("symbol", F.col("p.lo").alias("poc"), F.col("p.volume").alias("poc_volume"))


def value_area(profile: DataFrame, share: float = 0.7) -> DataFrame:
    """Range around the point of control that holds `share` of the volume, grown to the larger neighbour, low on ties. Takes runs or a grid.

    Growing to the larger neighbour takes the buckets of both sides in the order of
    the least volume from the point of control up to each: a bucket behind a
    smaller one follows it at once. So the area is a prefix of that order, found
    by a running minimum on each side and a running total; a run counts as many
    equal buckets, of which the last one taken may be any. The windows of a symbol
    hold its runs and spill; there is no array of prices.
    """
    steps = stored(_as_runs(profile))  # read three times
    size = F.col("hi") - F.col("lo") + 1
    top = point_of_control(steps).join(steps.groupBy("symbol").agg(F.sum(F.col("volume") * size).alias("total")), "symbol")
    near = steps.join(top, "symbol").where("total > 0")
    low = F.when(F.col("lo") == F.col("poc"), F.col("poc") + 1).otherwise(F.col("lo"))  # the rest of the run that the point of control begins
    sides = near.withColumns({"lo": low, "up": F.col("lo") >= F.col("poc")}).withColumn("n", size)
    outwards = F.when(F.col("up"), F.col("lo")).otherwise(-F.col("hi"))
    least = F.min("volume").over(Window.partitionBy("symbol", "up").orderBy("away"))
    ranked = sides.withColumn("away", outwards).where("n > 0").withColumn("least", least)
    order = Window.partitionBy("symbol").orderBy(F.desc("least"), "up", "away")
    before = F.col("poc_volume") + F.coalesce(F.sum(F.col("volume") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    missing = F.col("total") * share - F.col("before")
    taken = F.when(missing <= 0, 0).when(F.col("volume") > 0, F.least(F.col("n"), F.ceil(missing / F.col("volume")))).otherwise(F.col("n"))
    grown = ranked.withColumn("before", before).withColumn("taken", taken)
    found = grown.groupBy("symbol").agg(F.sum(F.when(~F.col("up"), F.col("taken"))).alias("down"), F.sum(F.when(F.col("up"), F.col("taken"))).alias("rise"))
    return top.where("total > 0").join(found, "symbol", "left").select("symbol", (F.col("poc") - F.coalesce("down", F.lit(0))).alias("value_low"), "poc", (F.col("poc") + F.coalesce("rise", F.lit(0))).alias("value_high"))
