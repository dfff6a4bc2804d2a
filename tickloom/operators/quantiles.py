"""Exact quantiles by distributed selection.

The wanted order statistics are closed in on. A pass counts the values of the
current interval of each group by bin, with the least and greatest value of each
bin (partial counts a task, so at most `BINS` rows a group and task are shuffled),
and the bin that holds the wanted rank becomes the next interval. Bins are a
monotone function of the value, so rounding can't misplace one. An interval of
few values is gathered, one of a single value is the answer: no task ever holds
a column. A pass narrows an interval a thousandfold, or to what its outliers leave. Intervals are a row for each group and rank; the planner sends them to
the tasks if their stored size allows, else it joins by group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import stored

BINS, FEW = 1024, 2048


def order_statistics(values: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys, x) and (keys, rank, lo, hi, n), with the ends and the count of each group: keys, rank, value. Ranks count from 0."""
    of = {k: f"_{k}" for k in keys}
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(o)) for k, o in of.items()])
    ends = (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))

    def inside(state: DataFrame) -> DataFrame:
        """The values in the state's intervals, each once, beside _keys, _lo and _hi."""
        spans = state.select(*[F.col(k).alias(o) for k, o in of.items()], F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).distinct()
        return values.join(spans, same & F.col("x").between(F.col("_lo"), F.col("_hi")))

    state, found = stored(ranks.withColumn("at", F.col("rank"))), []  # `at`: the rank within the interval
    while True:
        found.append(state.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        few, many = (state.where(f"lo < hi and n {sign} {FEW}") for sign in ("<=", ">"))
        if not few.isEmpty():
            gathered = inside(few).groupBy(*of.values(), "_lo", "_hi").agg(F.array_sort(F.collect_list("x")).alias("sorted"))
            found.append(few.join(gathered, same & ends).select(*keys, "rank", F.get("sorted", F.col("at").cast("int")).alias("value")))
        if many.isEmpty():
            return reduce(DataFrame.union, found)
        x, lo, hi = F.col("x"), F.col("_lo"), F.col("_hi")
        share = F.when(hi - lo < float("inf"), (x - lo) / (hi - lo)).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
        place = F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")
        counts = inside(many).groupBy(*of.values(), "_lo", "_hi", place).agg(F.count("*").alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        order = Window.partitionBy(*of.values(), "_lo", "_hi").orderBy("bin")  # a row a bin
        counts = counts.withColumn("before", F.sum("m").over(order) - F.col("m"))
        hit = (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("m"))
        state = stored(many.join(counts, same & ends & hit).select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("m").alias("n"), (F.col("at") - F.col("before")).alias("at")))


def quantiles(rows: DataFrame, column: str, shares: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """Per group (one row without groups), a column for each named share: the quantile, linear between neighbours.

    Null values and those that aren't finite don't count; a group without others gives nulls.
    """
    named = groups or []
    keys = [f"g{k}" for k in range(len(named))] or ["g"]
    x = F.col(column).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    values = rows.select(*([F.col(g).alias(k) for g, k in zip(named, keys)] or [F.lit(0).alias("g")]), F.when(finite, x).alias("x"))
    ends = stored(values.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")))
    spots = {name: (F.col("n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    both = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(s), F.ceil(s)) for s in spots.values()])))
    found = order_statistics(values.where("x is not null"), ends.where("n > 0").select(*keys, F.explode(both).alias("rank"), "lo", "hi", "n"), keys)
    listed = found.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("v"))  # two entries a share at most
    out = ends.join(listed, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left")
    at = lambda rank: F.try_element_at("v", rank)
    done = out.select(*[F.col(k).alias(g) for g, k in zip(named, keys)], *[(at(F.floor(s)) + (at(F.ceil(s)) - at(F.floor(s))) * (s - F.floor(s))).alias(name) for name, s in spots.items()])
    if named:
        return done
    nothing = rows.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in shares])
    return nothing if ends.isEmpty() else done
