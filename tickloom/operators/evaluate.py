"""Walk-forward evaluation, prediction metrics, bootstrap intervals, and exploratory statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, isfinite, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.forest import Forest
from tickloom.operators.order import average_ranks, checkpointed, numbered
from tickloom.operators.quantiles import quantiles
from tickloom.session import stored
from tickloom.schemas import BOOTSTRAP_BLOCK, BOOTSTRAP_SAMPLES, PERIODS_PER_YEAR

FOLDS, TEST_ROWS = 5, 100


def folds(rows: DataFrame, order: list[str], n_folds: int = FOLDS, test_rows: int = TEST_ROWS) -> DataFrame:
    """Rows with `row`, `fold` and `part`: in fold j the last-but-(n_folds - j) stretch is test, all rows before it train."""
    rows = numbered(rows, order)
    total = rows.agg(F.count("*").alias("_n"))
    first = F.col("_n") - (n_folds - F.col("fold")) * test_rows
    each = rows.crossJoin(F.broadcast(total)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return each.where((F.col("row") < first + test_rows) & (first > 0)).withColumn("part", F.when(F.col("row") < first, "train").otherwise("test")).drop("_n")


def metric_columns(y: str, p: str, periods: int = PERIODS_PER_YEAR) -> list[Column]:
    """Aggregates over rows with ranks <y>_rank and <p>_rank."""
    hit = F.when(F.col(y) != 0, (F.signum(p) == F.signum(y)).cast("double"))
    ret = F.signum(p) * F.col(y)
    sharpe = F.coalesce(F.avg(ret) / F.nullif(F.stddev_samp(ret), F.lit(0.0)), F.lit(0.0)) * sqrt(periods)
    return [F.corr(y, p).alias("ic_pearson"), F.corr(f"{y}_rank", f"{p}_rank").alias("ic_spearman"), F.avg(hit).alias("directional_acc"), sharpe.alias("strategy_sharpe_ann"), F.count("*").alias("n_obs")]


def metrics(rows: DataFrame, y: str = "y_true", p: str = "pred") -> DataFrame:
    return average_ranks(rows, [y, p]).agg(*metric_columns(y, p))


def delta(base: DataFrame, other: DataFrame) -> DataFrame:
    """Metrics of `other` less those of `base`; both one row."""
    names = ("ic_pearson", "ic_spearman", "directional_acc", "strategy_sharpe_ann")
    a, b = (df.select(*[F.col(c).alias(f"{c}{s}") for c in names]) for df, s in ((base, "_a"), (other, "_b")))
    return a.crossJoin(F.broadcast(b)).select(*[(F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"d_{c}") for c in names])


def bootstrap_ic(rows: DataFrame, order: list[str], y: str = "y_true", p: str = "pred", samples: int = BOOTSTRAP_SAMPLES, block: int = BOOTSTRAP_BLOCK, seed: int = 42) -> DataFrame:
    """Moving-block bootstrap of the correlation: lower (2.5 %), mean, upper (97.5 %). For out-of-sample tables (folds x test rows).

    The start of a sample's block is counter-based: the first 52 bits of md5("seed:sample:block") modulo the number of starts, so any engine draws the same.
    """
    indexed = checkpointed(numbered(rows.select(*order, y, p), order).select("row", y, p))
    n = indexed.count()
    if n < block:
        raise ValueError(f"{n} rows are fewer than a block of {block}")
    draws = rows.sparkSession.range(samples).select(F.col("id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(ceil(n / block) - 1))).alias("block"))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "sample", "block").cast("binary")), 1, 13), 16, 10).cast("long")
    picks = draws.select("sample", (F.col("block") * block).alias("at"), (bits % (n - block + 1)).alias("start"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k")).where(F.col("at") + F.col("k") < n)
    per = picks.select("sample", (F.col("start") + F.col("k")).alias("row")).join(indexed, "row").groupBy("sample").agg(F.corr(y, p).alias("ic"))
    return per.agg(F.percentile("ic", F.lit(0.025)).alias("ic_lower"), F.avg("ic").alias("ic_mean"), F.percentile("ic", F.lit(0.975)).alias("ic_upper"))  # a row a sample


def describe(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, quartiles, bias-corrected skewness and excess kurtosis, share above 0."""
    n, x = F.count(column).cast("double"), F.col(column)
    skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    shares = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    plain = rows.agg(F.count(column).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), skew.alias("skew"), kurt.alias("kurtosis"), F.avg((x > 0).cast("double")).alias("share_positive"))
    one = plain.crossJoin(F.broadcast(quantiles(rows, column, shares)))  # a row each
    return one.select("n", "mean", "std", "min", *shares, "max", "skew", "kurtosis", "share_positive")


def _long(one_row: DataFrame, names: list[str], key: str, value: str) -> DataFrame:
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])).alias("x")).select(f"x.{key}", f"x.{value}")


def correlations_with(rows: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, r): all in one aggregation."""
    return _long(rows.agg(*[F.corr(f, target).alias(f) for f in features]), features, "feature", "r")


def _pair_sums(features: list[str], shifts: list[float]):
    """One row a task and pair of columns: over rows where both have a value, their number, and sums of the shifted values, their squares and products."""
    d = len(features)
    pairs = list(combinations(range(d), 2))
    left, right = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(pairs)))
        for batch in batches:
            columns = [batch.column(f) for f in features]
            valid = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64)
            x = np.column_stack([c.fill_null(s).to_numpy(zero_copy_only=False) - s for c, s in zip(columns, shifts)])  # a null adds 0
            odd = ~np.isfinite(x).all(1)
            for rows, each in ((~odd, False), (odd, True)):  # infinities and NaN count only for the pairs that they are in
                v, z = valid[rows], x[rows]
                if each:
                    for k, (i, j) in enumerate(pairs):
                        both = (v[:, i] > 0) & (v[:, j] > 0)
                        a, b = z[both, i], z[both, j]
                        with np.errstate(all="ignore"):
                            total[:, k] += [len(a), a.sum(), b.sum(), a @ a, b @ b, a @ b]
                else:
                    sums, squares = z.T @ v, (z * z).T @ v  # of column i where column j has a value
                    total += [m[i, j] for m, i, j in ((v.T @ v, left, right), (sums, left, right), (sums, right, left), (squares, left, right), (squares, right, left), (z.T @ z, left, right))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), *map(pa.array, total)], names=["k", "n", "sa", "sb", "qa", "qb", "p"])

    return run


def correlation_pairs(rows: DataFrame, features: list[str], above: float = 0.0) -> DataFrame:
    """(a, b, r) over the upper triangle, |r| > above; pairs of columns, not of rows.

    Tasks sum products of values less their column's mean, so that nothing large cancels; a row a task and pair is merged. None where a column doesn't vary (by less than a millionth of its distance from that mean).
    """
    pairs = list(combinations(features, 2))
    numbers = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    usual = numbers.agg(*[F.avg(F.when(~F.isnan(f) & (F.abs(f) < float("inf")), F.col(f))).alias(f) for f in features]).first()
    shifts = [x if x is not None and isfinite(x) else 0.0 for x in usual]
    sums = numbers.mapInArrow(_pair_sums(features, shifts), "k long, n double, sa double, sb double, qa double, qb double, p double")
    merged = sums.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")]).where("n > 0")

    def deviation(s: str, q: str) -> Column:
        spread = F.col(q) - F.col(s) * F.col(s) / F.col("n")
        return F.when(spread > F.col(q) * 1e-12, F.sqrt(spread)).when(F.isnan(spread), spread)

    r = (F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / (deviation("sa", "qa") * deviation("sb", "qb"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return merged.select(F.get(names, F.col("k").cast("int")).alias("x"), r.alias("r")).select("x.a", "x.b", "r").where(F.abs("r") > above)


def histogram(rows: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """(bin, n): equal widths between the smallest and the largest value, which falls into the last bin."""
    ends = rows.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    k = F.floor((F.col(column) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0)) * bins)
    return rows.crossJoin(F.broadcast(ends)).select(F.least(F.coalesce(k, F.lit(0)), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def binned_means(rows: DataFrame, x: str, y: str, order: list[str]) -> DataFrame:
    """Means of consecutive bins of max(20, n / 25) rows by x."""
    ranked = numbered(rows.select(x, y, *[c for c in order if c not in (x, y)]), order)
    size = rows.agg(F.greatest(F.lit(20), F.floor(F.count("*") / 25)).alias("_size"))
    return ranked.crossJoin(F.broadcast(size)).groupBy(F.floor(F.col("row") / F.col("_size")).alias("bin")).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count("*").alias("n"))


def line(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def mean_abs(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): mean absolute value."""
    return _long(rows.agg(*[F.avg(F.abs(f)).alias(f) for f in features]), features, "feature", "importance")


def chrono_split(rows: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """Adds `part`: the first share of the rows is train, the rest test."""
    total = rows.agg(F.count("*").alias("_n"))
    return numbered(rows, order).crossJoin(F.broadcast(total)).withColumn("part", F.when(F.col("row") < F.floor(F.col("_n") * share), "train").otherwise("test")).drop("_n")


def standardized(rows: DataFrame, features: list[str], train: Column) -> DataFrame:
    """Features as z-scores by the mean and population deviation (plus 1e-8) of the train rows."""
    stats = rows.where(train).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[(F.stddev_pop(f) + 1e-8).alias(f"_s_{f}") for f in features])
    z = {f: (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}") for f in features}
    return rows.crossJoin(F.broadcast(stats)).withColumns(z).drop(*[f"_{k}_{f}" for k in "ms" for f in features])


Model = Callable[[], object]


def random_forest(trees: int = 500, depth: int = 30, seed: int = 42) -> Model:
    """Factory of the forest: leaves of at least 10 draws, square root of the features a split. Depth has no limit but Spark's own, 30, which few leaves of 10 reach."""
    return lambda: Forest(trees, depth, 10, seed)


def walk_forward(rows: DataFrame, features: list[str], factory: Model, order: list[str], target: str = "target_return", n_folds: int = FOLDS, test_rows: int = TEST_ROWS) -> DataFrame:
    """Out-of-sample predictions (fold, row, order columns, y_true, pred): a fresh estimator of the factory is fitted on each fold's train rows."""
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.dropna(subset=[*features, target]))
    placed = stored(numbered(vectors.select(*order, "_x", F.col(target).alias("y_true")), order))  # in even parts, which each fit reads
    first = placed.count() - n_folds * test_rows
    held_out = checkpointed(placed.where(F.col("row") >= first))  # n_folds * test_rows at most
    starts = [first + k * test_rows for k in range(n_folds)]
    fresh = [factory().setLabelCol("y_true").setPredictionCol("pred") for _ in starts]
    if isinstance(fresh[0], Forest):  # all folds from one pass
        models = fresh[0].fit_before(placed, starts)
    else:
        models = [f.fit(placed.where(F.col("row") < start)) for f, start in zip(fresh, starts)]
    out = None
    for k, (model, start) in enumerate(zip(models, starts)):
        test = held_out.where((F.col("row") >= start) & (F.col("row") < start + test_rows)).withColumn("fold", F.lit(k))
        one = model.transform(test).select("fold", "row", *order, "y_true", "pred")
        out = one if out is None else out.unionByName(one)
    return out


def fold_metrics(oos: DataFrame, y: str = "y_true", p: str = "pred") -> DataFrame:
    """(fold, metrics): of each fold's test rows by themselves, ranks too."""
    rank = lambda c: F.rank().over(Window.partitionBy("fold").orderBy(c)) + (F.count("*").over(Window.partitionBy("fold", c)) - 1) / 2.0
    return oos.withColumns({f"{c}_rank": rank(c) for c in (y, p)}).groupBy("fold").agg(*metric_columns(y, p))


def summary(oos: DataFrame, order: list[str]) -> DataFrame:
    """One row: metrics over all folds, and the block bootstrap's interval of the correlation (`ic_lower`, `ic_mean`, `ic_upper`)."""
    return metrics(oos).crossJoin(F.broadcast(bootstrap_ic(oos, order)))


def evaluated(oos: DataFrame, order: list[str]) -> DataFrame:
    """Out-of-sample rows, each with the metrics of its fold (`fold_...`) and the summary of all folds."""
    oos = checkpointed(oos)
    by_fold = fold_metrics(oos)
    by_fold = by_fold.select("fold", *[F.col(c).alias(f"fold_{c}") for c in by_fold.columns if c != "fold"])
    return oos.join(F.broadcast(by_fold), "fold").crossJoin(F.broadcast(summary(oos, order)))  # a row a fold, and one


def permutation_importance(model, rows: DataFrame, features: list[str], target: str, seed: int = 42) -> DataFrame:
    """(feature, importance): rise of the mean squared error when one feature's values are dealt out anew.

    Another quantity than attributions (see :mod:`tickloom.operators.trees`). Values are dealt by joining row numbers of two orders.
    """
    spark = rows.sparkSession
    base = numbered(rows.withColumn("_key", F.xxhash64(*features, target)), ["_key"]).drop("_key")
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    error = lambda df: model.transform(assembler.transform(df)).agg(F.avg(F.pow(F.col(target) - F.col("pred"), 2))).first()[0]
    plain, found = error(base), []
    for k, f in enumerate(features):
        dealt = numbered(base.select(F.col(f).alias("_v"), F.xxhash64("row", F.lit(seed + k)).alias("_h"), F.col("row").alias("_old")), ["_h", "_old"]).select("row", "_v")
        found.append((f, float(error(base.join(dealt, "row").withColumn(f, F.col("_v"))) - plain)))
    return spark.createDataFrame(found, "feature string, importance double")
