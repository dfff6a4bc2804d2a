"""Queries over predictions, folds, metrics and exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import evaluate as E
from tickloom.operators.order import checkpointed
from tickloom.plans import adapters as A
from tickloom.plans.feature_queries import r6, six
from tickloom.plans.registry import query

OOS = A.ctes("oos")
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _metrics_sql(pred: str) -> str:
    return f"""(SELECT corr(y_true, {pred}) AS ic, corr(yr, pr) AS sp, avg(CASE WHEN y_true <> 0 THEN (sign({pred}) = sign(y_true))::INT END) AS da, coalesce(avg(sign({pred}) * y_true) / nullif(stddev_samp(sign({pred}) * y_true), 0), 0) * sqrt(252 * 26) AS sh, count(*) AS n
FROM (SELECT *, rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2.0::DOUBLE AS yr, rank() OVER (ORDER BY {pred}) + (count(*) OVER (PARTITION BY {pred}) - 1) / 2.0::DOUBLE AS pr FROM oos))"""


@query("agg_metrics", OOS + f" SELECT {r6('ic')} AS ic_pearson, {r6('sp')} AS ic_spearman, {r6('da')} AS directional_acc, {r6('sh')} AS strategy_sharpe_ann, n AS n_obs FROM {_metrics_sql('base_pred')}")
def _(spark, d):
    m = E.metrics(A.predictions(spark, d), p="base_pred")
    return m.select(*six(m, "ic_pearson", "ic_spearman", "directional_acc", "strategy_sharpe_ann"), "n_obs")


@query("ml_delta", OOS + f" SELECT {r6('(g.ic - b.ic)')} AS d_ic_pearson, {r6('(g.sp - b.sp)')} AS d_ic_spearman, {r6('(g.da - b.da)')} AS d_directional_acc, {r6('(g.sh - b.sh)')} AS d_strategy_sharpe_ann FROM {_metrics_sql('base_pred')} b, {_metrics_sql('gex_pred')} g")
def _(spark, d):
    rows = A.predictions(spark, d)
    out = E.delta(E.metrics(rows, p="base_pred"), E.metrics(rows, p="gex_pred"))
    return out.select(*six(out, *out.columns))


@query("win_walk_forward", OOS + """, n AS (SELECT oos_idx, row_number() OVER (ORDER BY oos_idx) - 1 AS row, count(*) OVER () AS n FROM oos), f AS (SELECT n.*, j, n - (5 - j) * 100 AS first FROM n, (SELECT unnest(range(0, 5)) AS j))
SELECT j::INT AS fold, CASE WHEN row < first THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(oos_idx) AS first_idx, max(oos_idx) AS last_idx FROM f WHERE row < first + 100 GROUP BY 1, 2""")
def _(spark, d):
    rows = E.folds(A.predictions(spark, d).select("oos_idx"), ["oos_idx"])
    return rows.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("oos_idx").alias("first_idx"), F.max("oos_idx").alias("last_idx"))


@query("set_union_folds", OOS + """, n AS (SELECT oos_idx, y_true, row_number() OVER (ORDER BY oos_idx) - 1 AS row, count(*) OVER () AS n FROM oos) SELECT oos_idx, y_true, ((row - (n - 500)) // 100)::INT AS fold FROM n WHERE row >= n - 500""")
def _(spark, d):
    return E.folds(A.predictions(spark, d).select("oos_idx", "y_true"), ["oos_idx"]).where("part = 'test'").select("oos_idx", "y_true", "fold")


@query("ml_chrono_split", OOS + " SELECT part, count(*) AS n, max(oos_idx) AS last_idx FROM (SELECT oos_idx, CASE WHEN row_number() OVER (ORDER BY oos_idx) - 1 < floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM oos) GROUP BY part")
def _(spark, d):
    return E.chrono_split(A.predictions(spark, d).select("oos_idx"), ["oos_idx"]).groupBy("part").agg(F.count("*").alias("n"), F.max("oos_idx").alias("last_idx"))


@query("ml_standardize", OOS + f", s AS (SELECT avg(y_true) AS m, stddev_pop(y_true) + 1e-8 AS s FROM oos WHERE oos_idx % 10 < 8) SELECT oos_idx, {r6('((y_true - m) / s)')} AS y_true FROM oos, s")
def _(spark, d):
    rows = E.standardized(A.predictions(spark, d).select("oos_idx", "y_true"), ["y_true"], F.col("oos_idx") % 10 < 8)
    return rows.select("oos_idx", *six(rows, "y_true"))


@query("agg_bootstrap_ic", OOS + f""", n AS (SELECT y_true, base_pred, row_number() OVER (ORDER BY oos_idx) - 1 AS row, count(*) OVER () AS total FROM oos), t AS (SELECT y_true, base_pred, row - total + 500 AS row FROM n WHERE row >= total - 500),
d AS (SELECT s, b, ('0x' || substr(md5('42:' || s || ':' || b), 1, 13))::BIGINT % (500 - 73 + 1) AS start FROM (SELECT unnest(range(0, 1000)) AS s), (SELECT unnest(range(0, 7)) AS b)),
p AS (SELECT s, start + k AS row FROM d, (SELECT unnest(range(0, 73)) AS k) WHERE b * 73 + k < 500), c AS (SELECT s, corr(y_true, base_pred) AS ic FROM p JOIN t ON p.row = t.row GROUP BY s)
SELECT {r6('quantile_cont(ic, 0.025)')} AS ic_lower, {r6('avg(ic)')} AS ic_mean, {r6('quantile_cont(ic, 0.975)')} AS ic_upper FROM c""")
def _(spark, d):
    """Interval of the correlation over the last 500 rows in order, as folds of 100 give them."""
    rows = E.folds(A.predictions(spark, d), ["oos_idx"]).where("part = 'test'").select("oos_idx", "y_true", F.col("base_pred").alias("pred"))
    out = E.bootstrap_ic(rows, ["oos_idx"])
    return out.select(*six(out, *out.columns))


@query("agg_describe", OOS + f""" SELECT count(y_true) AS n, {r6('avg(y_true)')} AS mean, {r6('stddev_samp(y_true)')} AS std, {r6('min(y_true)')} AS min, {r6('quantile_cont(y_true, 0.25)')} AS q25, {r6('quantile_cont(y_true, 0.5)')} AS q50, {r6('quantile_cont(y_true, 0.75)')} AS q75, {r6('max(y_true)')} AS max,
{r6('skewness(y_true)')} AS skew, {r6('kurtosis(y_true)')} AS kurtosis, {r6('avg((y_true > 0)::INT)')} AS share_positive FROM oos""")
def _(spark, d):
    rows = E.describe(A.predictions(spark, d), "y_true")
    return rows.select("n", *six(rows, *rows.columns[1:]))


def _lines(spark, d):
    return A.table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("l_orderkey"), F.col("l_linenumber"))


@query("agg_corr_target", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r6(f'corr({c}::DOUBLE, l_extendedprice::DOUBLE)')} AS r FROM lineitem" for c in FEATURES if c != "l_extendedprice"))
def _(spark, d):
    rows = E.correlations_with(_lines(spark, d), "l_extendedprice", [c for c in FEATURES if c != "l_extendedprice"])
    return rows.select("feature", *six(rows, "r"))


@query("top_corr", "SELECT feature, r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r6(f'corr({c}::DOUBLE, l_extendedprice::DOUBLE)')} AS r FROM lineitem" for c in FEATURES if c != "l_extendedprice") + ") ORDER BY abs(r) DESC LIMIT 2")
def _(spark, d):
    rows = E.correlations_with(_lines(spark, d), "l_extendedprice", [c for c in FEATURES if c != "l_extendedprice"])
    return rows.select("feature", *six(rows, "r")).orderBy(F.abs("r").desc()).limit(2)


RELATED_COLUMNS = [*FEATURES, "net", "taxed", "saved"]
RELATED = [(a, b) for i, a in enumerate(RELATED_COLUMNS) for b in RELATED_COLUMNS[i + 1 :]]


@query("agg_corr_matrix", "WITH related AS (SELECT *, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) AS net, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) * (1 + l_tax::DOUBLE) AS taxed, l_extendedprice::DOUBLE * l_discount::DOUBLE AS saved FROM lineitem) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}::DOUBLE, {b}::DOUBLE)')} AS r FROM related" for a, b in RELATED) + ") WHERE abs(r) > 0.5")
def _(spark, d):
    """Pairs of related columns: the net and the taxed price go with the price, and a discount's amount with both."""
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    rows = _lines(spark, d).withColumns({"net": price * (1 - off), "taxed": price * (1 - off) * (1 + F.col("l_tax")), "saved": price * off})
    rows = E.correlation_pairs(rows, RELATED_COLUMNS, above=0.5)
    return rows.select("a", "b", *six(rows, "r"))


@query("agg_histogram", OOS + ", e AS (SELECT min(y_true) AS a, max(y_true) AS b FROM oos) SELECT least(floor((y_true - a) / nullif(b - a, 0) * 60), 59)::BIGINT AS bin, count(*) AS n FROM oos, e GROUP BY 1")
def _(spark, d):
    return E.histogram(A.predictions(spark, d), "y_true")


@query("agg_binned_mean", OOS + f""", n AS (SELECT *, row_number() OVER (ORDER BY y_true, oos_idx) - 1 AS row, greatest(20, count(*) OVER () // 25) AS size FROM oos) SELECT (row // size)::BIGINT AS bin, {r6('avg(y_true)')} AS mean_x, {r6('avg(base_pred)')} AS mean_y, count(*) AS n FROM n GROUP BY 1""")
def _(spark, d):
    rows = E.binned_means(A.predictions(spark, d), "y_true", "base_pred", ["y_true", "oos_idx"])
    return rows.select("bin", *six(rows, "mean_x", "mean_y"), "n")


@query("agg_slope", OOS + f" SELECT {r6('regr_slope(base_pred, y_true)')} AS slope, {r6('regr_intercept(base_pred, y_true)')} AS intercept FROM oos")
def _(spark, d):
    rows = E.line(A.predictions(spark, d), "y_true", "base_pred")
    return rows.select(*six(rows, "slope", "intercept"))


@query("agg_mean_abs", OOS + f" SELECT 'base_pred' AS feature, {r6('avg(abs(base_pred))')} AS importance FROM oos UNION ALL SELECT 'gex_pred', {r6('avg(abs(gex_pred))')} FROM oos")
def _(spark, d):
    rows = E.mean_abs(A.predictions(spark, d), ["base_pred", "gex_pred"])
    return rows.select("feature", *six(rows, "importance"))


@query("rank_importance", OOS + f" SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS place FROM (SELECT 'base_pred' AS feature, avg(abs(base_pred)) AS importance FROM oos UNION ALL SELECT 'gex_pred', avg(abs(gex_pred)) FROM oos)")
def _(spark, d):
    from pyspark.sql import Window

    rows = E.mean_abs(A.predictions(spark, d), ["base_pred", "gex_pred"])  # one row a feature
    return rows.select("feature", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).cast("long").alias("place"))


def _samples(spark, d):
    return A.predictions(spark, d).withColumns({"x1": F.col("base_pred"), "x2": F.col("gex_pred"), "target_return": F.col("y_true") / 1000})


MODELS = {"base": ["x1"], "gex": ["x1", "x2"]}


@query("ml_rf")
def _(spark, d):
    """Forest on one feature and on two, walk-forward; by model: metrics, interval of the correlation, and each fold's correlation."""
    out = None
    for name, features in MODELS.items():
        rows = checkpointed(E.walk_forward(_samples(spark, d), features, E.random_forest(), ["oos_idx"]))
        by_fold = E.fold_metrics(rows).agg(*[F.max(F.when(F.col("fold") == k, F.col("ic_pearson"))).alias(f"ic_fold_{k}") for k in range(E.FOLDS)])
        one = E.summary(rows, ["row"]).crossJoin(F.broadcast(by_fold)).select(F.lit(name).alias("model"), "*")  # one row
        out = one if out is None else out.unionByName(one)
    return out


@query("ml_walk_forward")
def _(spark, d):
    """Out-of-sample rows of all folds, from a model factory, with per-fold and overall metrics and the bootstrap's interval."""
    return E.evaluated(E.walk_forward(_samples(spark, d), ["x1"], E.random_forest(), ["oos_idx"]), ["row"])


@query("udf_model_factory")
def _(spark, d):
    """A factory of another estimator in the same harness."""
    from pyspark.ml.regression import LinearRegression

    return E.walk_forward(_samples(spark, d), ["x1", "x2"], lambda: LinearRegression(featuresCol="_x"), ["oos_idx"])


def _attributed(spark, d):
    """Held-out rows of the chronological split, attributed by a forest of the rows before them."""
    from pyspark.ml.feature import VectorAssembler

    from tickloom.operators import trees

    parts = E.chrono_split(_samples(spark, d).select("oos_idx", "x1", "x2", "target_return"), ["oos_idx"])
    assembler = VectorAssembler(inputCols=MODELS["gex"], outputCol="_x")
    model = E.random_forest()().setLabelCol("target_return").setPredictionCol("pred").fit(assembler.transform(parts.where("part = 'train'")))
    held_out = model.transform(assembler.transform(parts.where("part = 'test'"))).select("oos_idx", *MODELS["gex"], "pred")
    return trees.attributions(model, held_out, MODELS["gex"])


@query("ml_shap")
def _(spark, d):
    """Exact attributions of every held-out row; base and attributions add up to the prediction."""
    rows = _attributed(spark, d)
    return rows.select("oos_idx", "pred", "base", *[F.get("shap", F.lit(k)).alias(f"shap_{f}") for k, f in enumerate(MODELS["gex"])])


@query("shap_importance")
def _(spark, d):
    """Features by mean absolute attribution."""
    from pyspark.sql import Window

    from tickloom.operators import trees

    rows = trees.importance(_attributed(spark, d), MODELS["gex"])  # one row a feature
    return rows.select("feature", X.rounded("importance", 9).alias("importance"), F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).cast("long").alias("place"))


@query("ml_permutation_importance")
def _(spark, d):
    """Rise of the error on held-out rows when one feature is dealt out anew."""
    from pyspark.ml.feature import VectorAssembler

    parts = E.chrono_split(_samples(spark, d).select("oos_idx", "x1", "x2", "target_return"), ["oos_idx"])
    train = VectorAssembler(inputCols=MODELS["gex"], outputCol="_x").transform(parts.where("part = 'train'"))
    model = E.random_forest()().setLabelCol("target_return").setPredictionCol("pred").fit(train)
    rows = E.permutation_importance(model, parts.where("part = 'test'").drop("row", "part"), MODELS["gex"], "target_return")
    return rows.select("feature", X.rounded("importance", 6).alias("importance"))
