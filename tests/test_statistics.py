"""Tree attributions, quantiles, sparse profiles and the bootstrap, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tickloom.operators import evaluate as E
from tickloom.operators import profile as P
from tickloom.operators import quantiles as Q
from tickloom.operators import trees


def mean_over(n, at, row, known):
    """The prediction of a tree where only the features in `known` are; the others follow the training rows."""
    f = n.feature[at]
    if f < 0:
        return n.value[at]
    left, right = n.left[at], n.right[at]
    if f in known:
        return mean_over(n, left if row[f] <= n.threshold[at] else right, row, known)
    return (n.rows[left] * mean_over(n, left, row, known) + n.rows[right] * mean_over(n, right, row, known)) / n.rows[at]


def shapley(n, row, d):
    roots = np.searchsorted(n.tree, np.arange(n.n_trees))
    worth = {s: sum(mean_over(n, t, row, s) for t in roots) / n.n_trees for k in range(d + 1) for s in map(frozenset, itertools.combinations(range(d), k))}
    out = []
    for i in range(d):
        rest = [s for s in worth if i not in s]
        out.append(sum(math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (worth[s | {i}] - worth[s]) for s in rest))
    return worth[frozenset()], out


@pytest.fixture(scope="module")
def forest(spark):
    names = ["a", "b", "c", "d"]
    rows = spark.range(400).select("id", *[((F.col("id") * k) % 101 / 10.0).alias(c) for c, k in zip(names, (7, 13, 29, 57))])
    rows = rows.withColumn("y", F.col("a") * F.col("b") + F.when(F.col("c") > 5, 10.0).otherwise(F.col("d")))
    assembler = VectorAssembler(inputCols=names, outputCol="_x")
    model = RandomForestRegressor(featuresCol="_x", labelCol="y", predictionCol="pred", numTrees=7, maxDepth=6, minInstancesPerNode=3, seed=5).fit(assembler.transform(rows))
    return model, model.transform(assembler.transform(rows)).select("id", *names, "pred"), names


def test_attributions_against_all_subsets(forest, monkeypatch):
    model, rows, names = forest
    monkeypatch.setattr(trees, "BLOCK", 5000)
    monkeypatch.setattr(trees, "NODES", 200)  # several blocks of trees and of rows
    n = trees.nodes(model)
    got = trees.attributions(model, rows, names).orderBy("id").collect()
    assert len(got) == 400
    for r in got:
        assert r.base + sum(r.shap) == pytest.approx(r.pred, abs=1e-9)
    for r in got[::57]:
        base, want = shapley(n, [r[c] for c in names], 4)
        assert r.base == pytest.approx(base, abs=1e-9) and r.shap == pytest.approx(want, abs=1e-9)


def test_attributions_of_hard_rows(spark, forest):
    model, _, names = forest
    rows = spark.createDataFrame([(1.0, None, 2.0, 3.0), (float("nan"), float("inf"), float("-inf"), 3.0), (1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 3.0, 4.0)], ", ".join(f"{c} double" for c in names))
    got = trees.attributions(model, rows, names).collect()
    assert sum(r.shap is None for r in got) == 1 and len(got) == 4
    n = trees.nodes(model)
    for r in got:
        if r.shap is not None:
            x = [math.inf if math.isnan(r[c]) else r[c] for c in names]
            assert r.shap == pytest.approx(shapley(n, x, 4)[1], abs=1e-9)
    found = {r.feature: r.importance for r in trees.importance(trees.attributions(model, rows, names), names).collect()}
    assert set(found) == set(names) and trees.attributions(model, rows.where("false"), names).count() == 0


@pytest.mark.parametrize("few", [100, 2048])
def test_quantiles_against_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", 256)
    r = random.Random(1)
    groups = {
        "ties": [r.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(300)], "one": [4.25], "same": [3.0] * 50, "spread": [r.gauss(0, 1) * 10 ** r.randrange(-3, 9) for _ in range(500)],
        "outlier": [r.random() for _ in range(200)] + [1e300, -1e308], None: [1.0, 2.0], "neighbours": [1.0, math.nextafter(1.0, 2)] * 20,
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("ties", None), ("ties", float("nan")), ("ties", float("inf")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"low": 0.025, "q25": 0.25, "mid": 0.5, "top": 1.0}
    got = {x.g: x for x in Q.quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == {*groups, "empty"} and got["empty"].mid is None
    for g, xs in groups.items():
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, share), rel=1e-12, abs=1e-300), (g, name)
    whole = [x for xs in groups.values() for x in xs]
    assert Q.quantiles(df, "x", {"mid": 0.5}).first().mid == pytest.approx(np.quantile(whole, 0.5))
    none = Q.quantiles(df.where("false"), "x", shares).collect()
    assert len(none) == 1 and none[0].mid is None and Q.quantiles(df.where("false"), "x", shares, ["g"]).count() == 0


def test_rows_between_the_same_thresholds_are_attributed_once(forest, monkeypatch):
    model, _, _ = forest
    n = trees.nodes(model)
    r = np.random.default_rng(3)
    x = np.repeat(r.uniform(-1, 11, (40, 4)), 50, axis=0)
    x[:200, 0] = r.choice(n.threshold[n.feature == 0], 200)  # a threshold belongs to the side below it
    want = sum(trees.leaf_attributions(x, *trees.boxes(n, 4, t)) for t in trees.blocks_of_trees(n))
    asked, plain = [], trees.leaf_attributions
    monkeypatch.setattr(trees, "leaf_attributions", lambda rows, *a: asked.append(len(rows)) or plain(rows, *a))
    done = {}
    assert trees.cell_attributions(n, x, done) == pytest.approx(want, abs=1e-12)
    assert sum(asked) == len(done) < 300
    assert trees.cell_attributions(n, x[::-1], done) == pytest.approx(want[::-1], abs=1e-12) and sum(asked) == len(done)
    monkeypatch.setattr(trees, "CELLS", 10)  # more cells than are remembered
    assert trees.cell_attributions(n, x, done) == pytest.approx(want, abs=1e-12)
    assert trees.cell_attributions(n, x[:0], done).shape == (0, 4)


def test_walk_forward_trains_on_the_rows_before(spark):
    """Each fold's fit gets the rows before its test stretch, in parts of one shuffle."""
    from pyspark.ml.regression import LinearRegression

    fitted = []

    class Watched(LinearRegression):
        def fit(self, rows, params=None):
            fitted.append((rows.count(), rows.agg(F.max("id")).first()[0], plan_of(rows).count("Generate")))
            return super().fit(rows, params)

    rows = spark.range(300).select("id", F.sin("id").alias("x"), (F.col("id") * 2.0).alias("target_return")).repartition(7)
    out = E.walk_forward(rows, ["x"], lambda: Watched(featuresCol="_x"), ["id"], n_folds=3, test_rows=20)
    assert fitted == [(240, 239, 0), (260, 259, 0), (280, 279, 0)]
    got = sorted((r.fold, r.row, r.id, r.y_true) for r in out.collect())
    assert got == [((i - 240) // 20, i, i, i * 2.0) for i in range(240, 300)]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_numbers_without_a_second_shuffle(spark):
    from tickloom.operators.order import numbered

    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(9)
    got = numbered(rows, ["v"])
    assert [(r.v, r.row) for r in got.orderBy("v").collect()] == [(i, i) for i in range(5000)]
    assert "Window" not in plan_of(got) and "hashpartitioning(_part" not in plan_of(got)
    assert numbered(rows.where("false"), ["v"]).count() == 0


def test_correlations_of_pairs_against_numpy(spark):
    r, inf = np.random.default_rng(5), float("inf")
    a = r.normal(1e9, 1, 400)
    table = np.column_stack([a, a * 2 + r.normal(0, 1, 400), -a + 3, r.normal(0, 1, 400), np.full(400, 0.1)])
    data = [[None if (i * 7 + k * 3) % 11 == 0 else float(v) for k, v in enumerate(row)] + [float(i) if i < 200 else None, None if i < 200 else 1.0, inf if i == 5 else float(i)] for i, row in enumerate(table)]
    names = list("abcdefgh")
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(x.a, x.b): x.r for x in E.correlation_pairs(df, names).collect()}
    want = {}
    for i, j in itertools.combinations(range(7), 2):
        both = [(x[i], x[j]) for x in data if x[i] is not None and x[j] is not None]
        if both and np.std([x for x, _ in both]) > 1e-9 and np.std([y for _, y in both]) > 1e-9:
            want[names[i], names[j]] = np.corrcoef(np.array(both).T)[0, 1]
    assert {k for k in got if k[1] != "h"} == set(want) and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())
    assert {k[0]: math.isnan(v) for k, v in got.items() if k[1] == "h"} == {"a": True, "b": True, "c": True, "d": False, "f": True}  # d is null where h is infinite
    assert {(x.a, x.b) for x in E.correlation_pairs(df, names[:4], above=0.5).collect()} == {k for k, v in want.items() if abs(v) > 0.5 and k[1] < "e"}
    assert plan_of(E.correlation_pairs(df, names)).count("corr(") == 0  # no aggregate for each pair


def test_describe_of_a_column(spark):
    one = E.describe(spark.range(101).select(F.col("id").cast("double").alias("x")), "x").first()
    assert (one.n, one["mean"], one.q25, one.q50, one.q75, one["max"]) == (101, 50.0, 25.0, 50.0, 75.0, 100.0)


def grid_area(volumes, share=0.7):
    """Grown step by step."""
    target, poc = sum(volumes) * share, max(range(len(volumes)), key=lambda i: (volumes[i], -i))
    lo = hi = poc
    total = volumes[poc]
    while total < target and (lo > 0 or hi < len(volumes) - 1):
        down, up = volumes[lo - 1] if lo > 0 else -1, volumes[hi + 1] if hi < len(volumes) - 1 else -1
        if down >= up and lo > 0:
            lo, total = lo - 1, total + down
        else:
            hi, total = hi + 1, total + up
    return lo, poc, hi


def test_value_area_against_growing(spark):
    r = random.Random(4)
    grids = {f"g{k}": [float(r.choice([0, 0, 1, 1, 2, 3, 5, 8])) for _ in range(r.randrange(1, 40))] for k in range(60)}
    grids["flat"], grids["single"] = [2.0] * 9, [3.0]
    grids = {k: v for k, v in grids.items() if sum(v)}
    df = spark.createDataFrame([(s, k + 100, v) for s, vs in grids.items() for k, v in enumerate(vs)], "symbol string, bucket long, volume double").repartition(4)
    want = {s: tuple(x + 100 for x in grid_area(v)) for s, v in grids.items()}
    assert {x.symbol: (x.value_low, x.poc, x.value_high) for x in P.value_area(df).collect()} == want
    merged = df.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("bucket", "volume"))).alias("v"))  # runs of equal buckets
    runs = spark.createDataFrame([(x.symbol, g[0].bucket, g[-1].bucket, v) for x in merged.collect() for v, g in ((v, list(g)) for v, g in itertools.groupby(x.v, key=lambda y: y.volume))], "symbol string, lo long, hi long, volume double")
    assert {x.symbol: (x.value_low, x.poc, x.value_high) for x in P.value_area(runs).collect()} == want


def smooth(volumes, sigma):
    w = P.kernel(sigma)
    half = len(w) // 2
    return [sum(w[k + half] * volumes[min(max(t + k, 0), len(volumes) - 1)] for k in range(-half, half + 1)) for t in range(len(volumes))]


def test_smoothing_against_a_convolution(spark):
    r = random.Random(6)
    grids = {f"g{k}": [float(r.choice([0, 0, 0, 4, 4, 9])) for _ in range(r.randrange(1, 60))] for k in range(20)}
    df = spark.createDataFrame([(s, k - 7, v) for s, vs in grids.items() for k, v in enumerate(vs)], "symbol string, bucket long, volume double")
    for sigma in (0.375, 1.5, 3.0):
        got = {(x.symbol, x.bucket): x.volume for x in P.smoothed(df, sigma).collect()}
        assert got == {(s, k - 7): pytest.approx(v, abs=1e-12) for s, vs in grids.items() for k, v in enumerate(smooth(vs, sigma))}


def test_runs_hold_the_segments(spark):
    r = random.Random(8)
    parts = [("A", lo, lo + r.randrange(0, 30), r.random() * 100) for lo in (r.randrange(-50, 50) for _ in range(80))]
    for per_row in (1, 4, 7):
        want = {}
        for _, lo, hi, amount in parts:
            for t in range(lo, hi + 1):
                want[t // per_row] = want.get(t // per_row, 0.0) + amount / (hi - lo + 1)
        got = {x.bucket: x.volume for x in P.spread(spark.createDataFrame(parts, "symbol string, lo long, hi long, amount double"), per_row).collect()}
        assert got == pytest.approx(want)


def test_one_bad_price_adds_a_run(spark):
    """A bar at 1e9 and one that reaches from 10 to 1e9: billions of ticks, a few runs."""
    from .test_operators import bars

    rows = [("A", f"2024-01-01 00:{k:02d}:00", 10.0 + k % 3, 11.0 + k % 3, 9.0, 10.0 + k % 2, 100) for k in range(40)]
    rows += [("A", "2024-01-01 01:00:00", 1e9, 1e9, 1e9, 1e9, 5), ("A", "2024-01-01 01:05:00", 10.0, 1e9, 10.0, 10.0, 3)]
    steps = P.runs(P.segments(P.atr_wilder(bars(spark, rows)), 0.01), 4)
    assert steps.count() < 60
    total = steps.agg(F.sum(F.col("volume") * (F.col("hi") - F.col("lo") + 1)).alias("v")).first().v
    assert total == pytest.approx(4008, rel=1e-6)
    area = P.value_area(steps).first()
    assert 200 < area.value_low <= area.poc <= area.value_high < 400
    assert P.point_of_control(steps).first().poc == area.poc
    assert P.profile_runs(bars(spark, rows), 4, 0.01).count() < 3000


def test_bootstrap_draws_by_counter(spark):
    rows = spark.range(200).select("id", F.sin("id").alias("y_true"), (F.sin("id") + F.cos(F.col("id") * 3)).alias("pred"))
    a, b = (E.bootstrap_ic(rows.repartition(k), ["id"], samples=50).first() for k in (1, 5))
    assert [round(x, 9) for x in a] == [round(x, 9) for x in b] and a.ic_lower < a.ic_mean < a.ic_upper
    with pytest.raises(ValueError):
        E.bootstrap_ic(rows.limit(20), ["id"])


def by_brute_force(cells, n, s, depth, leaf):
    """Value of each cell in one tree on one feature, split by trying every place."""
    out = {}

    def down(part, level):
        whole = sum(s[c] for c in part) / sum(n[c] for c in part)
        gains = [(sum(n[c] for c in half) and sum(s[c] for c in half) ** 2 / sum(n[c] for c in half)) for k in range(1, len(part)) for half in (part[:k], part[k:])]
        fits = [k for k in range(1, len(part)) if min(sum(n[c] for c in half) for half in (part[:k], part[k:])) >= leaf]
        best = max(fits, key=lambda k: (gains[2 * k - 2] + gains[2 * k - 1], -k), default=None)
        if best is None or level == depth or gains[2 * best - 2] + gains[2 * best - 1] - whole**2 * sum(n[c] for c in part) < 1e-9:
            return out.update(dict.fromkeys(part, whole))
        down(part[:best], level + 1), down(part[best:], level + 1)

    down(list(cells), 0)
    return [out[c] for c in cells]


def test_trees_grow_as_by_brute_force():
    from tickloom.operators import forest as R

    r = np.random.default_rng(3)
    n = r.integers(0, 9, (6, R.BINS)).astype(float)
    s = np.round(n * r.normal(0, 5, (6, R.BINS)), 2)
    for depth, leaf in ((30, 10), (2, 1), (0, 1)):
        nodes, values = R.grow(n, s, 20, 1, depth, leaf, 7)
        assert values == pytest.approx(np.array([by_brute_force(range(R.BINS), n[k], s[k], depth, leaf) for k in range(6)]), abs=1e-9)
        assert set(nodes["tree"]) == set(range(20, 26)) and nodes["rows"].min() >= leaf
    one, two = R.grow(n, s, 20, 1, 30, 10, 7)[1], R.grow(n[3:], s[3:], 23, 1, 30, 10, 7)[1]
    assert (one[3:] == two).all()  # whatever trees are grown beside it
    drawn = R.draws(np.arange(4000), 50, 42)
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02 and abs(np.corrcoef(drawn.T)[0, 1]) < 0.06
    assert (R.draws(np.arange(4000)[::-1], 50, 42)[::-1] == drawn).all() and (R.draws(np.arange(4000), 50, 43) != drawn).any()


def test_forest_of_two_features(spark):
    """As near to the truth as Spark's own, the same whatever the partitions, and attributed exactly."""
    assembler = VectorAssembler(inputCols=["a", "b"], outputCol="_x")
    rows = spark.range(3000).select(F.col("id").alias("row"), (F.col("id") * 7919 % 3001 / 3001).alias("a"), (F.col("id") * 104729 % 2999 / 2999).alias("b"))
    rows = assembler.transform(rows.withColumn("y", F.when(F.col("a") > 0.5, F.col("b") * 4).otherwise(F.sin(F.col("a") * 9)) + F.pmod(F.col("row") * 31, F.lit(17)) / 50))
    ours = E.random_forest(trees=40)().setLabelCol("y").setPredictionCol("pred")
    models = [ours.fit(rows.repartition(k)) for k in (1, 7)]
    assert (models[0].values == models[1].values).all() and models[0].values.shape == (1024,)
    error = lambda m: m.transform(rows).agg(F.avg(F.pow(F.col("y") - F.col("pred"), 2))).first()[0]
    theirs = RandomForestRegressor(featuresCol="_x", labelCol="y", predictionCol="pred", numTrees=40, minInstancesPerNode=10, featureSubsetStrategy="sqrt", maxDepth=12, seed=5).fit(rows)
    assert error(models[0]) < 1.3 * error(theirs) + 0.001
    held_out = models[0].transform(rows).where("row % 100 = 0").select("row", "a", "b", "pred")
    for r in trees.attributions(models[0], held_out, ["a", "b"]).collect():
        assert r.base + sum(r.shap) == pytest.approx(r.pred, abs=1e-9)
    ends = [2000, 2500]
    first, second = ours.fit_before(rows, ends)
    assert (first.values == ours.fit(rows.where("row < 2000")).values).all() and (second.values != first.values).any()  # nothing of the later rows


def test_forest_of_odd_inputs(spark):
    assembler = VectorAssembler(inputCols=["a"], outputCol="_x")
    rows = assembler.transform(spark.range(400).select(F.col("id").alias("row"), (F.col("id") % 3).cast("double").alias("a"), F.when(F.col("id") % 3 == 1, 5.0).otherwise(1.0).alias("y")))
    model = E.random_forest(trees=10)().setLabelCol("y").setPredictionCol("pred").fit(rows)
    assert {(r.a, r.pred) for r in model.transform(rows).select("a", "pred").distinct().collect()} == {(0.0, 1.0), (1.0, 5.0), (2.0, 1.0)}
    same = E.random_forest(trees=10)().setLabelCol("a").setPredictionCol("pred").fit(rows.where("a = 2"))
    assert [r.pred for r in same.transform(rows.limit(1)).collect()] == [2.0] and len(same.nodes.tree) == 10
    with pytest.raises(ValueError):
        E.random_forest(trees=10)().setLabelCol("y").fit(rows.withColumn("y", F.lit(float("inf"))))
    many = VectorAssembler(inputCols=["a", "y", "b"], outputCol="_x").transform(rows.drop("_x").withColumn("b", F.rand(1)))
    spark_own = E.random_forest(trees=3)().setLabelCol("a").setPredictionCol("pred").fit(many)  # more features than cells allow
    assert spark_own.getNumTrees == 3 and spark_own.getMaxDepth() == 30


def test_walk_forward_is_evaluated(spark):
    rows = spark.range(200).select((F.col("id") / 50).cast("int").alias("fold"), F.col("id").alias("row"), F.sin("id").alias("y_true"), (F.sin("id") + F.cos(F.col("id") * 3)).alias("pred"))
    got = E.evaluated(rows.repartition(3), ["row"]).orderBy("row").collect()
    assert [r.row for r in got] == list(range(200))
    y, p = (np.array([r[c] for r in got]) for c in ("y_true", "pred"))
    low, mean, high = E.bootstrap_ic(rows, ["row"]).first()
    for k, r in enumerate(got):
        own = slice(k // 50 * 50, k // 50 * 50 + 50)
        assert r.fold_ic_pearson == pytest.approx(np.corrcoef(y[own], p[own])[0, 1]) and r.fold_n_obs == 50 and r.n_obs == 200
        assert r.fold_ic_spearman == pytest.approx(np.corrcoef(y[own].argsort().argsort(), p[own].argsort().argsort())[0, 1])
        assert r.ic_pearson == pytest.approx(np.corrcoef(y, p)[0, 1]) and (r.ic_lower, r.ic_mean, r.ic_upper) == pytest.approx((low, mean, high))


def test_registered_forests_are_whole(spark, monkeypatch):
    """ml_rf and ml_walk_forward fit what the reference fits: 500 trees without a limit of depth."""
    from tickloom.operators import forest as R
    from tickloom.plans import catalog

    fitted, fit = [], R.Forest.fit_before
    monkeypatch.setattr(R.Forest, "fit_before", lambda self, rows, ends: fitted.append((self.trees, self.depth, self.leaf, len(ends))) or fit(self, rows, ends))
    out = catalog.QUERIES["ml_walk_forward"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 500 and {"fold_ic_pearson", "ic_pearson", "ic_lower", "ic_upper"} <= set(out[0].asDict())
    assert fitted == [(500, 30, 10, 5)]
