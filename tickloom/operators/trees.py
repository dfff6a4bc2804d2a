"""Exact attributions of a forest's predictions to its features (path-dependent Shapley values).

A fitted forest is a table of nodes, bounded by trees * 2 ** (depth + 1); it is
sent to the tasks as flat arrays. There every leaf is a box: for each feature an
interval that a row lies in or not, and the share of training rows that the
splits on that feature let through on the way to the leaf. If S is the set of
known features, a leaf gives its value times, for each feature, 1 or 0 (known:
row in the interval or not) or the share (unknown). The Shapley weights of a
product of such factors are an integral over a mixing parameter t of

    product over features of (t * inside + (1 - t) * share)

without the attributed feature, a polynomial in t of degree below the number of
features on a path; Gauss-Legendre nodes integrate it exactly. So attributions
are array operations over rows x leaves x features, in blocks of bounded size.
Rows between the same thresholds of every feature (a cell) lie in the same
boxes, so a task works a cell out once and looks up its other rows.
Base value and attributions of a row add up to the forest's prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import fresh_path

#: Entries of a block of rows x leaves x features; nodes of a block of trees; cells that a task remembers.
BLOCK, NODES, CELLS = 1 << 21, 1 << 14, 1 << 16


class Nodes(NamedTuple):
    """Trees one after another; children come after their parent. A leaf has feature -1; `left` and `right` are places in the arrays."""

    tree: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    n_trees: int


def node_table(model: RandomForestRegressionModel) -> DataFrame:
    """One row per node of the fitted forest, as Spark's model writer stores them."""
    spark = SparkSession.active()
    path = fresh_path(spark)
    model.write().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"), n["split"]["numCategories"].alias("categories"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"), F.get(n["impurityStats"], 0).alias("rows"),
    )


def nodes(model) -> Nodes:
    """Of a model of Spark's own, or of :mod:`tickloom.operators.forest`, which has them at hand."""
    if not isinstance(model, RandomForestRegressionModel):
        return model.nodes
    t = node_table(model).orderBy("tree", "id").toPandas()
    if ((t.feature >= 0) & (t.categories >= 0)).any():
        raise ValueError("splits on categories have no interval")
    first = np.searchsorted(t.tree, np.arange(model.getNumTrees))  # ids count from 0 in each tree
    inner = t.left.to_numpy() >= 0
    place = lambda c: np.where(inner, t[c].to_numpy() + first[t.tree], -1)
    return Nodes(t.tree.to_numpy(), np.where(inner, t.feature, -1), t.threshold.fillna(0).to_numpy(), place("left"), place("right"), t.value.to_numpy(), t.rows.to_numpy(), model.getNumTrees)


def boxes(n: Nodes, d: int, trees: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the leaves of some trees: lower and upper ends by feature (above, up to and including), shares by feature, and values over the number of trees."""
    a, b = np.searchsorted(n.tree, [trees.start, trees.stop])
    size = b - a
    low, high, share = np.full((size, d), -np.inf), np.full((size, d), np.inf), np.ones((size, d))
    at = np.flatnonzero(np.diff(n.tree[a:b], prepend=-1))  # roots, then level by level
    while len(at):
        at = at[n.feature[a + at] >= 0]
        f, cut = n.feature[a + at], n.threshold[a + at]
        for child, end, other in ((n.left, high, np.minimum), (n.right, low, np.maximum)):
            c = child[a + at] - a
            low[c], high[c], share[c] = low[at], high[at], share[at]
            end[c, f] = other(end[c, f], cut)
            share[c, f] *= n.rows[a + c] / n.rows[a + at]
        at = np.concatenate([n.left[a + at], n.right[a + at]]) - a
    leaf = np.flatnonzero(n.feature[a:b] < 0)
    return low[leaf], high[leaf], share[leaf], n.value[a + leaf] / n.n_trees


def blocks_of_trees(n: Nodes) -> Iterator[slice]:
    size = np.bincount(n.tree, minlength=n.n_trees)
    first = 0
    while first < n.n_trees:
        last = max(first + 1, int(np.searchsorted(np.cumsum(size[first:]), NODES, "right")) + first)
        yield slice(first, last)
        first = last


def leaf_attributions(x: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Attributions (row, feature) that some leaves give to rows x (row, feature)."""
    d = x.shape[1]
    used = int((share < 1).sum(1).max(initial=0))
    t, weight = np.polynomial.legendre.leggauss(max(1, (used + 1) // 2))
    t, weight = (t + 1) / 2, weight / 2
    out = np.zeros_like(x)
    per = max(1, BLOCK // max(1, len(value) * d))
    for at in range(0, len(x), per):
        part = x[at : at + per, None]
        inside = ((low < part) & (part <= high)).astype(np.float64)
        mixed = np.zeros_like(inside)
        for s, w in zip(t, weight):
            factor = s * inside + (1 - s) * share  # never 0: every child has training rows
            mixed += w * factor.prod(2, keepdims=True) / factor
        out[at : at + per] = np.einsum("l,rld,rld->rd", value, inside - share, mixed)
    return out


def expected(n: Nodes, d: int) -> float:
    """The prediction where no feature is known: the mean over the training rows."""
    total = 0.0
    for trees in blocks_of_trees(n):
        _, _, share, value = boxes(n, d, trees)
        total += float((share.prod(1) * value).sum())
    return total


def cells(n: Nodes, x: np.ndarray) -> np.ndarray:
    """Of each row: by feature, how many of the forest's thresholds lie below its value."""
    cuts = [np.unique(n.threshold[n.feature == k]) for k in range(x.shape[1])]
    return np.column_stack([np.searchsorted(c, x[:, k]).astype(np.int32) for k, c in enumerate(cuts)])


def cell_attributions(n: Nodes, x: np.ndarray, known: dict[bytes, np.ndarray]) -> np.ndarray:
    """Attributions (row, feature) of rows x; `known` keeps those of cells for the next call."""
    d = x.shape[1]
    found, example, which = np.unique(cells(n, x), axis=0, return_index=True, return_inverse=True)
    keys = [c.tobytes() for c in found]
    new = [i for i, k in enumerate(keys) if k not in known]
    if new:
        if len(known) + len(new) > CELLS:
            known.clear()
            new = list(range(len(keys)))
        rows = x[example[new]]
        values = np.zeros_like(rows)
        for trees in blocks_of_trees(n):
            values += leaf_attributions(rows, *boxes(n, d, trees))
        known.update(zip((keys[i] for i in new), values))
    return np.array([known[k] for k in keys]).reshape(-1, d)[which.ravel()]


def attributions(model: RandomForestRegressionModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds `base` and `shap`, an array by feature; base + sum(shap) is the model's prediction. Rows with a null feature have a null array. NaN lies above every threshold."""
    n, d = nodes(model), len(features)
    base, sent = expected(n, d), rows.sparkSession.sparkContext.broadcast(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[bytes, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(f).cast(pa.float64()) for f in features]
            known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
            x = np.maximum(np.where(np.isnan(x), np.inf, x)[known], np.finfo(float).min)  # boxes are open below
            whole = np.zeros((len(known), d))
            whole[known] = cell_attributions(sent.value, x, done)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(known) + 1, dtype=np.int32) * d), pa.array(whole.ravel()), mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "shap"])

    schema = T.StructType([*rows.schema, T.StructField("shap", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema).withColumn("base", F.lit(base))


def importance(attributed: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): mean absolute attribution."""
    means = attributed.agg(*[F.avg(F.abs(F.get("shap", F.lit(k)))).alias(f"m{k}") for k in range(len(features))])
    return means.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{k}").alias("importance")) for k, f in enumerate(features)])))
