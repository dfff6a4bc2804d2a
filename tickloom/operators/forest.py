"""Random forests on one or two features, over any number of rows, from one pass for all trees.

Features are cut at their exact quantiles into `BINS` intervals, as tree learners
over large tables do, so rows fall into a bounded number of cells. What a split
needs of a bootstrap sample is, for each cell, the number of draws and the sum of
their targets; tasks add these up for every tree over all rows, a shuffle by tree
merges them, and the trees grow from them, a tree in one task.

A row's draws in a tree's bootstrap sample are a Poisson number of mean 1
(16 bits; 9 draws at most) that follows from seed, row number and tree alone.
Sums are of whole numbers (targets in units of their largest amount / 2**34), so
neither partitions nor their order change a forest. Forests of the rows before
several ends (walk-forward) come from the same pass.

With more features cells outnumber rows: there Spark's own forest is fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from math import factorial, frexp, isfinite, ldexp

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.quantiles import quantiles
from tickloom.operators.trees import Nodes
from tickloom.session import stored

#: Intervals of a feature; cells at most; trees of a block, which is shuffled and grown as one; rows that are drawn at once; bits of a target.
BINS, CELLS, BLOCK, ROWS, BITS = 32, 1024, 10, 512, 34
_POISSON = np.searchsorted(np.cumsum([np.exp(-1) / factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16), "right").astype(np.float64)
_GOLDEN = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def draws(rows: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each row (by its number) is in each tree's bootstrap sample: (row, tree)."""
    with np.errstate(over="ignore"):
        own = mix(rows.astype(np.int64).view(np.uint64) + np.uint64(_GOLDEN * (seed + 1) & (2**64 - 1)))
        h = own[:, None] + np.arange(1, (trees + 3) // 4 + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
    return _POISSON[mix(h).view(np.uint16)[:, :trees]]  # four trees a word


def cell_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The cell of each row (row, feature): by feature, the number of cuts below its value."""
    out = np.zeros(len(x), np.int64)
    for k, c in enumerate(cuts):
        out = out * BINS + np.searchsorted(c, x[:, k], "left")
    return out


def intervals(d: int) -> list[np.ndarray]:
    """The interval of each cell, by feature."""
    return list(np.unravel_index(np.arange(BINS**d), (BINS,) * d))


def _sums(cuts: list[np.ndarray], ends: list[int], trees: int, seed: int, unit: float):
    """One row a block of trees and stretch of rows between `ends`: draws and summed targets by cell, over the task's rows."""
    n_cells = BINS ** len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(f"x{k}").to_numpy() for k in range(len(cuts))])
            cell, y, row = cell_of(x, cuts), np.rint(batch.column("y").to_numpy() / unit), batch.column("row").to_numpy()
            stretch = np.searchsorted(ends, row, "right")
            for j in np.unique(stretch).tolist():
                total = totals.setdefault(j, np.zeros((2, n_cells, trees), np.int64))
                mine = np.flatnonzero(stretch == j)
                order = mine[np.argsort(cell[mine], kind="stable")]
                for at in range(0, len(order), ROWS):
                    some = order[at : at + ROWS]
                    c = cell[some]
                    new = np.diff(c, prepend=-1) != 0
                    group, place = np.cumsum(new) - 1, np.arange(len(some))
                    parts = np.zeros((2, group[-1] + 1, len(some)))
                    parts[0, group, place], parts[1, group, place] = 1, y[some]
                    total[:, c[new]] += (parts @ draws(row[some], trees, seed)).astype(np.int64)  # whole numbers below 2 ** 53, so exact
        for j, total in totals.items():
            for at in range(0, trees, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([j], pa.int32()), pa.array([total[:, :, at : at + BLOCK].tobytes()], pa.binary())], names=["block", "stretch", "sums"])

    return run


#: A node as it is stored: `left` and `right` count from the first node of its tree; `cut` is the last interval on the left.
NODE = np.dtype([("tree", "<i4"), ("feature", "<i4"), ("cut", "<i4"), ("left", "<i4"), ("right", "<i4"), ("value", "<f8"), ("rows", "<f8")])


def grow(n: np.ndarray, s: np.ndarray, first: int, d: int, depth: int, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """NODEs of some trees, and the value of each tree's leaf by cell, from draws and summed targets (tree, cell); `first` is the number of the first tree.

    Trees grow level by level. A node looks at the root of the number of features, and at further ones only if none of those can be
    split. The best split leaves most of the variance between its sides; both have `leaf` draws at least.
    """
    trees, n_cells = n.shape
    where, look = intervals(d), max(1, int(d**0.5))
    n, s = n.ravel(), s.ravel()
    with np.errstate(divide="ignore", invalid="ignore"):
        least = 1e-12 * np.where(n > 0, s * s / n, 0.0).reshape(trees, n_cells).sum(1)  # rounding is no gain
    levels: list[np.ndarray] = []
    values = np.zeros(len(n))
    owner, name = np.arange(trees), mix(np.arange(first, first + trees).astype(np.uint64) + np.uint64(_GOLDEN * (seed + 2) & (2**64 - 1)))
    here, at, base = np.arange(len(n)), np.repeat(owner, n_cells), 0  # the cells of trees that still go on, and their nodes of this level
    for level in range(depth + 1):
        m = len(owner)
        cell, w, t = here % n_cells, n[here], s[here]
        weight, total = np.bincount(at, w, m), np.bincount(at, t, m)
        feature, cut, best = np.full(m, -1), np.zeros(m, np.int64), least[owner]
        if level < depth:
            gains, cuts = np.zeros((d, m)), np.zeros((d, m), np.int64)
            for k in range(d):
                bin_ = at * BINS + where[k][cell]
                left_n, left_s = (np.bincount(bin_, z, m * BINS).reshape(m, BINS).cumsum(1)[:, :-1] for z in (w, t))
                right_n, right_s = weight[:, None] - left_n, total[:, None] - left_s
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((left_n >= leaf) & (right_n >= leaf), left_s**2 / left_n + right_s**2 / right_n - (total**2 / weight)[:, None], -np.inf)
                cuts[k] = gain.argmax(1)
                gains[k] = gain[np.arange(m), cuts[k]]
            with np.errstate(over="ignore"):
                order = np.argsort(mix(name[:, None] + np.arange(1, d + 1, dtype=np.uint64) * np.uint64(_GOLDEN)), axis=1)
            for k in range(d):
                f = order[:, k]
                take = (gains[f, np.arange(m)] > best) & ((k < look) | (feature < 0))
                feature[take], cut[take], best[take] = f[take], cuts[f[take], take.nonzero()[0]], gains[f[take], take.nonzero()[0]]
        split = np.flatnonzero(feature >= 0)
        child = np.full(m, -1)
        child[split] = np.arange(len(split)) * 2
        nodes = np.zeros(m, NODE)
        nodes["tree"], nodes["feature"], nodes["cut"], nodes["rows"] = owner, feature, cut, weight
        nodes["left"], nodes["right"] = np.where(child < 0, -1, base + m + child), np.where(child < 0, -1, base + m + child + 1)
        nodes["value"] = np.where(weight > 0, total / np.maximum(weight, 1), s.sum() / max(1.0, n.sum()))  # a sample without rows: the mean of the others
        levels.append(nodes)
        on = child[at] >= 0
        values[here[~on]] = nodes["value"][at[~on]]
        if not len(split):
            break
        here, at, cell = here[on], at[on], cell[on]
        right = np.zeros(len(at), np.int64)
        for k in range(d):
            right += (feature[at] == k) & (where[k][cell] > cut[at])
        at, base = child[at] + right, base + m
        owner = np.repeat(owner[split], 2)
        with np.errstate(over="ignore"):
            name = mix(np.repeat(name[split], 2) + np.tile(np.array([1, 2], np.uint64), len(split)) * np.uint64(0xD6E8FEB86659FD93))
    found = np.concatenate(levels)
    order = np.argsort(found["tree"], kind="stable")  # a tree after the other, each level by level
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found = found[order]
    start = np.searchsorted(found["tree"], np.arange(trees))
    for side in ("left", "right"):
        found[side] = np.where(found[side] >= 0, place[found[side]] - start[found["tree"]], -1)
    found["tree"] += first
    return found, values.reshape(trees, n_cells)


def _grown(trees: int, d: int, n_ends: int, depth: int, leaf: int, seed: int, unit: float):
    """For each end and block of trees that a task has: NODEs, and by cell the sum of the trees' values, from the sums of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, stretch, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(data.as_buffer(), np.int64)
                if (block, stretch) in sums:
                    sums[block, stretch] += part
                else:
                    sums[block, stretch] = part.copy()
        for block in sorted({b for b, _ in sums}):
            upto = 0
            for k in range(n_ends):
                upto = upto + sums.pop((block, k), 0)
                if np.ndim(upto):
                    n, s = upto.reshape(2, BINS**d, -1).astype(np.float64).transpose(0, 2, 1)
                    nodes, values = grow(n, s * unit, block * BLOCK, d, depth, leaf, seed)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([nodes.tobytes()], pa.binary()), pa.array([values.sum(0).tobytes()], pa.binary())], names=["number", "block", "nodes", "totals"])

    return run


def cuts_of(pairs: DataFrame, d: int) -> list[np.ndarray]:
    """Of each feature f, from rows (f, v): midpoints between its values if there are `BINS` or fewer, else the quantiles that deal its rows into `BINS` parts."""
    about = {r.f: r.n for r in pairs.groupBy("f").agg(F.approx_count_distinct("v").alias("n")).collect()}
    found: dict[int, list[float]] = {}
    small = [f for f, n in about.items() if n <= 2 * BINS]
    if small:
        values: dict[int, list[float]] = {}
        for r in pairs.where(F.col("f").isin(small)).distinct().collect():  # some 2 * BINS a feature
            values.setdefault(r.f, []).append(r.v)
        found = {f: [(a + b) / 2 for a, b in zip(sorted(v), sorted(v)[1:])] for f, v in values.items() if len(v) <= BINS}
    rest = [f for f in range(d) if f not in found]
    if rest:
        shares = {f"q{k}": k / BINS for k in range(1, BINS)}
        found |= {r.f: [r[q] for q in shares] for r in quantiles(pairs.where(F.col("f").isin(rest)), "v", shares, ["f"]).collect()}
    return [np.unique(np.array(found[f], np.float64)) for f in range(d)]


class Forest:
    """Estimator: bootstrap samples by row number (column `row`), `sqrt` of the features a split, leaves of `leaf` draws at least."""

    def __init__(self, trees: int, depth: int, leaf: int, seed: int, features: str = "_x", label: str = "label", prediction: str = "prediction"):
        self.trees, self.depth, self.leaf, self.seed, self.features, self.label, self.prediction = trees, depth, leaf, seed, features, label, prediction

    def setLabelCol(self, name: str) -> Forest:
        self.label = name
        return self

    def setPredictionCol(self, name: str) -> Forest:
        self.prediction = name
        return self

    def fit(self, rows: DataFrame):
        return self.fit_before(rows, [2**62])[0]

    def fit_before(self, rows: DataFrame, ends: list[int]) -> list:
        """A model of the rows before each of `ends`, which rise. All take the intervals that the rows before the first end give."""
        x = vector_to_array(self.features)
        rows = rows.where(F.col("row") < ends[-1])
        d = len(rows.select(x).first()[0])
        if BINS**d > CELLS:
            many = RandomForestRegressor(featuresCol=self.features, labelCol=self.label, predictionCol=self.prediction, numTrees=self.trees, minInstancesPerNode=self.leaf, featureSubsetStrategy="sqrt", maxDepth=self.depth, seed=self.seed)
            return [many.fit(rows.where(F.col("row") < end)) for end in ends]
        y = F.col(self.label).cast("double")
        most = rows.agg(F.max(F.abs(y))).first()[0]
        if not isfinite(most):
            raise ValueError("the target isn't finite")
        unit = ldexp(1.0, frexp(most)[1] - BITS) if most else 1.0
        cuts = cuts_of(rows.where(F.col("row") < ends[0]).select(F.posexplode(x).alias("f", "v")), d)
        numbers = rows.select(F.col("row").cast("long").alias("row"), y.alias("y"), x.alias("_a")).select("row", "y", *[F.get("_a", F.lit(k)).alias(f"x{k}") for k in range(d)])
        blocks = numbers.mapInArrow(_sums(cuts, ends, self.trees, self.seed, unit), "block int, stretch int, sums binary")
        dealt = blocks.repartition(min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.trees // BLOCK)), "block")
        found = stored(dealt.mapInArrow(_grown(self.trees, d, len(ends), self.depth, self.leaf, self.seed, unit), "number int, block int, nodes binary, totals binary"))
        values = np.zeros((len(ends), BINS**d))
        for r in found.select("number", "block", "totals").orderBy("number", "block").collect():  # CELLS numbers each
            values[r.number] += np.frombuffer(r.totals)
        return [ForestModel(found.where(F.col("number") == k), values[k] / self.trees, cuts, self) for k in range(len(ends))]


class ForestModel:
    """A fitted forest: a value for each cell. Its trees stay in the table `found` until attributions ask for them."""

    def __init__(self, found: DataFrame, values: np.ndarray, cuts: list[np.ndarray], of: Forest):
        self.found, self.values, self.cuts = found, values, cuts
        self.trees, self.features, self.prediction = of.trees, of.features, of.prediction

    @cached_property
    def nodes(self) -> Nodes:
        n = np.frombuffer(b"".join(r.nodes for r in self.found.select("block", "nodes").orderBy("block").collect()), NODE)
        first = np.searchsorted(n["tree"], np.arange(self.trees))[n["tree"]]
        threshold = np.zeros(len(n))
        for k, c in enumerate(self.cuts):
            threshold[n["feature"] == k] = c[n["cut"][n["feature"] == k]]
        left, right = (np.where(n["left"] >= 0, n[side] + first, -1) for side in ("left", "right"))
        return Nodes(n["tree"], n["feature"], threshold, left, right, n["value"], n["rows"], self.trees)

    def transform(self, rows: DataFrame) -> DataFrame:
        x = vector_to_array(self.features)

        def below(k: int, c: np.ndarray) -> Column:
            return sum([(F.get(x, F.lit(k)) > F.lit(float(v))).cast("int") for v in c], F.lit(0))

        cell = F.lit(0)
        for k, c in enumerate(self.cuts):
            cell = cell * BINS + below(k, c)
        return rows.withColumn(self.prediction, F.get(F.lit(self.values), cell))
