"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics of every whole text are computed once, in one map pass, and kept
(22 numbers a document). The trees are fitted by numpy on the driver from at
most `MAX_TRAIN` labelled documents, taken in order of a hash of the id so that
reruns agree; held-out documents (crc32 of the id as text, mod 5 = 0) are never
among them. The trees, flattened into arrays (feature, threshold, children,
leaf), score whole batches: every row walks all trees one level at a time.

Defined cases: null or empty text has statistics of zero and gets a score;
null id counts as an empty id text; labels without quality are not used, and of
several labels of one id the lowest counts; repeated documents are scored alike;
without any training rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import op02_quality
from tickloom.llm import text as tx
from tickloom.llm.tables import checkpointed

MAX_TRAIN, THRESHOLD = 20_000, 0.3
TREES, DEPTH, BINS, RATE, MIN_LEAF, L2 = 80, 4, 64, 0.15, 10, 1.0
_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "lower": np.isin(np.arange(256), np.arange(97, 123)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "high": np.arange(256) >= 128,
    "stop": np.isin(np.arange(256), list(b".!?")),
    "comma": np.isin(np.arange(256), list(b",;:")),
    "shout": np.arange(256) == 33,
    "pipe": np.arange(256) == 124,
    "symbol": np.isin(np.arange(256), list(b"#*$%&<>=_~^@\\/{}[]+")),
    "space": np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]),
}
FEATURES = ("n_words", "n_bytes", "word_length", "word_deviation", "longest_word", "one_byte_words", "distinct_words", "top_word", "repeat_words", "dup_lines", "n_lines", "line_words", *_CLASSES)


def features(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(offsets) - 1
    starts, ends, owner = tx.words(flat, offsets)
    length = (ends - starts).astype(np.float64)
    count = np.bincount(owner, minlength=n)
    words, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    mean = np.bincount(owner, length, minlength=n) / words
    deviation = np.sqrt(np.maximum(np.bincount(owner, length**2, minlength=n) / words - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    with np.errstate(over="ignore"):
        ids = np.sort(tx.span_hash(flat, starts, ends, 5) >> np.uint64(24) | owner.astype(np.uint64) << np.uint64(40))  # 40 bits of a word within its text
    new = np.flatnonzero(np.diff(ids, prepend=ids[:1] + np.uint64(1)) != 0)
    often = np.diff(np.append(new, len(ids)))
    of = (ids[new] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, often)
    _, _, _, dup, repeat = op02_quality.statistics(flat, offsets)
    line_ends = np.concatenate([[0], np.cumsum(flat == 10)])
    lines = line_ends[offsets[1:]] - line_ends[offsets[:-1]] + 1
    out = [count, np.diff(offsets), mean, deviation, longest, np.bincount(owner[length == 1], minlength=n) / words, np.bincount(of, minlength=n) / words, top / words, repeat / words, dup / lines, lines, count / lines]
    for table in _CLASSES.values():
        total = np.concatenate([[0], np.cumsum(table[flat])])
        out.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
    return np.column_stack(out).astype(np.float64)


@dataclass
class Trees:
    """All trees in flat arrays; a leaf's children are itself, so walks of fixed length end there."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic boosting; splits are searched on histograms of at most BINS quantile bins a feature."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    start = float(np.log(rate / (1 - rate)))
    empty = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros(0, np.int64), empty.astype(np.int64), empty, empty.astype(np.int64), empty.astype(np.int64), empty, start)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)])  # bin b: x <= edges[b]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    margin = np.full(n, start)
    flat = bins + np.arange(width) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        level = [(root, np.arange(n))]
        for d in range(depth + 1):
            nxt = []
            for k, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = -RATE * gs / (hs + L2)
                if d == depth or len(rows) < 2 * MIN_LEAF:
                    margin[rows] += value[k]
                    continue
                at = flat[rows].ravel()
                gh, hh, ch = (np.bincount(at, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (np.repeat(g[rows], width), np.repeat(h[rows], width), None))
                gain = gh**2 / (hh + L2) + (gs - gh) ** 2 / (hs - hh + L2) - gs**2 / (hs + L2)
                gain[(ch < MIN_LEAF) | (len(rows) - ch < MIN_LEAF)] = -1
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[j, b] <= 1e-9 or b >= len(edges[j]):
                    margin[rows] += value[k]
                    continue
                goes = bins[rows, j] <= b
                feature[k], threshold[k], left[k], right[k] = int(j), float(edges[j][b]), node(), node()
                nxt += [(left[k], rows[goes]), (right[k], rows[~goes])]
            level = nxt
    return Trees(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), start)


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats): the FEATURES of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = tx.bytes_of(batch.column("text"))
            found = [features(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.chunks(offsets)]
            x = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), stats], names=["id", "stats"])

    kind = docs.schema[id_col].dataType
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("stats", T.ArrayType(T.DoubleType()))]))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trained(described_docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Trees:
    """Trees fitted on at most `max_train` labelled documents outside the held-out fifth."""
    y = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("double").alias("y"))
    rows = described_docs.where(~held_out(F.col("id"))).join(y, F.col("id") == F.col("_id")).select("id", "stats", "y")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max_train).select("stats", "y").toArrow()
    x = np.array(sample["stats"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample["y"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    known = checkpointed(described(docs))
    trees = docs.sparkSession.sparkContext.broadcast(trained(known, labels, label, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(-1, len(FEATURES))
            score = [trees.value.scores(x[i : i + 4096]) for i in range(0, len(x), 4096)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", known.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return known.mapInArrow(run, schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
