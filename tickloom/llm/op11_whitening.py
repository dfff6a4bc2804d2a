"""Embedding whitening by a one-sided Jacobi SVD.

Entries become whole numbers x = floor(1024 * c) + 100000, so that sums and
deviations are exact. Then

1. one pass sums x by dimension (partial sums a task);
2. blockwise TSQR: each task folds its centred rows, a block at a time, into one
   upper triangle R; the triangles are stacked and folded again, up to `FAN` at
   a time, level by level, until one is left. R has the singular values and right
   vectors of all centred rows, and its size depends on the dimension alone;
3. plane rotations make the columns of R orthogonal. Their lengths are the
   singular values, found without squaring the condition number; the product of
   the rotations holds the components. Deviations are lengths / sqrt(n);
4. rows are projected on the components and divided by the deviations. What that
   gives is measured: counts, means and centred products of the whitened rows are
   merged in the same tree.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
entries are dropped; so are vectors of another length than the commonest (of
equally common ones the longest), as they share no covariance; x saturates at
2**62 either way; a deviation beyond a long is null; components without variance
(to double precision: constant tables, dimensions that depend on others, fewer
rows than dimensions) can't be whitened and aren't returned, so a table of equal
vectors, or without rows, gives none; repeated rows count each; other columns
pass through in `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.tables import stored

COMPONENTS, SCALE, SHIFT, FAN, BLOCK = 8, 1024, 100_000, 32, 4096
_SAFE = 2**62


class Fit(NamedTuple):
    """n rows with the sums of x by dimension; unit components as columns, by falling variance, and the total variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    total: float


def usable(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a list<double> column remain; then offset, length and the flat entries (null as NaN)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = pc.fill_null(column.values, np.nan).to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    if length is not None:
        ok &= size == length
    return np.flatnonzero(ok), offsets[:-1], size, flat


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * entries.astype(np.float64))
    near = np.abs(x) < _SAFE
    return np.where(near, np.where(near, x, 0).astype(np.int64) + SHIFT, np.where(x > 0, _SAFE, -_SAFE))


def x_blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers in the batch and their x-vectors, a block at a time."""
    rows, at, _, flat = usable(batch.column("v"), length)
    block = max(length, BLOCK)
    for k in range(0, len(rows), block):
        part = rows[k : k + block]
        yield part, whole_numbers(flat[at[part][:, None] + np.arange(length)])


def scaled_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: int64 where it fits, else Python's integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums.tolist()), default=0) < _SAFE:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squared(deviations: np.ndarray) -> list[int | None]:
    """Sum of squares of each row; null beyond a long."""
    if deviations.dtype != object and float(np.square(deviations.astype(np.float64)).sum(1).max(initial=0)) < _SAFE:
        return np.square(deviations).sum(1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in deviations]
    return [s if s < 2**63 else None for s in sums]


def folded(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """The triangle R of stacked blocks, folded in one by one."""
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


def merged(states: DataFrame, merge: Callable[[list[bytes]], bytes], fan: int) -> bytes | None:
    """(block, state) rows, merged `fan` neighbours at a time until one is left."""
    states = stored(states)
    blocks = (states.agg(F.max("block")).first()[0] or 0) + 1
    schema = "block long, state binary"

    def level(t: pa.Table) -> pa.Table:
        parts = sorted(zip(t["own"].to_pylist(), t["state"].to_pylist()))
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int64()), "state": pa.array([merge([s for _, s in parts])], pa.binary())})

    while blocks > 1:
        states = states.select(F.floor(F.col("block") / fan).alias("block"), F.col("block").alias("own"), "state").groupBy("block").applyInArrow(level, schema)
        blocks = -(-blocks // fan)
    one = states.first()
    return None if one is None else one.state


def rotated(r: np.ndarray, max_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the orthogonalised columns of `r`, falling, and the accumulated rotations.

    Every round rotates disjoint pairs of columns; d - 1 rounds of a tournament meet all pairs.
    """
    d = r.shape[1]
    a, v = r.T.copy(), np.eye(d)  # columns as rows
    even = d + d % 2
    limit = np.finfo(float).eps * d
    for _ in range(max_sweeps):
        ring, quiet = list(range(even)), True
        for _ in range(even - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[: even // 2], ring[: even // 2 - 1 : -1]) if max(p, q) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            alpha, beta, gamma = (a[p] ** 2).sum(1), (a[q] ** 2).sum(1), (a[p] * a[q]).sum(1)
            turn = np.abs(gamma) > limit * np.sqrt(alpha) * np.sqrt(beta)
            if not turn.any():
                continue
            quiet = False
            p, q, alpha, beta, gamma = (z[turn] for z in (p, q, alpha, beta, gamma))
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = (1 / np.hypot(1.0, t))[:, None]
            s = c * t[:, None]
            for m in (a, v):
                m[p], m[q] = c * m[p] - s * m[q], s * m[p] + c * m[q]
        if quiet:
            break
    else:
        raise RuntimeError(f"rotations did not settle in {max_sweeps} sweeps")
    length = np.sqrt((a**2).sum(1))
    order = np.argsort(-length, kind="stable")
    return length[order], v[order].T


def vectors_of(rows: DataFrame, vector_col: str, carry: list[str] | None) -> DataFrame:
    """`row` (the input row, or its columns in `carry`) and the vector `v` as doubles."""
    row = F.struct(*[F.col(f"`{c}`") for c in (rows.columns if carry is None else carry)])
    return rows.select(row.alias("row"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))


def exact_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Rows that remain, and the sums of their x by dimension, as Python's integers."""
    schema = pa.schema([("length", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            rows, _, size, _ = usable(batch.column("v"))
            for length in np.unique(size[rows]).tolist():
                have = held.setdefault(length, [0, np.zeros(length, object)])
                for part, x in x_blocks(batch, length):
                    small = int(np.abs(x).max()) * len(x) < _SAFE
                    have[0] += len(part)
                    have[1] = have[1] + (x.sum(0) if small else x.astype(object).sum(0)).astype(object)
        for length, (n, sums) in held.items():
            columns = [[length] * length, list(range(length)), [n] * length, [Decimal(int(s)) for s in sums]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    totals = stored(vectors.select("v").mapInArrow(run, "length long, pos long, n long, total decimal(38,0)").groupBy("length", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    common = totals.where("pos = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if common is None:
        return 0, np.zeros(0, object)
    sums = np.zeros(common.length, object)
    for r in totals.where(F.col("length") == common.length).select("pos", "total").collect():  # a row a dimension
        sums[r.pos] = int(r.total)
    return common.n, sums


def fit(vectors: DataFrame) -> Fit:
    """Components of the rows of :func:`vectors_of`."""
    n, sums = exact_sums(vectors)
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = folded((scaled_deviations(x, n, sums) / n).astype(np.float64) for batch in batches for _, x in x_blocks(batch, d))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(r)], pa.binary())], names=["block", "state"])

    def merge(states: list[bytes]) -> bytes:
        return _packed(folded(_unpacked(s, d) for s in states))

    fan = max(2, min(FAN, 2**27 // max(1, 8 * d * d)))
    state = merged(vectors.select("v").mapInArrow(run, "block long, state binary"), merge, fan) if n else None
    if state is None:
        return Fit(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    length, components = rotated(_unpacked(state, d))
    real = length > length[0] * d * np.finfo(float).eps
    top = np.abs(components).argmax(0)
    components = components * np.where(components[top, np.arange(d)] < 0, -1.0, 1.0)  # the largest entry is positive
    return Fit(n, sums, components[:, real], length[real] ** 2 / n, float((length**2).sum() / n))


def _packed(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, np.float64).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width)


def whitened(vectors: DataFrame, model: Fit, count: int = COMPONENTS) -> DataFrame:
    """`row`, `deviation` (sum of (n * x - S)**2) and `whitened`, an array of up to `count` components, of the rows that remain."""
    n, sums, width = model.n, model.sums, min(count, len(model.variance))
    scale = model.components[:, :width] / np.sqrt(model.variance[:width])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in x_blocks(batch, len(sums)) if width else ():
                deviations = scaled_deviations(x, n, sums)
                w = (deviations / n).astype(np.float64) @ scale
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), pa.array(squared(deviations), pa.int64()), lists], names=["row", "deviation", "whitened"])

    schema = T.StructType([vectors.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return vectors.mapInArrow(run, schema)


def moments(states: Iterator[np.ndarray]) -> np.ndarray | None:
    """Merges states of count (a full row), mean, and centred products, stacked as rows."""
    out = None
    for s in states:
        if out is None:
            out = s
            continue
        n, m = out[0, 0], s[0, 0]
        gap = s[1] - out[1]
        out = np.vstack([out[0] + m, out[1] + gap * (m / (n + m)), out[2:] + s[2:] + np.outer(gap, gap) * (n * m / (n + m))])
    return out


def identity_error(rows: DataFrame, width: int) -> float | None:
    """Largest absolute entry of the covariance of `whitened` minus the identity."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy().reshape(-1, width)
            for k in range(0, len(w), BLOCK):
                part = w[k : k + BLOCK]
                mean = part.mean(0)
                yield np.vstack([np.full(width, float(len(part))), mean, (part - mean).T @ (part - mean)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = moments(states(batches))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(found)], pa.binary())], names=["block", "state"])

    state = merged(rows.select("whitened").mapInArrow(run, "block long, state binary"), lambda s: _packed(moments(_unpacked(x, width) for x in s)), FAN) if width else None
    if state is None:
        return None
    all_rows = _unpacked(state, width)
    return float(np.abs(all_rows[2:] / all_rows[0, 0] - np.eye(width)).max())


def digest(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = vectors_of(embeddings, vector_col, [id_col])
    model = fit(vectors)
    rows = stored(whitened(vectors, model, count))
    width = min(count, len(model.variance))
    error = identity_error(rows, width)
    explained = F.array(*[F.lit(float(e / model.total)) for e in model.variance[:width]]) if width else F.array().cast("array<double>")
    entry = rows.select(F.col(f"row.`{id_col}`").alias(id_col), F.posexplode("whitened").alias("k", "whitened"), "deviation")
    return entry.select(id_col, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
