"""Removal of repeated windows of consecutive units (words or lines) across a corpus.

A window is `size` consecutive units of one document. Every unit is removed that
a window covers whose unit sequence also starts earlier: in a document of
smaller id, or earlier in the same document. Windows are judged on the input.

Plan: one map pass hashes windows (96 bits). Within an Arrow batch only the
first occurrence of a window goes on; the others are known repeats and travel as
merged runs, so a window that fills a third of the corpus adds one row a batch;
of rows of equal id and equal text only the first is looked at.
A window's bucket is the least hash of its 8-word substrings (of the whole
window, for lines): equal windows have equal buckets, and neighbours mostly
share theirs, so a run of neighbours travels as one row with its hashes in a
binary. One shuffle by bucket, sorted, brings equal windows together; a task
reads whole buckets, some at a time, and ranks occurrences. Repeats go back to
their document by id, text key (64 bits) and length, where covered units are merged and cut.

Optionally a count-min prefilter (two rows of cells, merged from the sketches of
all partitions) runs first, and only windows that it estimates as repeated are
shuffled. It overestimates, so no repeated window is lost. Its width follows the
corpus up to a bound (see :mod:`tickloom.llm.sketch`); beyond that it lets more single windows through, and the result is the same.

Defined cases: null or empty text has no units; a null id sorts first; rows of
equal id and equal text are one document and get equal results; other columns
pass through in `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import sketch as sketching
from tickloom.llm import text as tx
from tickloom.llm.tables import keyed


def word_units(flat, offsets):
    return tx.words(flat, offsets)


def line_units(flat, offsets):
    """\\n-split lines, empty ones included; an empty text has none."""
    breaks = np.flatnonzero(flat == 10)
    rows = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.sort(np.concatenate([offsets[:-1][rows], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:][rows]]))
    owner = np.sort(np.concatenate([rows, np.searchsorted(offsets, breaks, "right") - 1]))
    return starts, ends, owner


UNITS: dict[str, Callable] = {"word": word_units, "line": line_units}


GRAM = {"word": 8, "line": None}


def _windows(flat: np.ndarray, offsets: np.ndarray, unit: str, size: int, whole: bool = True):
    """Hash (64 bits) of each window; with `whole`, also 32 bits more, the bucket, and the row and position (in units of the row)."""
    starts, ends, owner = UNITS[unit](flat, offsets)
    n = len(starts) - size + 1
    if n <= 0:
        return [np.zeros(0, t) for t in (np.uint64, np.uint32, np.uint64, np.int64, np.int64)]
    inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
    ids = tx.span_hash(flat, starts, ends, 0)
    h1 = tx.mix(tx.rolling(ids, size, 0xD6E8FEB86659FD93)[inside], 7)
    if not whole:
        return [h1]
    other = tx.span_hash(flat, starts, ends, 1)
    h2 = (tx.mix(tx.rolling(other, size, 0xD6E8FEB86659FD95)[inside], 8) >> np.uint64(32)).astype(np.uint32)
    bucket = h1
    if GRAM[unit] is not None and GRAM[unit] < size:
        least, window, width = tx.mix(tx.rolling(ids, GRAM[unit], 0xA24BAED4963EE407), 9), size - GRAM[unit] + 1, 1
        while width * 2 <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        bucket = np.minimum(least[:n], least[window - width : window - width + n])[inside]
    row = owner[inside]
    return [h1, h2, bucket, row, inside - np.searchsorted(owner, np.arange(len(offsets) - 1))[row]]


#: A run of neighbouring windows from `pos` on, hashes of 8 + 4 bytes each in `hashes`; or (hashes null) `n` units known to be repeated.
ROWS = "bucket long, id long, key long, bytes int, pos int, n int, hashes binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("bytes", pa.int32()), ("pos", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary())])
_HASH = np.dtype([("h1", "<u8"), ("h2", "<u4")])
_LOW = 2**32 - 1


def _later(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which occurrences are not at the first (id, position) of their hash."""
    order = np.lexsort((pos, ids, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = False
    for h in (h1, h2):  # one column in order at a time: they are large
        x = h[order]
        new[1:] |= x[1:] != x[:-1]
    which, late = np.cumsum(new, dtype=np.int32) - 1, np.zeros(len(order), bool)
    for column in (ids, pos):
        x = column[order]
        late |= x != x[new][which]
    out = np.zeros(len(order), bool)
    out[order] = late
    return out


def repeated_rows(ids: np.ndarray, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which rows are the same document (id, key, bytes) as an earlier one; what is found in that one holds for them."""
    order = np.lexsort((lengths, keys, ids))
    out = np.zeros(len(order), bool)
    i, k, n = ids[order], keys[order], lengths[order]
    out[order[1:]] = (i[1:] == i[:-1]) & (k[1:] == k[:-1]) & (n[1:] == n[:-1])
    return out


def _emit(unit: str, size: int, sketch=None):
    """Runs of first occurrences in the batch, and merged runs of units that known repeats cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = tx.bytes_of(batch.column("text"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            lengths = batch.column("bytes").to_numpy(zero_copy_only=False)
            copied = repeated_rows(ids, keys, lengths)
            parts = []
            for a, b in tx.chunks(offsets):
                found = _windows(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], unit, size)
                if copied.any():
                    found = [x[~copied[found[3] + a]] for x in found]
                if sketch is not None:
                    keep = sketching.hits(sketch, found[0])
                    found = [x[keep] for x in found]
                parts.append((*found[:3], (found[3] + a).astype(np.int32), found[4].astype(np.int32)))
            if not parts:
                continue
            h1, h2, bucket, row, pos = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            late = _later(h1, h2, ids[row], pos)
            keep, gone = np.flatnonzero(~late), np.flatnonzero(late)  # both in reading order
            if len(keep):
                r, p, c = row[keep], pos[keep], bucket[keep]
                first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (c[1:] != c[:-1])]))
                packed = np.empty(len(keep), _HASH)
                packed["h1"], packed["h2"] = h1[keep], h2[keep]
                count = np.diff(np.append(first, len(keep)))
                hashes = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(keep)).astype(np.int32) * _HASH.itemsize), pa.py_buffer(packed.tobytes())])
                yield _rows(c[first].view(np.int64), ids[r[first]], keys[r[first]], lengths[r[first]], p[first], count, hashes)
            if len(gone):
                r, p = row[gone], pos[gone]
                first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] > p[:-1] + size)]))
                last = np.append(first[1:], len(gone)) - 1
                salt = tx.mix(tx.mix(ids[r[first]].view(np.uint64)) ^ (keys[r[first]] + p[first]).view(np.uint64)).view(np.int64)  # they need no company: spread, copies too
                yield _rows(salt, ids[r[first]], keys[r[first]], lengths[r[first]], p[first], p[last] + size - p[first], pa.nulls(len(first), pa.binary()))

    return run


def _rows(bucket, ids, keys, lengths, pos, n, hashes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids), pa.array(keys), pa.array(lengths.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), hashes], schema=_SCHEMA)


def _settle(size: int, rows_at_once: int = 100_000):
    """Repeated runs (id, key, bytes, n * 2**32 + pos) of rows that arrive sorted by bucket; whole buckets are ranked together."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("bytes", pa.int64()), ("span", pa.int64())])

    def settled(t: pa.Table) -> Iterator[pa.RecordBatch]:
        known = t.filter(pa.compute.is_null(t["hashes"]))
        columns = ("id", "key", "bytes", "pos", "n")
        ids, keys, lengths, pos, n = (known[c].to_numpy().astype(np.int64) for c in columns)
        out = [(ids, keys, lengths, n << 32 | pos)]
        rest = t.filter(pa.compute.is_valid(t["hashes"]))
        if len(rest):
            ids, keys, lengths, pos, n = (rest[c].to_numpy().astype(np.int64) for c in columns)
            h = np.frombuffer(b"".join(rest["hashes"].to_pylist()), _HASH)
            who = np.repeat(np.arange(len(n)), n)
            at = pos[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            gone = np.flatnonzero(_later(h["h1"], h["h2"], ids[who], at))
            if len(gone):
                w, p = who[gone], at[gone]
                first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] > p[:-1] + size)]))
                last = np.append(first[1:], len(gone)) - 1
                out.append((ids[w[first]], keys[w[first]], lengths[w[first]], (p[last] + size - p[first]) << 32 | p[first]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], "left"))  # the last bucket may go on in the next batch
            if held and held[-1].column("bucket")[-1].as_py() != bucket[0] and sum(x.num_rows for x in held) >= rows_at_once:
                yield from settled(pa.Table.from_batches(held, _SCHEMA))
                held = []
            if cut and sum(x.num_rows for x in held) + cut >= rows_at_once:
                yield from settled(pa.Table.from_batches([*held, batch.slice(0, cut)], _SCHEMA))
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from settled(pa.Table.from_batches(held, _SCHEMA))

    return run


def repeats(docs: DataFrame, unit: str, size: int, prefilter: bool) -> DataFrame:
    """Per document (id, key, bytes) with any repeat: `spans`, an array of runs of units to remove, each n * 2**32 + pos."""
    source = docs.select("id", "key", "bytes", "text").where(F.col("bytes") >= (2 * size - 1 if unit == "word" else size - 1))
    sketch = sketching.repeated_in_text(source, lambda flat, offsets: _windows(flat, offsets, unit, size, whole=False)[0], 6) if prefilter else None
    rows = source.mapInArrow(_emit(unit, size, sketch), ROWS)
    late = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle(size), "id long, key long, bytes long, span long")
    return late.groupBy("id", "key", F.col("bytes").cast("int").alias("bytes")).agg(F.collect_set("span").alias("spans"))  # repeated rows of several batches find the same


def _cut(unit: str, joiner: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = tx.bytes_of(batch.column("text"))
            spans = batch.column("spans")
            kept, total, removed = [], [], []
            for a, b in tx.chunks(offsets):
                part, off = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, owner = UNITS[unit](part, off)
                first = np.searchsorted(owner, np.arange(b - a + 1))
                data = part.tobytes()
                for k in range(b - a):
                    s, e = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
                    out = np.zeros(len(s), bool)
                    if spans[a + k].is_valid:
                        x = spans[a + k].values.to_numpy(zero_copy_only=False)
                        pos = x & _LOW
                        out = tx.covered(pos, pos + (x >> 32), len(s))
                    left = np.flatnonzero(~out)
                    kept.append(joiner.join([data[i:j] for i, j in zip(s[left].tolist(), e[left].tolist())]))
                    total.append(len(s))
                    removed.append(len(s) - len(left))
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_units", "n_removed", "kept"])

    return run


def remove_repeated_windows(docs: DataFrame, unit: str, size: int, prefilter: bool, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` (the input row, or its columns in `carry`), `n_units`, `n_removed`, `kept` (the units left, joined by a space or \\n)."""
    base = keyed(docs, id_col, text_col, carry)
    late = repeats(base, unit, size, prefilter)
    joined = base.join(late, ["id", "key", "bytes"], "left").select("row", "text", "spans")
    schema = T.StructType([joined.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_units", "n_removed")), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_cut(unit, b" " if unit == "word" else b"\n"), schema)
