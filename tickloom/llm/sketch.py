"""A count-min sketch of 64-bit hashes over a whole table, merged from partition sketches.

Every task packs the cells its rows touch (one byte a gap, in segments of 2**16
cells); segments are dealt out, added up with saturation at two, and come back
as bitmaps of the cells that reach two. Estimates are never too low, so a hash
that occurs twice always tests positive. Width follows the input up to
2**MAX_BITS cells a row, which bounds the broadcast at 2 * 2**MAX_BITS bits.
With `mapped`, workers map the bitmaps from the file of the broadcast, so those
of an executor share its pages and hold no copies; else the file is compressed,
which takes less disk, and each worker unpacks it.
"""

from __future__ import annotations

import mmap
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import text as tx

#: PARTS: partitions of merged bitmaps at most (4 MB each at MAX_BITS), which come to the driver one by one, a job each.
MIN_BITS, MAX_BITS, SEGMENT, PARTS = 20, 29, 16, 32


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in the two rows of the sketch."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (tx.mix(h, 3) >> np.uint64(64 - bits)).astype(np.int64)


def pack(found: np.ndarray) -> bytes:
    """Sorted distinct cells as one byte a gap; 255 stands for a step of 255 without a cell."""
    gaps = np.diff(found, prepend=-1) - 1
    steps = gaps // 255
    out = np.full(int(steps.sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(steps + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint8).astype(np.int64)
    hit = step != 255
    return (np.cumsum(step) + np.cumsum(hit) - 1)[hit]


def _fill(hasher: Callable, bits: int):
    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Sketch._open.clear()  # a process that is used again holds one of an earlier query
        for batch in batches:
            found: list[list[np.ndarray]] = [[], []]
            for h in hasher(batch):
                for k, c in enumerate(cells(h, bits)):
                    found[k].append(c.astype(np.uint32))
            for k in (0, 1):
                c = np.concatenate(found[k]) if found[k] else np.zeros(0, np.uint32)
                found[k] = []
                c.sort()
                new = np.ones(len(c) + 1, bool)
                np.not_equal(c[1:], c[:-1], out=new[1:-1])
                many, c = ~new[1:][new[:-1]], c[new[:-1]]  # cells that two or more hashes touch, and all cells
                part = c >> SEGMENT
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(c) else []
                out = []
                for i, j in zip(cut, np.append(cut[1:], len(c)).astype(np.int64)):
                    low = (c[i:j] & ((1 << SEGMENT) - 1)).astype(np.int64)
                    out.append((int(part[i]) * 2 + k, pack(low[~many[i:j]]), pack(low[many[i:j]])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, once, more in zip(*(c.to_pylist() for c in batch.columns)):
            have = count.setdefault(segment, np.zeros(1 << SEGMENT, np.uint8))
            for data, add in ((once, 1), (more, 2)):
                c = unpack(data)
                have[c] = np.minimum(have[c] + add, 2)
    for segment, have in count.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(have > 1).tobytes()], pa.binary())], names=["segment", "bitmap"])


def repeated_in_text(source: DataFrame, hasher: Callable, bytes_per_hash: int, chunk: int = tx.CHUNK_BYTES, mapped: bool = False):
    """The sketch of the hashes that `hasher(flat, offsets)` gives over `source.text`, `chunk` bytes at a time."""
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        flat, offsets = tx.bytes_of(batch.column(0))
        for a, b in tx.chunks(offsets, chunk):
            yield hasher(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    return _repeated(source.select("text"), hashes, total / bytes_per_hash, mapped)


def repeated_in_column(hashes: DataFrame, mapped: bool = False):
    """The same for a DataFrame of one column of hashes (long)."""
    return _repeated(hashes, lambda batch: [batch.column(0).to_numpy().view(np.uint64)], hashes.count(), mapped)


def _repeated(source: DataFrame, hasher: Callable, n_hashes: float, mapped: bool):
    spark = source.sparkSession
    bits = min(MAX_BITS, max(MIN_BITS, int(np.ceil(np.log2(max(1, n_hashes) * 2)))))
    filled = source.mapInArrow(tx.released(_fill(hasher, bits)), "segment int, once binary, more binary")
    merged = filled.repartition(min(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))), "segment").mapInArrow(_merge, "segment int, bitmap binary")
    number = uuid.uuid4()
    data = bytearray(number.bytes + bytes(2 * (1 << bits) // 8))  # the number tells where in a file of the broadcast the bitmaps begin
    maps = np.frombuffer(data, np.uint8, offset=len(number.bytes)).reshape(2, -1)
    width = (1 << SEGMENT) // 8
    for r in merged.toLocalIterator():
        at = (r.segment // 2) * width
        maps[r.segment % 2, at : at + width] = np.frombuffer(r.bitmap, np.uint8)
    return Sketch(spark.sparkContext.broadcast(data if mapped else zlib.compress(data, 1)), bits, number.bytes, mapped)


class Sketch:
    """The merged bitmaps; sent to the executors once, mapped or unpacked in each worker process."""

    _open: dict[bytes, np.ndarray] = {}

    def __init__(self, sent, bits: int, number: bytes, mapped: bool):
        self.sent, self.bits, self.number, self.mapped = sent, bits, number, mapped

    def maps(self) -> np.ndarray:
        if self.number not in Sketch._open:
            Sketch._open.clear()  # one at a time
            if not self.mapped:
                data = zlib.decompress(self.sent.value)
            elif (data := self._mapped()) is None:
                data = self.sent.value
            Sketch._open[self.number] = np.frombuffer(data, np.uint8, 2 * (1 << self.bits) // 8, data.find(self.number) + len(self.number)).reshape(2, -1)
        return Sketch._open[self.number]

    def _mapped(self) -> mmap.mmap | None:
        """The broadcast's file, pages of which are read as they are needed; None where there is none in plain (Spark's encryption)."""
        if (path := getattr(self.sent, "_path", None)) is None:
            return None
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        return data if data.find(self.number, 0, 256) >= 0 else None


def hits(sketch: Sketch, h: np.ndarray) -> np.ndarray:
    """Indices of the hashes estimated to occur twice or more."""
    maps, (c0, c1) = sketch.maps(), cells(h, sketch.bits)
    on = lambda m, c: (m[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    keep = np.flatnonzero(on(maps[0], c0))
    return keep[on(maps[1], c1[keep])]
