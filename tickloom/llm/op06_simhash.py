"""SimHash near-dedup by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint maps to the bit counts of its segments. Counts differ in
Manhattan distance by at most the Hamming distance, so fingerprints within 2
bits lie in grid cells within 2 steps, and both are within one step of some
cell. Each distinct fingerprint therefore stands in its own cell and in those one
step away (two a segment), and one exchange by cell serves both sides of the
join, whose condition compares the fingerprints themselves. Segments are as many
as make rows and expected candidates least (`segments`): more, and finer, as
fingerprints grow in number, since candidates grow with their square. Cells are
hashed to 64 bits; a clash adds a candidate, which the comparison drops. Exact
copies collapse to one fingerprint before, and a fingerprint has at most 2080
others within 2 bits, so no group makes more than a fixed number of links a
fingerprint.

Components come from iterated star steps on fingerprints, as numbers; the
smallest doc_id of a component is a minimum with map-side partial aggregation.

Defined cases: null text or a text without words has fingerprint zero, linked
like any other; fewer words than a shingle: the whole sequence is one shingle;
null doc_id rows get a fingerprint and a component like others (component_id is
null only if every member's id is null); repeated rows are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import text as tx
from tickloom.llm.components import components
from tickloom.llm.tables import NULL_ID, checkpointed, keyed

SHINGLE, MAX_BITS = 3, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(batch_text: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """uint64 SimHash of each row: bit set if set in over half of the shingles' XXH64 (seed 42)."""
    flat, offsets = tx.bytes_of(batch_text)
    out = np.zeros(len(batch_text), np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in tx.chunks(offsets, 1 << 20):
        hashes, counts = [], np.zeros(b - a, np.int64)
        lower = _LOWER[flat[offsets[a] : offsets[b]]]
        off = offsets[a : b + 1] - offsets[a]
        starts, ends, owner = tx.words(lower, off)
        if not len(starts):
            continue
        # words of a row joined by one space: copied once into a compact buffer
        length = ends - starts
        begin = np.concatenate([[0], np.cumsum(length + 1)])
        compact = np.full(int(begin[-1]), 32, np.uint8)
        shift = np.repeat(begin[:-1] - starts, length)
        source = np.arange(int(length.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        compact[source + shift] = lower[source]
        data, stop = compact.tobytes(), begin[1:] - 1
        n_words = np.bincount(owner, minlength=b - a)
        first = np.concatenate([[0], np.cumsum(n_words)])
        lead = np.flatnonzero(np.arange(len(starts)) + shingle <= first[owner + 1])
        short = np.flatnonzero((n_words > 0) & (n_words < shingle))
        s = np.concatenate([begin[lead], begin[first[short]]])
        e = np.concatenate([stop[lead + shingle - 1], stop[first[short + 1] - 1]])
        who = np.concatenate([owner[lead], short])
        hashes = np.fromiter((digest(data[i:j], 42) for i, j in zip(s.tolist(), e.tolist())), np.uint64, len(s))
        order = np.argsort(who, kind="stable")
        hashes, who = hashes[order], who[order]
        counts = np.bincount(who, minlength=b - a)
        rows = np.flatnonzero(counts)
        edge = np.concatenate([[0], np.cumsum(counts[rows])])
        for k in range(64):
            ones = np.concatenate([[0], np.cumsum(hashes >> np.uint64(k) & np.uint64(1), dtype=np.int64)])
            out[a + rows] |= ((ones[edge[1:]] - ones[edge[:-1]]) * 2 > counts[rows]).astype(np.uint64) << np.uint64(k)
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, key, fp): a hash of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(fingerprints(batch.column("text"), shingle).view(np.int64))], names=["id", "key", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, T.StructType([source.schema["id"], T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())]))


def segments(n: int) -> list[int]:
    """Lengths in bits of the segments, 64 in all: the number of them that makes rows and expected candidates least for n spread fingerprints."""

    def lengths(k: int) -> list[int]:
        return [64 * (i + 1) // k - 64 * i // k for i in range(k)]

    def cost(k: int) -> float:
        same = prod(comb(2 * m, m) / 4**m for m in lengths(k))  # how likely two fingerprints have equal counts
        return n * (1 + 2 * k) + n**2 * same * (1 + 2 * k) ** 2

    return lengths(min(range(8, 65, 4), key=cost))


def cells(fp: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The hashed cell of each fingerprint and those one step away, a row each."""
    factor = tx.mix(np.arange(len(lengths), dtype=np.uint64), 31) | np.uint64(1)
    own, at = np.zeros(len(fp), np.uint64), 0
    with np.errstate(over="ignore"):
        for k, m in enumerate(lengths):
            own += np.bitwise_count(fp >> np.uint64(at) & np.uint64((1 << m) - 1)).astype(np.uint64) * factor[k]
            at += m
        step = np.concatenate([np.zeros(1, np.uint64), factor, np.uint64(0) - factor])
        return own[:, None] + step


def links(fps: DataFrame, reach: int = MAX_BITS) -> DataFrame:
    """(u, v), u < v: pairs of distinct fingerprints within `reach` bits, from a DataFrame of distinct `fp`; some come twice or more."""
    if reach > MAX_BITS:
        raise ValueError(f"the grid looks {MAX_BITS} bits far at most")
    lengths = segments(fps.count())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                grid = cells(part.view(np.uint64), lengths)
                yield pa.RecordBatch.from_arrays([pa.array(grid.ravel().view(np.int64)), pa.array(np.repeat(part, grid.shape[1]))], names=["cell", "fp"])

    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    grid = spread.mapInArrow(placed, "cell long, fp long")
    a, b = grid.select("cell", F.col("fp").alias("u")), grid.select(F.col("cell").alias("_cell"), F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= reach)
    # merged, never sent whole: the planner takes mapInArrow to make as many rows as it reads, here 25 to 33 times too few
    return a.hint("merge").join(b, (F.col("cell") == F.col("_cell")) & near).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = MAX_BITS) -> DataFrame:
    """(id, key, fp, root, component_id) for every document; root is the component's least fingerprint."""
    marked = checkpointed(with_fingerprint(docs, id_col, text_col))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), reach))
    member = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = MAX_BITS) -> DataFrame:
    """One document of each component, that of the smallest id (null ids only where all are null); all columns as they are.

    Of rows that share that id within a component, the one of the least text hash stays, once.
    """
    found = near_duplicates(docs, id_col, text_col, reach)
    own = found.where(F.col("id").eqNullSafe(F.col("component_id")))
    firsts = own.groupBy(F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("id"), "root").agg(F.min("key").alias("key")).select("id", "key").distinct()
    rows = keyed(docs, id_col, text_col).select("id", "key", "row").join(firsts, ["id", "key"], "left_semi")
    one = Window.partitionBy("id", "key").orderBy(F.xxhash64("row"))
    return rows.withColumn("place", F.row_number().over(one)).where("place = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
