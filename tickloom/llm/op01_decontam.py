"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (ASCII letters folded to lower case); similarity of
an item of m words to a stretch of text is 1 - edits / m, over word edits.

CGK embedding: a walk reads a word, writes it, and moves on if a random bit of
(word, step) is set. Walks over two texts that differ by few edits fall back
into step, so edit distance becomes Hamming distance. Bit sampling then takes
`SAMPLED` written words at random steps as a key; `repetitions` independent
walks bring recall to the target. Windows start at every `STRIDE`-th word; each
item is embedded from up to `BLOCKS` runs of `STRIDE` words, spread over all of
it, so one of each run is in line with any copy. Window lengths follow the item's size in classes (`SIZES`); a walk is
shared by all classes, since a shorter window reads a prefix of it.

Target: `RECALL` of the stretches at the least similarity that is allowed. The
number of repetitions follows from it and from `MISSED`, what one repetition misses.

Short items have few windows. Under `PIECED` words they are embedded too, and
besides looked up without chance: with k edits allowed, one of k + 1 pieces of
the item stands unchanged in any match, so pieces are looked up at every word.
Items under `SIZES[0]` words have no window, and pieces only.

Candidates pass bounds that lose none (a match within k edits has m - k of the
item's words nearby; counted for all candidates at once by a few bits of each
word, then exactly for those that are left), then the exact edit distance of the item to the best
stretch of text around the window decides.

Items travel to the tasks as key tables, in slices of at most `SLICE_ITEMS`, so
what is broadcast at once is bounded; more items mean more passes. Documents are
neither shuffled nor grouped: hits are found where the text is read.

Defined cases: null or empty texts and items without words have no hits; items
of one to four words must occur as they are; repeated rows each have their own; null ids pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import text as tx
from tickloom.llm.tables import keyed

SIMILARITY, STRIDE, SAMPLED = 0.8, 8, 3
SIZES = (8, 12, 18, 27, 40)
PIECED, BLOCKS, SLICE_ITEMS, MEMBERS = 25, 8, 5000, 4096
#: What is aimed at, and the share of copies that one repetition more leaves unfound: at 25 words with 20 % edits, the worst size without pieces, 1, 2, 4, 6 and 8 repetitions missed 82, 33, 12, 4 and 3 of 300 copies.
RECALL, MISSED = 0.99, 0.55


def repetitions_for(recall: float) -> int:
    return max(1, ceil(log(1 - recall) / log(MISSED)))


REPETITIONS = repetitions_for(RECALL)
_BASE = 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_ids(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id and the row of each word, letters A-Z folded."""
    lower = _LOWER[flat]
    starts, ends, owner = tx.words(lower, offsets)
    return tx.span_hash(lower, starts, ends, 2), owner


def plan(repetitions: int = REPETITIONS, sampled: int = SAMPLED, sizes: tuple[int, ...] = SIZES) -> list[list[np.ndarray]]:
    """For each repetition and size class, the steps of the walk that are sampled."""
    draw = np.random.default_rng(20240101)
    return [[np.sort(draw.choice(2 * n, sampled, replace=False)) for n in sizes] for _ in range(repetitions)]


def keys(ids: np.ndarray, at: np.ndarray, end: np.ndarray, repetition: int, steps: list[np.ndarray], room: np.ndarray | None = None) -> list[np.ndarray]:
    """For each size class, the sampled key of the walk from each word `at`; `ids` has one more word, which ends all texts."""
    first, second = tx.mix(ids, 100 + 2 * repetition), tx.mix(ids, 101 + 2 * repetition)
    pos = at.astype(np.int32)
    stop = end.astype(np.int32)
    out = [np.zeros(len(at), np.uint64) for _ in steps]
    wanted: dict[int, list[int]] = {}
    for c, chosen in enumerate(steps):
        for s in chosen.tolist():
            wanted.setdefault(s, []).append(c)
    with np.errstate(over="ignore"):
        for t in range(max(wanted) + 1):
            word = first[pos] if t < 64 else second[pos]
            for c in wanted.get(t, ()):
                out[c] = out[c] * np.uint64(0x9E3779B97F4A7C15) + word
            pos = np.minimum(pos + (word >> np.uint64(t % 64) & np.uint64(1)).astype(np.int32), stop)
    return [tx.mix(k, c) for c, k in enumerate(out)]


def size_class(n: int) -> int:
    return int(np.searchsorted(SIZES, n, "right")) - 1


def offsets_of(n: int) -> np.ndarray:
    """The words from which an item of n words is embedded."""
    last = n - SIZES[0] - STRIDE + 1
    begin = np.linspace(0, max(last, 0), min(BLOCKS, max(1, -(-(last + STRIDE) // STRIDE)))).astype(np.int64)
    off = np.unique(begin[:, None] + np.arange(STRIDE))
    return off[off <= n - SIZES[0]]


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of the most + 1 pieces of an item of n words."""
    cut = [n * k // (most + 1) for k in range(most + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def paired(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into `key` and the sorted `table` of all equal pairs."""
    lo = np.searchsorted(table, key)
    hit = np.flatnonzero(table[np.minimum(lo, len(table) - 1)] == key)
    lo, hi = lo[hit], np.searchsorted(table, key[hit], "right")
    n = hi - lo
    return np.repeat(hit, n), np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Items:
    """Key tables of a slice of the benchmark: per repetition and class, sorted keys with item and offset; and per length of pieces."""

    def __init__(self, item_ids: list[int], texts: list[str | None], similarity: float = SIMILARITY, repetitions: int = REPETITIONS):
        self.words, self.item_ids, self.most, self.counts = [], [], [], []
        for i, text in zip(item_ids, texts):
            data = np.frombuffer((text or "").encode(), np.uint8)
            ids, _ = word_ids(data, np.array([0, len(data)]))
            if len(ids):
                self.words.append(ids)
                self.item_ids.append(i)
                self.counts.append(np.unique(ids, return_counts=True))
                self.most.append(int(np.floor(len(ids) * (1 - similarity) + 1e-9)))
        self.size, self.edits = np.array([len(w) for w in self.words], np.int64), np.array(self.most, np.int64)
        self.steps = plan(repetitions)
        self.tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (ids, most) in enumerate(zip(self.words, self.most)):
            if len(ids) < PIECED:  # beside the walks, which may miss a short item
                for off, n in pieces_of(len(ids), most):
                    found.setdefault(n, []).append((int(tx.rolling(ids[off : off + n], n, _BASE)[0]), k, off))
        for n, rows in found.items():
            rows.sort()
            self.pieces[n] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], np.int32)
        if all(len(w) < SIZES[0] for w in self.words):
            return
        size = self.size
        begin = np.cumsum(size) - size
        ids = np.append(np.concatenate(self.words), np.uint64(0))
        each = [offsets_of(n) if n >= SIZES[0] else np.zeros(0, np.int64) for n in size.tolist()]
        who, off = np.repeat(np.arange(len(size)), [len(x) for x in each]), np.concatenate(each)
        cls = np.searchsorted(SIZES, size[who] - off, "right") - 1
        # the sentinel behind the last word of all stands in for every item's end
        for r, steps in enumerate(self.steps):
            per = keys(ids, begin[who] + off, begin[who] + size[who], r, steps)
            row = []
            for c in range(len(SIZES)):
                mine = np.flatnonzero(cls == c)
                order = mine[np.argsort(per[c][mine], kind="stable")]
                row.append((per[c][order], who[order].astype(np.int32), off[order].astype(np.int32)))
            self.tables.append(row)


    @cached_property
    def members(self) -> np.ndarray:
        """By item, whether one of its words ends in these bits; made where it is used, not sent."""
        out = np.zeros((len(self.words), MEMBERS), bool)
        for k, ids in enumerate(self.words):
            out[k, (ids & np.uint64(MEMBERS - 1)).astype(np.int64)] = True
        return out


def best_stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least word edits of `item` to any stretch of `region`, and where that stretch ends (exact, free ends)."""
    n = len(region)
    steps = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, word in enumerate(item.tolist()):
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def find(items: Items, flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, end word) of the best stretch of each run of candidates within an item's length, in a chunk of texts.

    Copies that follow one another within an item's length are one run, so one hit: hits count runs, not copies.
    """
    ids, owner = word_ids(flat, offsets)
    if not len(ids) or not items.words:
        return []
    n_rows = len(offsets) - 1
    first = np.searchsorted(owner, np.arange(n_rows + 1))
    ids = np.append(ids, np.uint64(0))
    place = np.arange(len(owner)) - first[owner]
    at = np.flatnonzero((place % STRIDE == 0) & (first[owner + 1] - np.arange(len(owner)) >= SIZES[0]))
    stop = first[owner[at] + 1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n, (table, who, off) in items.pieces.items():
        start, pick = paired(table, tx.rolling(ids[:-1], n, _BASE))
        inside = owner[start] == owner[start + n - 1]
        start, pick = start[inside], pick[inside]
        found.append((owner[start], who[pick], start - off[pick]))
    for r, tables in enumerate(items.tables if len(at) else ()):
        for c, key in enumerate(keys(ids, at, stop, r, items.steps[r])):
            table, who, off = tables[c]
            if not len(table):
                continue
            hit, pick = paired(table, key)
            start = at[hit]
            found.append((owner[start], who[pick], start - off[pick]))
    row, item, begin = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((begin, item, row))
    row, item, begin = row[order], item[order], begin[order]
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0) | (np.diff(begin, prepend=0) > items.size[item]))
    until = begin[np.append(new[1:], len(begin)) - 1] if len(new) else begin
    row, item, begin = row[new], item[new], begin[new]  # runs of candidates, from `begin` to `until`
    most = items.edits[item]
    lo = np.maximum(begin - most, first[row])
    hi = np.minimum(until + items.size[item] + most, first[row + 1])
    hits = []
    for q in likely(items, ids, lo, hi, item).tolist():
        k, region = int(item[q]), ids[lo[q] : hi[q]]
        if shared_words(region, items.counts[k]) >= len(items.words[k]) - items.most[k]:
            edits, end = best_stretch(items.words[k], region)
            if edits <= items.most[k]:
                hits.append((int(row[q]), k, edits, int(lo[q] + end - first[row[q]])))
    return hits


def likely(items: Items, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """The regions ids[lo:hi] that may share enough words with their item: words of theirs that are the item's, by `items.members`, repeats included, so never too few."""
    out = []
    for k in range(0, len(lo), at_once):
        a, n, i = lo[k : k + at_once], np.maximum(hi[k : k + at_once] - lo[k : k + at_once], 0), item[k : k + at_once]
        edge = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(a - edge[:-1], n) + np.arange(edge[-1])
        total = np.concatenate([[0], np.cumsum(items.members[np.repeat(i, n), (ids[place] & np.uint64(MEMBERS - 1)).astype(np.int64)])])
        out.append(k + np.flatnonzero(total[edge[1:]] - total[edge[:-1]] >= items.size[i] - items.edits[i]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def shared_words(region: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> int:
    """How many of the item's words the region has, each at most as often as the item: at least m - edits for a match."""
    words, often = counts
    at = np.minimum(np.searchsorted(words, region), len(words) - 1)
    return int(np.minimum(np.bincount(at[words[at] == region], minlength=len(words)), often).sum())


_HITS = pa.schema([("item_id", pa.int64()), ("edits", pa.int32()), ("end_word", pa.int32())])


def _search(items, slim: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = items.value
        for batch in batches:
            flat, offsets = tx.bytes_of(batch.column("text"))
            out = []
            for a, b in tx.chunks(offsets):
                out += [(r + a, table.item_ids[k], e, end) for r, k, e, end in find(table, flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            lists: list[list[dict]] = [[] for _ in range(len(batch))]
            for r, k, e, end in sorted(out, key=lambda x: (x[0], x[3], x[1])):
                lists[r].append({"item_id": k, "edits": e, "end_word": end})
            take = [r for r in range(len(batch)) if lists[r]] if slim else range(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(take, pa.int64())) if slim else batch.column("row"), pa.array([lists[r] for r in take], pa.list_(pa.struct(_HITS)))], names=["row", "hits"])

    return run


def search(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, repetitions: int = REPETITIONS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` (the input row, or its columns in `carry`) and `hits` (item_id, edits, end_word) of each document with a hit."""
    spark = docs.sparkSession
    names = carry or docs.columns
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("hits", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("end_word", T.IntegerType())])))])
    out = None
    for part in slices(benchmark):
        items = spark.sparkContext.broadcast(Items([r[0] for r in part], [r[1] for r in part], similarity, repetitions))
        hits = source.mapInArrow(_search(items, True), schema)
        out = hits if out is None else out.union(hits)
    return out if out is not None else spark.createDataFrame([], schema)


def slices(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark in runs of at most SLICE_ITEMS items, read one after the other."""
    part = []
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        part.append((r[0], r[1]))
        if len(part) == SLICE_ITEMS:
            yield part
            part = []
    if part:
        yield part


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit; all their columns as they are."""
    spark = docs.sparkSession
    fields = docs.schema.fields
    for part in slices(benchmark):  # each pass keeps what its slice doesn't hit
        items = spark.sparkContext.broadcast(Items([r[0] for r in part], [r[1] for r in part], **options))
        source = keyed(docs).select("row", "text")
        schema = T.StructType([source.schema["row"], T.StructField("hits", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("end_word", T.IntegerType())])))])
        docs = source.mapInArrow(_search(items, False), schema).where(F.size("hits") == 0).select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in fields])
    return docs


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, n_hits (runs of adjacent copies count once), least edits."""
    found = search(docs, benchmark, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), F.explode("hits").alias("h"))
    return found.groupBy("doc_id", F.col("h.item_id").alias("item_id")).agg(F.count("*").alias("n_hits"), F.min("h.edits").alias("edits"))
