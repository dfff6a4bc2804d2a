"""Quality rules: text statistics, and perplexity under a language's own n-gram model.

Model. Byte 4-grams of all texts are counted in Spark, per language; continuation
counts of the shorter orders, modified Kneser-Ney discounts and interpolated
probabilities follow as DataFrame aggregations over the distinct n-grams (an
n-gram's context has at most 256 continuations, so no group is large). Tasks hash
the longest n-grams with their language; what is scored is what was counted, so
they are all that scoring looks up, and shorter orders live on in their
probabilities. Tasks get them as a sorted array of hashes beside an array of
bits in fixed point, in slices of the hash space of about `SLICE_ROWS` entries,
so that what the driver and a task hold is bounded at any size: each slice is
one pass over the texts, and sums of whole numbers are the same however the
model is sliced. At 12 bytes an entry, one slice is 72 MB.

Verdict. Bits per word and bits per byte of each text are held against bands of
its language: the median of all distinct texts of `MIN_WORDS` words or more, less
`BELOW` or plus `ABOVE` robust deviations (exact quartile distance / 1.349, `LEAST` at
least), more for shorter texts. Above or below is rejected. Copies count once in the
bands, but each in the model, where they make their own text predictable: a text
that is there twice or more and holds a hundredth of its language's words
(`COPIED`, so at most a hundred texts) isn't rejected for being below.

Defined cases: null text is empty (no words, so the base rules fail); null lang
is a language of its own; repeated rows count and score each; a language whose
texts are all short has no band, and its texts pass the perplexity rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import text as tx
from tickloom.llm.tables import checkpointed, stored
from tickloom.operators.quantiles import quantiles

ORDER, MIN_WORDS, MAX_REPEAT_PERCENT = 4, 50, 50
#: Of the labelled texts at sf0.1 that pass the base rule, 5 above rejects 215 of 291 junk ones and 15 of 3,243 clean ones (8: 148 and 6; 4: 245 and 22). Below, either 5 or 8 rejects none.
ABOVE, BELOW = 5.0, 8.0
#: About half the least deviation of any language at sf0.1 (0.40 and 0.028 bits).
LEAST = {"word_bits": 0.2, "byte_bits": 0.015}
COPIED = 0.01
SLICE_ROWS, POINT = 6_000_000, 1 << 24
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of STATS for the rows of a chunk."""
    n = len(offsets) - 1
    starts, ends, owner = tx.words(flat, offsets)
    first = np.searchsorted(owner, np.arange(n + 1))
    points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[flat])])
    breaks = np.flatnonzero(flat == 10)
    ls = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    le = np.sort(np.concatenate([breaks, offsets[1:]]))
    lo = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]))
    filled = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, lo = ls[filled], le[filled], lo[filled]
    dup_lines = np.bincount(lo[_again(tx.span_hash(flat, ls, le, 4), lo)[0]], minlength=n)
    repeat = np.zeros(n, np.int64)
    m = len(starts) - 2
    if m > 0:
        ids = tx.span_hash(flat, starts, ends, 3)
        at = np.flatnonzero(owner[:m] == owner[2:])
        later, any_ = _again(tx.rolling(ids, 3, 0xD6E8FEB86659FD93)[at], owner[at])
        cover = np.zeros(len(starts), bool)
        for k in range(3):
            cover[at[any_] + k] = True
        repeat = np.bincount(owner[cover], minlength=n)
    return [np.diff(first), in_words[first[1:]] - in_words[first[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], dup_lines, repeat]


def _again(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of hashes seen before in the same row, and of hashes found twice or more in it."""
    with np.errstate(over="ignore"):
        h = h ^ tx.mix(owner.astype(np.uint64), 9)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    later = order[1:][same]
    both = np.zeros(len(h) + 1, bool)
    both[1:-1] |= same
    both[:-2] |= same
    return later, order[both[:-1]]


def byte_grams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams (as uint32, big end first) that end at each byte of each row and at its end; rows begin behind NULs. And row starts."""
    n = len(offsets) - 1
    begin = offsets + (ORDER - 1) * np.arange(n + 1)
    padded = np.zeros(int(begin[-1]) + ORDER - 1, np.uint32)
    padded[np.arange(len(flat)) + np.repeat((ORDER - 1) * np.arange(1, n + 1), np.diff(offsets))] = flat
    gram = np.zeros(int(begin[-1]), np.uint32)
    for k in range(ORDER):
        gram = (gram << np.uint32(8)) | padded[k : k + len(gram)]
    # the NULs between rows give grams that end in the next row's padding: all but the first of them are no predictions
    size = np.diff(offsets) + 1
    keep = np.repeat(begin[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return gram[keep], np.concatenate([[0], np.cumsum(size)])


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str | None, np.ndarray]]:
    lang = batch.column("lang").to_pylist()
    rows: dict[str | None, list[int]] = {}
    for i, x in enumerate(lang):
        rows.setdefault(x, []).append(i)
    for x, at in rows.items():
        yield x, np.array(at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for lang, at in _groups(batch):
            flat, offsets = tx.bytes_of(batch.column("text").take(pa.array(at)))
            for a, b in tx.chunks(offsets):
                gram, _ = byte_grams(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                gram.sort()
                new = np.flatnonzero(np.diff(gram, prepend=gram[:1] + np.uint32(1)) != 0)
                keys, n = gram[new], np.diff(np.append(new, len(gram)))
                if lang in held:
                    keys = np.concatenate([held[lang][0], keys])
                    order = np.argsort(keys, kind="stable")
                    keys, n = keys[order], np.concatenate([held[lang][1], n])[order]
                    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint32(1)) != 0)
                    keys, n = keys[new], np.add.reduceat(n, new)
                held[lang] = keys, n
    for lang, (keys, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts."""
    return docs.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _order(table: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """lang, gram, p, ctx and gamma (the weight its context leaves to the lower order), by modified Kneser-Ney."""
    c, by = F.col("n"), ["lang"]
    many = [F.count_if(c == k) for k in (1, 2, 3, 4)]
    y = F.try_divide(many[0], many[0] + 2 * many[1])
    usual = [F.try_divide(k * y * many[k], many[k - 1]) for k in (1, 2, 3)]
    cut = table.groupBy(*by).agg(*[F.greatest(F.lit(0.0), F.coalesce(k - (k + 1) / F.lit(float(k)) * usual[k - 1], F.lit(k / 2.0))).alias(f"d{k}") for k in (1, 2, 3)])
    context = Window.partitionBy("lang", "ctx")
    discount = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    t = table.withColumn("ctx", F.shiftright("gram", 8)).withColumnRenamed("lang", "_lang")
    t = t.join(cut, t["_lang"].eqNullSafe(cut["lang"])).drop("_lang")
    t = t.withColumn("d", F.least(discount, c.cast("double"))).withColumn("total", F.sum("n").over(context)).withColumn("gamma", F.sum("d").over(context) / F.col("total"))
    t = t.select("lang", "gram", "ctx", "gamma", ((c - F.col("d")) / F.col("total")).alias("own"))
    if lower is None:
        return t.select("lang", "gram", (F.col("own") + F.col("gamma") / 256).alias("p"), "ctx", "gamma")
    low = lower.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("p").alias("_p"))
    shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
    return t.join(low, t["lang"].eqNullSafe(low["_lang"]) & (shorter == low["_gram"])).select("lang", "gram", (F.col("own") + F.col("gamma") * F.col("_p")).alias("p"), "ctx", "gamma")


def kneser_ney(top: DataFrame) -> DataFrame:
    """Model rows (lang, ord, gram, p, ctx, gamma) of all orders from the counts of the longest n-grams."""
    tables = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    lower, out = None, None
    for k in range(1, ORDER + 1):
        lower = checkpointed(_order(tables[k], k, lower))
        rows = lower.select("lang", F.lit(k).alias("ord"), "gram", "p", "ctx", "gamma")
        out = rows if out is None else out.union(rows)
    return out


def lang_seed(lang: str | None) -> np.uint64:
    """A number of each language, null included, that goes into the hashes of its n-grams."""
    data = np.frombuffer(b"-" if lang is None else b"+" + lang.encode(), np.uint8)
    return tx.span_hash(data, np.array([0]), np.array([len(data)]), 6)[0]


def gram_hash(gram: np.ndarray, seed: np.uint64) -> np.ndarray:
    return tx.mix(gram.astype(np.uint64) ^ seed, 21)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each model row, and its bits in fixed point."""
    for batch in batches:
        h = np.zeros(len(batch), np.uint64)
        gram = batch.column("gram").to_numpy()
        for lang, at in _groups(batch):
            h[at] = gram_hash(gram[at], lang_seed(lang))
        bits = np.rint(np.minimum(-np.log2(batch.column("p").to_numpy()), 127.0) * POINT).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(bits)], names=["h", "bits"])


def slices(model: DataFrame, slice_rows: int = SLICE_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The model's longest order in slices of the hash space: sorted hashes, and bits in fixed point. One slice at a time is on the driver."""
    hashed = stored(model.where(F.col("ord") == ORDER).select("lang", "gram", "p").mapInArrow(_hashed, "h long, bits int"))
    count = max(1, -(-hashed.count() // slice_rows))
    number = F.pmod(F.shiftrightunsigned("h", 40), F.lit(count))
    for k in range(count):
        part = hashed.where(number == k).toArrow()
        h = part["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        yield h[order], part["bits"].to_numpy()[order]


def looked_up(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Bits of the hashes that the slice holds, 0 for others."""
    if not len(table[0]):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    return np.where(table[0][at] == h, table[1][at], 0).astype(np.int64)


def _score(model, with_stats: bool):
    """Bits of each text under a slice of the model, and (for one slice) its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            stats, bits, size = [np.zeros(n, np.int64) for _ in STATS], np.zeros(n, np.int64), np.zeros(n, np.int64)
            for lang, at in _groups(batch):
                seed = lang_seed(lang)
                flat, offsets = tx.bytes_of(batch.column("text").take(pa.array(at)))
                for a, b in tx.chunks(offsets):
                    part, off = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    if with_stats:
                        for k, values in enumerate(statistics(part, off)):
                            stats[k][at[a:b]] = values
                    size[at[a:b]] = np.diff(off) + 1
                    gram, begin = byte_grams(part, off)
                    bits[at[a:b]] = np.add.reduceat(looked_up(model.value, gram_hash(gram, seed)), begin[:-1])
            if with_stats:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("lang"), batch.column("key"), *map(pa.array, stats), pa.array(size), pa.array(bits)], names=["row", "lang", "key", *STATS, "n_coded", "bits"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array(size), pa.array(bits)], names=["lang", "key", "n_coded", "bits"])

    return run


def scored(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """`row` (the input row, or its columns in `carry`), `lang`, `key` (a hash of the text), the STATS, `base_failed`, `word_bits`, `byte_bits`.

    The first slice's pass gives the statistics and its part of the bits; parts
    of further slices are summed by text and joined to it.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    model = kneser_ney(checkpointed(counts(source)))
    context = docs.sparkSession.sparkContext
    coded = [source.schema["lang"], source.schema["key"]]
    sums = [T.StructField(c, T.LongType()) for c in ("n_coded", "bits")]
    out, more = None, None
    for number, table in enumerate(slices(model, slice_rows)):
        run = _score(context.broadcast(table), with_stats=out is None)
        if out is None:
            out = source.mapInArrow(run, T.StructType([source.schema["row"], *coded, *(T.StructField(c, T.LongType()) for c in STATS), *sums]))
        else:
            part = source.select("lang", "text", "key").mapInArrow(run, T.StructType([*coded, *sums])).withColumn("slice", F.lit(number))
            more = part if more is None else more.union(part)
    if more is not None:
        copies = more.groupBy("lang", "key", "n_coded", "slice").agg(F.min("bits").alias("bits"))  # equal texts have equal parts
        rest = copies.groupBy(F.col("lang").alias("_lang"), F.col("key").alias("_key"), F.col("n_coded").alias("_coded")).agg(F.sum("bits").alias("_bits"))
        same = (out["key"] == rest["_key"]) & (out["n_coded"] == rest["_coded"]) & out["lang"].eqNullSafe(rest["_lang"])
        out = out.join(rest, same, "left").withColumn("bits", F.col("bits") + F.col("_bits"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    bits = F.col("bits") / POINT
    return out.select("row", "lang", "key", *STATS, base.alias("base_failed"), F.try_divide(bits, F.col("n_words")).alias("word_bits"), (bits / F.col("n_coded")).alias("byte_bits"))


def bands(scores: DataFrame, above: float = ABOVE, below: float = BELOW) -> DataFrame:
    """Per language: the middle and the reach up and down of word_bits and byte_bits over its distinct texts, the words of a typical text, and the keys of the texts `copied` most."""
    columns = ("word_bits", "byte_bits", "n_words")
    texts = checkpointed(scores.where(F.col("n_words") >= MIN_WORDS).groupBy("lang", "key").agg(*[F.min(c).alias(c) for c in columns], F.count("*").alias("n")))
    each = texts.select("lang", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])))
    quarters = quantiles(each, "x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["lang", "name"]).groupBy(F.col("lang").alias("_of")).agg(*[F.max(F.when(F.col("name") == c, F.array("q1", "q2", "q3"))).alias(c) for c in columns])
    words = texts.groupBy("lang").agg(F.sum(F.col("n") * F.col("n_words")).alias("all_words"))
    found = words.join(quarters, words["lang"].eqNullSafe(quarters["_of"]))
    limits = [F.col("lang").alias("_lang"), F.col("n_words")[1].alias("typical_words"), "all_words"]
    for c in ("word_bits", "byte_bits"):
        q = [F.col(c)[k] for k in range(3)]
        deviation = F.greatest((q[2] - q[0]) / 1.349, F.lit(LEAST[c]))
        limits += [q[1].alias(f"{c}_middle"), (above * deviation).alias(f"{c}_up"), (below * deviation).alias(f"{c}_down")]
    found = checkpointed(found.select(*limits))  # a row a language
    often = texts.where("n > 1").join(F.broadcast(found), texts["lang"].eqNullSafe(found["_lang"])).where(F.col("n") * F.col("n_words") >= COPIED * F.col("all_words"))
    often = often.groupBy(F.col("lang").alias("_of")).agg(F.collect_list("key").alias("copied"))
    return found.join(often, found["_lang"].eqNullSafe(often["_of"]), "left").drop("_of", "all_words")


def verdict() -> Column:
    """Inside both bands; they widen for texts shorter than the typical one, as the deviation of a mean does. Copied texts have no lower bound."""
    inside, wider = F.lit(True), F.sqrt(F.greatest(F.lit(1.0), F.col("typical_words") / F.greatest("n_words", F.lit(1))))
    copied = F.coalesce(F.array_contains("copied", F.col("key")), F.lit(False))
    for c in ("word_bits", "byte_bits"):
        above = F.col(c) - F.col(f"{c}_middle")
        inside = inside & F.coalesce((above <= F.col(f"{c}_up") * wider) & (copied | (above >= -F.col(f"{c}_down") * wider)), F.lit(True))
    return ~F.col("base_failed") & inside


def judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    return scores.join(limits, scores["lang"].eqNullSafe(limits["_lang"]), "left").withColumn("kept", verdict()).drop("_lang")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, columns as they are. Texts are scored once: rows and scores are stored, for the bands and the verdict to read."""
    scores = stored(scored(docs, **options))
    limits = stored(bands(scores))
    return judged(scores, limits).where("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    scores = stored(scored(docs, carry=["doc_id"]))
    limits = stored(bands(scores))
    return judged(scores, limits).select(F.col("row.doc_id").alias("doc_id"), *STATS, "base_failed", "kept", "word_bits", "byte_bits")
