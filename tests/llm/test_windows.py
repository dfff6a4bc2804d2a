"""Repeated windows (words, lines, bytes) against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import op03_suffix, op05_substring, op09_lines, sketch, window_dedup
from tickloom.llm import text as tx

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def place(i):
    return (0, 0) if i is None else (1, i)


def brute(rows, units, size):
    """Per row: units and flags of the removed ones. Earlier means a smaller (id, start)."""
    first = {}
    split = [(i, units((t or "").encode())) for i, t in rows]
    for i, u in split:
        for k in range(len(u) - size + 1):
            w, at = tuple(u[k : k + size]), (place(i), k)
            first[w] = min(first.get(w, at), at)
    out = []
    for i, u in split:
        gone = [False] * len(u)
        for k in range(len(u) - size + 1):
            if first[tuple(u[k : k + size])] != (place(i), k):
                gone[k : k + size] = [True] * size
        out.append((i, u, gone))
    return out


def digest(found, join):
    return sorted(((place(i), len(u), sum(g), hashlib.sha256(join.join(x for x, y in zip(u, g) if not y)).hexdigest()) for i, u, g in found), key=str)


def byte_digest(rows):
    want = []
    for i, u, gone in brute(rows, lambda b: [b[k : k + 1] for k in range(len(b))], 100):
        runs = len(tx.runs(np.array(gone, bool))[0]) if u else 0
        want.append((place(i), len(u), sum(gone), runs, hashlib.sha256(b"".join(x for x, g in zip(u, gone) if not g)).hexdigest()))
    return sorted(want, key=str)


def collected(df):
    return sorted(((place(r[0]), *r[1:]) for r in df.collect()), key=str)


def lines(b):
    return b.split(b"\n") if b else []


def test_words(docs, rows):
    assert collected(op05_substring.digest(docs)) == digest(brute(rows, WORD.findall, 20), b" ")


def test_lines(docs, rows):
    assert collected(op09_lines.digest(docs)) == digest(brute(rows, lines, 3), b"\n")


def test_empty_lines_alone_are_a_window(spark):
    rows = [(1, "\n\n"), (2, "\n\n"), (3, "a\n\n\nb"), (4, "\n"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(op09_lines.digest(df)) == digest(brute(rows, lines, 3), b"\n")


@pytest.mark.parametrize("hot", [2000, 2])
def test_bytes(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(op03_suffix, "HOT", hot)
    assert collected(op03_suffix.digest(docs)) == byte_digest(rows)


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeat_groups_list_all_occurrences(docs, rows, hot, monkeypatch):
    """Each group is one string at all its places, and the groups hold every repeated string."""
    monkeypatch.setattr(op03_suffix, "HOT", hot)
    least = -(2**63)
    texts = {}
    for i, t in rows:
        texts.setdefault(least if i is None else i, []).append((t or "").encode())
    places = {}
    for i, many in texts.items():
        for t in many:
            for k in range(len(t) - 99):
                places.setdefault(t[k : k + 100], set()).add((i, k))
    groups = {}
    for g, n, i, k in op03_suffix.repeat_groups(docs).collect():
        groups.setdefault((g, n), set()).add((i, k))
    found = {}
    for (_, n), at in groups.items():
        shared = set.intersection(*({t[k : k + n] for t in texts[i] if len(t) >= k + n} for i, k in at))
        assert shared
        for s in range(n - 99):
            for i, k in at:
                for t in texts[i]:
                    found.setdefault(t[k + s : k + s + 100], set()).add((i, k + s))
    for string, at in places.items():
        if len(at) > 1:
            assert found.get(string) == at


def test_texts_whose_hashes_agree_in_half_the_bits(spark):
    """Of two texts with null ids and equal low halves of their hashes, only the one with repeats is cut."""
    text = lambda kind: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.substring(F.md5(F.concat_ws("-", F.lit(kind), "id", k).cast("binary")), 1, 6)), "\n")
    many = spark.range(150_000).select("id", text("a").alias("a"), text("b").alias("b"))
    low = lambda c: F.xxhash64(c).bitwiseAND(F.lit(2**32 - 1))
    a, b = many.select(low("a").alias("h"), "a"), many.select(low("b").alias("h"), "b")
    pairs = a.join(b, "h").select("a", "b").collect()
    assert pairs
    for with_repeats, without in pairs[:2]:
        rows = [(None, with_repeats), (None, without), (-5, with_repeats), (-6, with_repeats)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert collected(op05_substring.digest(df)) == digest(brute(rows, WORD.findall, 20), b" ")
        assert collected(op09_lines.digest(df)) == digest(brute(rows, lines, 3), b"\n")
        assert collected(op03_suffix.digest(df)) == byte_digest(rows)


def test_table_without_rows(docs):
    none = docs.where("false")
    assert op05_substring.digest(none).count() == op09_lines.digest(none).count() == op03_suffix.digest(none).count() == 0


def test_columns_pass_through(docs):
    cut = op09_lines.deduped_documents(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("text is null").count() == docs.where("text is null").count()
    assert cut.where("row <> 'r' or key <> 2 or id <> 3").count() == 0


def test_maximal_repeats_against_pairs():
    contexts = [b"xx" + b"abcdefgh" * 3 + b"1", b"yy" + b"abcdefgh" * 3 + b"2", b"z" + b"abcdefgh" * 2 + b"q"]
    found = {(n, frozenset(zip(r.tolist(), s.tolist()))) for n, r, s in op03_suffix.maximal_repeats(contexts, 10)}
    want = set()
    spots = [(r, s) for r, c in enumerate(contexts) for s in range(len(c) - 9)]
    for n in range(10, 30):
        groups = {}
        for r, s in spots:
            if s + n <= len(contexts[r]):
                groups.setdefault(contexts[r][s : s + n], set()).add((r, s))
        for text, at in groups.items():
            if len(at) > 1:
                left = {contexts[r][s - 1] if s else (r, "start") for r, s in at}
                right = {contexts[r][s + n] if s + n < len(contexts[r]) else (r, "end") for r, s in at}
                if len(left) > 1 and len(right) > 1:
                    want.add((n, frozenset(at)))
    assert found == want and want


def test_sketch_packing_and_no_lost_repeat(spark):
    r = np.random.default_rng(1)
    cells = np.unique(r.integers(0, 1 << 16, 900))
    assert (sketch.unpack(sketch.pack(cells)) == cells).all() and len(sketch.unpack(sketch.pack(cells[:0]))) == 0
    values = r.integers(-(2**62), 2**62, 3000)
    twice = np.concatenate([values, values[:500]])
    found = sketch.repeated_in_column(spark.createDataFrame([(int(v),) for v in twice], "h long").repartition(7))
    assert set(range(500)) <= set(sketch.hits(found, values.view(np.uint64)).tolist())


def test_long_spans_hash_like_short_ones():
    flat = np.frombuffer(b"q" + b"abc" * 5000 + b" " + b"abc" * 5000, np.uint8)
    h = tx.span_hash(flat, np.array([1, 15002]), np.array([15001, 30002]), 3)
    assert h[0] == h[1]
    assert window_dedup.line_units(np.frombuffer(b"a\n\nb", np.uint8), np.array([0, 0, 4]))[2].tolist() == [1, 1, 1]


def test_many_repeated_rows(spark):
    """2,000 rows of one text, with one id, none, or ids of their own: what is shuffled doesn't follow their number."""
    r = np.random.default_rng(4)
    text = "\n".join(" ".join(f"w{k}" for k in r.integers(0, 500, 12)) for _ in range(7))
    other = text.split("\n", 3)[3] + "\nand more\n" + "x " * 30
    for ids in ([None] * 2000, [7] * 2000, list(range(2000))):
        rows = [(i, text) for i in ids] + [(5000, other)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        few = list(dict.fromkeys(rows))
        for got, want in (
            (op05_substring.digest(df), digest(brute(few, WORD.findall, 20), b" ")),
            (op09_lines.digest(df), digest(brute(few, lines, 3), b"\n")),
            (op03_suffix.digest(df), byte_digest(few)),
        ):
            assert set(collected(got)) == set(want) and got.count() == 2001
        for unit, size in (("word", 20), ("line", 3)):
            emitted = window_dedup.keyed(df).select("id", "key", "bytes", "text").mapInArrow(window_dedup._emit(unit, size), window_dedup.ROWS)
            assert emitted.where("hashes is not null").count() < 200


def test_memory_of_sketching_and_ranking():
    """Bytes at once of a task, by the hash: 50 and 66 before."""
    import tracemalloc

    import numpy as np

    from tickloom.llm import sketch, window_dedup

    n = 3_000_000
    h = np.random.default_rng(1).integers(0, 2**62, n).astype(np.uint64)
    sketch.Sketch._open["earlier"] = np.zeros((2, 8), np.uint8)
    tracemalloc.start()
    list(sketch._fill(lambda batch: [h], 28)(iter([None])))
    assert tracemalloc.get_traced_memory()[1] < 35 * n and not sketch.Sketch._open
    tracemalloc.reset_peak()
    late = window_dedup._later(h, h.astype(np.uint32), h.view(np.int64), h.astype(np.int32))
    assert tracemalloc.get_traced_memory()[1] < 55 * n and not late.any()
    tracemalloc.stop()


def test_hashes_of_anchors_are_spread():
    """An anchor is the least of its neighbours; its hash must not be, or the sketch's first row holds them all in a small part."""
    flat = np.random.default_rng(2).integers(97, 123, 400_000).astype(np.uint8)
    offsets = np.arange(0, 400_001, 4000)
    whole = op03_suffix.anchors(flat, offsets)
    shares = np.bincount((whole[0] >> np.uint64(60)).astype(int), minlength=16) / len(whole[0])
    assert len(whole[0]) > 5000 and shares.min() > 0.05 and shares.max() < 0.075
    parts = [op03_suffix.anchors(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tx.chunks(offsets, op03_suffix.CHUNK)]
    assert len(parts) > 5 and (np.concatenate([p[0] for p in parts]) == whole[0]).all()  # however the text is cut into chunks


def test_released_passes_batches_on():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    assert list(tx.released(lambda some: (b for b in some if b["x"][0].as_py() != 1))(iter(batches))) == [batches[0], batches[2]]


def test_sketch_is_mapped_not_copied(spark, monkeypatch):
    """Bytes that a worker needs to open a sketch of 16 MB: 48 million before."""
    import tracemalloc

    monkeypatch.setattr(sketch, "MIN_BITS", 26)
    values = np.random.default_rng(3).integers(-(2**62), 2**62, 1000)
    found = sketch.repeated_in_column(spark.createDataFrame([(int(v),) for v in np.concatenate([values, values[:300]])], "h long"), mapped=True)
    tracemalloc.start()
    kept = sketch.hits(found, values.view(np.uint64))
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()
    assert kept.tolist() == list(range(300))
    monkeypatch.setattr(sketch.Sketch, "_mapped", lambda self: None)  # as where Spark encrypts the file
    sketch.Sketch._open.clear()
    assert (sketch.hits(found, values.view(np.uint64)) == kept).all()


def test_memory_of_scanning_a_shared_anchor():
    """2,000 contexts of one anchor: 126 MB at once before. What goes is checked string by string."""
    import tracemalloc

    import pyarrow as pa

    r, n = np.random.default_rng(1), 2000
    core, contexts = r.integers(97, 123, 180).astype(np.uint8), []
    for _ in range(n):
        c = core.copy()
        c[100 + r.integers(0, 80) :], c[: r.integers(0, 79)] = r.integers(97, 123, 2)
        contexts.append(c.tobytes())
    contexts = list(dict.fromkeys(contexts))
    n = len(contexts)
    again = np.flatnonzero(r.random(n) < 0.5)  # contexts that occur once more, later
    ids = np.concatenate([r.permutation(n), 10_000 + again])
    which = np.concatenate([np.arange(n), again])
    zero, first = np.zeros(len(ids), int), np.arange(len(ids)) < n
    columns = {"h": zero + 7, "h2": zero, "kind": (~first).astype(int), "c": which, "id": ids, "key": which, "bytes": zero + 180, "lo": zero, "n": zero + 180, "several": first & np.isin(which, again), "context": [contexts[k] if f else None for k, f in zip(which, first)]}
    batch = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns.values(), op03_suffix._PARTS)], schema=op03_suffix._PARTS)
    tracemalloc.start()
    out = list(op03_suffix._scan(100)(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 80_000_000
    tracemalloc.stop()
    got = {}
    for b in out:
        for i, s in zip(b["id"].to_pylist(), b["span"].to_pylist()):
            got.setdefault(i, np.zeros(180, bool))[s & op03_suffix._LOW : (s & op03_suffix._LOW) + (s >> 32)] = True
    seen = {}
    for k in np.argsort(ids):
        text, gone = contexts[which[k]], np.zeros(180, bool)
        for at in range(81):
            if seen.setdefault(text[at : at + 100], (ids[k], at)) != (ids[k], at):
                gone[at : at + 100] = True
        assert (got.get(ids[k], np.zeros(180, bool)) == gone).all()


def test_tasks_give_back_rows_in_pieces(monkeypatch):
    """A batch of texts isn't answered by one of all their contexts, which each side would hold whole."""
    import pyarrow as pa

    class Every:
        def maps(self):
            return np.full((2, 1 << 17), 255, np.uint8)

        bits = 20

    r = np.random.default_rng(5)
    texts = [r.integers(97, 123, 4000).astype(np.uint8).tobytes().decode() for _ in range(60)]
    ids = np.arange(len(texts))
    docs = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(np.full(len(texts), 4000, np.int32)), pa.array(texts)], names=["id", "key", "bytes", "text"])
    whole = pa.Table.from_batches(op03_suffix._contexts(Every(), 100, False)(iter([docs])))
    monkeypatch.setattr(op03_suffix, "PIECE", 500)
    rows = list(op03_suffix._contexts(Every(), 100, False)(iter([docs])))
    assert len(whole) > 5000 and max(b.num_rows for b in rows) <= 500 and pa.Table.from_batches(rows).equals(whole.combine_chunks())
    for hot in (False, True):
        wanted = [[{"h": h, "c": c, "at": at, "several": False, "hot": hot} for h, c, i, at in zip(*(whole[x].to_pylist() for x in ("h", "c", "id", "at"))) if i == k] for k in ids.tolist()]
        kind = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("at", pa.int64()), ("several", pa.bool_()), ("hot", pa.bool_())]))
        parts = list(op03_suffix._gathered(100, False)(iter([docs.append_column("wanted", pa.array(wanted, kind))])))
        assert max(b.num_rows for b in parts) <= 500
        for i, lo, n, text in zip(*(pa.Table.from_batches(parts)[x].to_pylist() for x in ("id", "lo", "n", "context"))):
            assert (text is None and n == 100) if hot else text.decode() == texts[i][lo : lo + n]
        assert sum(b.num_rows for b in parts) == (sum(x["at"] >> 32 for w in wanted for x in w) - 99 * len(whole) if hot else len(whole))


def test_merged_spans():
    span = lambda *rows: tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    merged = lambda *rows: list(zip(*(x.tolist() for x in op03_suffix._merged(*span(*rows)))))
    assert merged() == []
    assert merged((1, 5, 9), (0, 7, 9), (0, 0, 4), (0, 1, 3), (0, 4, 6), (1, 9, 9)) == [(0, 0, 6), (0, 7, 9), (1, 5, 9)]


def test_gathering_keeps_nothing():
    """A worker process stays for later tasks: each 10,000 gathered contexts left 2 MB in it."""
    import tracemalloc

    import pyarrow as pa

    n = 10_000
    wanted = [[{"h": 1, "c": k, "at": 120 << 32 | k, "several": False, "hot": False} for k in range(n)]]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("at", pa.int64()), ("several", pa.bool_()), ("hot", pa.bool_())]))
    text = "".join(map(str, range(n)))
    one = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([len(text)], pa.int32()), pa.array([text]), pa.array(wanted, kind)], names=["id", "key", "bytes", "text", "wanted"])
    tracemalloc.start()
    kept = []
    for _ in range(3):
        assert sum(b.num_rows for b in op03_suffix._gathered(100, False)(iter([one]))) == n
        kept.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert kept[2] - kept[1] < 100_000
