"""SimHash groups and benchmark hits against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import op01_decontam as D
from tickloom.llm import op06_simhash as S
from tickloom.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in (zip(w, w[1:], w[2:]) if len(w) > 2 else [w])]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def groups(marks, reach=2):
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(marks):
        for j, (_, b) in enumerate(marks[:i]):
            if (a ^ b).bit_count() <= reach:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(marks):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(marks))]


def kept_ids(marks):
    """The least id of each component; an id of two texts can be the least of two."""
    named = groups([(k, f) for k, (_, f) in enumerate(marks)])
    return [g for g, _ in {(g, n) for g, n in zip(groups(marks), named)}]


def test_groups(docs, rows):
    marks = [(i, fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", g) for (i, f), g in zip(marks, groups(marks))), key=str)
    assert sorted(map(tuple, S.digest(docs).collect()), key=str) == want


def test_one_of_each_group_stays(docs, rows):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    marks = [(i, fingerprint(t)) for i, t in rows]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, kept_ids(marks)))
    assert S.keep_one(docs.where("false")).count() == 0


def test_links_of_random_fingerprints(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for b in base for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {frozenset(map(int, x)) for x in S.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {frozenset((signed[i], signed[j])) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert got == want and want


def test_cells_of_any_fineness_meet():
    r = random.Random(3)
    assert len(S.segments(1000)) < len(S.segments(10**6)) < len(S.segments(10**10)) and all(sum(S.segments(n)) == 64 for n in (0, 1, 10**5, 10**12))
    for n in (1, 10**5, 10**7, 10**12):
        for _ in range(200):
            a = r.getrandbits(64)
            b = a ^ sum(1 << k for k in r.sample(range(64), r.randrange(3)))
            x, y = S.cells(np.array([a, b], np.uint64), S.segments(n))
            assert set(x.tolist()) & set(y.tolist())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(20)] + [(7, 7), (-5, -6)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100)} | {(200 + k, 100) for k in range(20)} | {(-5, -6), (-6, -6)}


def edits(item, text):
    """Least word edits of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def changed(r, words, k):
    w = list(words)
    for _ in range(k):
        at = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[at] = "zz" + str(r.randrange(99))
        elif kind == 1:
            w.insert(at, "yy" + str(r.randrange(99)))
        else:
            del w[at]
    return w


def test_hits_are_exact_and_recall_is_high(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 6)))
    items = [(k, " ".join(word() for _ in range(r.randrange(15, 60)))) for k in range(30)]
    docs, planted = [], set()
    for n in range(120):
        text = [word() for _ in range(r.randrange(5, 80))]
        if n % 2:
            k, words = r.choice(items)
            copy = changed(r, words.split(), r.randrange(0, int(len(words.split()) * 0.15) + 1))
            text = text + [w.upper() if r.random() < 0.2 else w for w in copy] + [word() for _ in range(20)]
            planted.add((n, k))
        docs.append((n, "\n".join(text)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, "tiny")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, hits string")
    bench = spark.createDataFrame([*items, (900, None), (901, "too short to match")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in D.digest(df, bench).collect()}
    words = dict(items)
    by_id = {i: (t or "").lower().split() for i, t in docs}
    for (doc, item), e in got.items():
        m = words[item].split()
        assert e == edits(m, by_id[doc]) and e <= 0.2 * len(m)
    assert len(planted & set(got)) >= 0.97 * len(planted) and got[(None, 0)] == 0
    clean = D.clean_documents(df, bench)
    assert clean.columns == df.columns and {x.doc_id for x in clean.collect()} == {i for i, _ in docs} - {d for d, _ in got}
    assert D.digest(df.where("false"), bench).count() == 0 and D.digest(df, bench.where("false")).count() == 0


def planted(r, n, share, times):
    """How many copies of items of n words are found at any alignment, with `share` of the edits allowed."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    items = [" ".join(word() for _ in range(n)) for _ in range(times)]
    texts = [" ".join([word() for _ in range(r.randrange(20))] + changed(r, t.split(), int(n // 5 * share)) + [word() for _ in range(r.randrange(20))]) for t in items]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    hits = {(row, k) for row, k, _, _ in D.find(D.Items(list(range(times)), items), flat, np.cumsum([0, *map(len, texts)]))}
    return len({(k, k) for k in range(times)} & hits)


def test_short_items_are_all_found():
    r = random.Random(8)
    for n in range(2, D.PIECED):
        assert planted(r, n, 0, 40) == planted(r, n, 1, 40) == 40


def test_recall_at_the_least_similarity():
    r = random.Random(9)
    found = {n: planted(r, n, 1, 300) / 300 for n in (25, 30, 45, 60, 200)}
    assert min(found.values()) >= D.RECALL, found


def test_slices_give_the_same(spark, monkeypatch, table):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, D.digest(table, bench).collect()))
    monkeypatch.setattr(D, "SLICE_ITEMS", 15)
    assert sorted(map(tuple, D.digest(table, bench).collect())) == whole
    assert D.clean_documents(table, bench).count() == table.count() - len({x[0] for x in whole})


def test_links_are_never_sent_whole(spark):
    """The grid has some 25 rows a fingerprint where the planner expects one: its join must not become a broadcast of them."""
    fps = spark.range(4000).select(F.xxhash64("id").alias("fp"))
    fps = fps.union(fps.limit(50).select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp"))).distinct().checkpoint()
    found = S.links(fps)
    pairs = {(r.u, r.v) for r in found.collect()}
    assert len(pairs) == 50 and all(u < v and (u ^ v) == 5 for u, v in pairs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
