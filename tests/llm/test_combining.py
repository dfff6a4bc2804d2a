"""Whitening, the filter audit and exact dedup against brute force."""

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import op11_whitening as W
from tickloom.llm import op12_audit as A
from tickloom.llm import op13_exact as X
from tickloom.llm.tables import stored

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_name(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# ---- exact dedup


def groups(rows):
    """keep_id, size, kept, hash of each row."""
    same = collections.defaultdict(list)
    for i, t in rows:
        same[(t or "").translate(UPPER)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in same.items()}
    return sorted(((i, keep[k], len(same[k]), i == keep[k], hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [(t or "").translate(UPPER)]), key=str)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def with_cases(rows):
    return rows + [(40, "SAME Text É"), (41, "same text É"), (42, "same text é"), (43, "Same Text É"), (None, "null ids"), (None, "Null IDs")]


def test_exact_dedup(spark, rows):
    rows = with_cases(rows)
    docs = spark.createDataFrame([(i, t, 1, "x", 3) for i, t in rows], "doc_id long, text string, salt int, digest string, n long").repartition(7)
    assert by_name(X.digest(docs), COLUMNS) == groups(rows)
    assert X.digest(docs.where("false")).count() == 0
    kept = X.deduped_documents(docs)
    assert kept.columns == docs.columns
    want = {(r[0], r[4]) for r in groups(rows) if r[3]}
    got = [(r.doc_id, hashlib.sha256((r.text or "").translate(UPPER).encode()).hexdigest()) for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)  # repeated rows stay once


def test_texts_that_share_a_digest_stay_apart(spark, rows):
    rows = with_cases(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    weak = X.exact_groups(docs, hashed=lambda t: F.pmod(F.length(t), F.lit(3)).cast("string").cast("binary"))
    got = sorted(((r.row.doc_id, r.keep_id, r.group_size, r.kept, hashlib.sha256((r.row.text or "").translate(UPPER).encode()).hexdigest()) for r in weak.collect()), key=str)
    assert got == groups(rows)


def test_one_text_of_most_rows(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("Hot text " * 20)).otherwise(F.col("id").cast("string")).alias("text"))
    got = X.digest(docs).groupBy("group_size").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.max("keep_id").alias("keep")).collect()
    assert {(r.group_size, r.n, r.kept) for r in got} == {(20_000, 20_000, 1), (1, 10_000, 10_000)}
    assert {r.keep for r in got if r.group_size > 1} == {29_999}


# ---- filter audit


def audit(rows, labels):
    """Every order applied in turn, part by part."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    marked = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, on in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t])) if on}
        marked.append((s or "", fails, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in marked}:
        for order in itertools.permutations("ABCDE"):
            left = [m for m in marked if m[0] == part]
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                failing = [m for m in marked if m[0] == part and f in m[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(m[1] == {f} for m in failing), sum(m[2] for m in gone), sum(m[3] for m in gone)]
    total = collections.Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark, rows):
    full = [(i, t, None if i in (1, 5, None) else "" if i == 2 else f"s{i % 3}") for i, t in rows] + [(50, "A | b " * 30, "s1"), (51, "word " * 60, "s1"), (52, "word " * 60, "s2"), (None, "word " * 60, "s2")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, None, None), (51, 1, 1), (52, 1, 0), (None, 1, 1), (50, 0, 1)]
    docs = spark.createDataFrame([(*r, True, 1) for r in full], "doc_id long, text string, source string, A boolean, good int").repartition(6)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert by_name(A.digest(docs, known), AUDIT) == sorted(audit(full, labels), key=str)
    assert A.digest(docs.where("false"), known).count() == 0
    alone = A.digest(docs, known.where("false"))
    assert alone.count() == 120 * 5 * 4 and alone.where("good_lost + toxic_lost > 0").count() == 0


def test_states_of_the_trie(spark, table):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    counts = A.trie_counts(stored(A.judged(table, labels)))
    states = [r.state for r in counts.select("state").distinct().collect()]
    assert len(states) == 31 and all("".join(sorted(s)) == s for s in states)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


@pytest.mark.parametrize("module, tables", [(X, ["documents"]), (A, ["documents", "labels"])])
def test_sql(spark, module, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = con.execute(module.ORACLE_SQL)
    names = [c[0] for c in got.description]
    assert by_name(module.digest(*[spark.read.parquet(f"{DATA}/{t}.parquet") for t in tables]), names) == sorted(got.fetchall(), key=str)


# ---- whitening


def numbers(v):
    return [int(np.floor(1024 * np.float64(c))) + 100000 for c in v]


def check_whitening(df, vectors, width=8):
    """`vectors`: (id, entries) that remain."""
    x = [numbers(v) for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    y = np.array([[(n * r[k] - sums[k]) / n for k in range(d)] for r in x])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    got = df.collect()
    width = min(width, d)
    assert len(got) == n * width and {r.n for r in got} == {n}
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id, r.deviation].append(r)
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    w = y @ q[:, :width] / np.sqrt(e[:width])
    for k in range(width):
        assert [*{r.explained for r in got if r.component == k + 1}] == pytest.approx([e[k] / e.sum()], rel=1e-10)
    sign = None
    for (i, _), dev, row in zip(vectors, deviation, w):
        ours = {r.component: r.whitened for r in by[i, dev]}
        mine = np.array([ours[k + 1] for k in range(width)])
        if sign is None:
            sign = np.where(mine * row < 0, -1, 1)
        assert mine * sign == pytest.approx(row, abs=1e-7)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_against_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)  # several levels
    monkeypatch.setattr(W, "BLOCK", 16)
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(W.digest(table.repartition(9)), vectors)


def test_whitening_of_hard_tables(spark):
    r = np.random.default_rng(2)
    good = [(i, (r.normal(size=5) * [3, 1, 0.5, 10, 2]).tolist()) for i in range(40)]
    good += [good[0], good[0], (100, [1e3, -2e3, 0.0, 1e-9, 5.0]), (None, [0.1, 0.2, 0.3, 0.4, 0.5])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [1.0, float("nan"), 2.0, 3.0, 4.0]), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (206, [1.0] * 6)]
    schema = "vec_id long, embedding array<double>, row string, v int, deviation int"
    df = spark.createDataFrame([(*t, "r", 1, 2) for t in good + bad], schema).repartition(6)
    check_whitening(W.digest(df), good)
    vectors = W.vectors_of(df, "embedding", None)
    assert [f.name for f in W.whitened(vectors, W.fit(vectors)).schema["row"].dataType] == df.columns
    for none in (df.where("false"), df.where("vec_id >= 200 and vec_id < 205"), df.where("vec_id = 100")):  # no rows, none that remain, one
        assert W.digest(none).count() == 0
    flat = spark.createDataFrame([(i, [float(i % 2), 2.0 * (i % 2), 7.0]) for i in range(10)], "vec_id long, embedding array<double>")
    got = W.digest(flat).collect()  # one component has variance
    assert {r.component for r in got} == {1} and [*{r.explained for r in got}] == pytest.approx([1.0]) and len(got) == 10


def test_deviations_beyond_int64(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [5.0, 4.0]), (4, [1e13, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.deviation for r in W.digest(df).collect()} == {None}
    middle = [(1, [1e5, 1.0]), (2, [-1e5, 2.0]), (3, [5.0, 4.0])]
    check_whitening(W.digest(spark.createDataFrame(middle, "vec_id long, embedding array<double>")), middle)


def test_rotations_find_small_deviations_accurately():
    r = np.random.default_rng(3)
    q, _ = np.linalg.qr(r.normal(size=(200, 6)))
    p, _ = np.linalg.qr(r.normal(size=(6, 6)))
    lengths = 10.0 ** -np.arange(6) * 3
    a = q @ np.diag(lengths) @ p.T
    found, v = W.rotated(W.folded(iter(np.array_split(a, 9))))
    assert found == pytest.approx(lengths, rel=1e-9)
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-13
    assert np.abs(np.abs(v.T @ p) - np.eye(6)).max() < 1e-9
    for d in (1, 2, 3, 64):
        s, v = W.rotated(r.normal(size=(d, d)))
        assert v.shape == (d, d) and (np.diff(s) <= 0).all()
