"""Each stage on what the one before kept, against brute force."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
from tickloom.llm import op01_decontam, op02_quality, op04_mixing  # noqa: E402
from tickloom.llm.tables import stored  # noqa: E402

from .test_pairs import fingerprint, groups  # noqa: E402
from .test_windows import brute, lines  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, table):
    docs = {0: table}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs[k + 1] = stored(stage(spark, docs[k], DATA))
    columns = table.columns
    assert all(docs[k].columns == columns for k in range(1, 6))
    rows = {k: {r.doc_id: r for r in df.collect()} for k, df in docs.items() if k < 5}
    verdict = {r.doc_id for r in op02_quality.digest(table).collect() if r.kept}
    assert set(rows[1]) == verdict and all(rows[1][i] == rows[0][i] for i in verdict)
    cut = {i: b"\n".join(x for x, g in zip(u, gone) if not g).decode() for i, u, gone in brute([(i, r.text) for i, r in rows[1].items()], lines, 3)}
    assert {i: r.text for i, r in rows[2].items()} == cut and all(r.n_chars == len(r.text) for r in rows[2].values())
    marks = [(i, fingerprint(r.text)) for i, r in sorted(rows[2].items())]
    assert set(rows[3]) == set(groups(marks)) and all(rows[3][i] == rows[2][i] for i in rows[3])
    leaked = {r.doc_id for r in op01_decontam.digest(docs[3], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    bench = [" ".join(r.text.split()).lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    exact = {i for i, r in rows[3].items() if any(b in " ".join(r.text.split()).lower() for b in bench)}
    assert exact <= leaked and set(rows[4]) == set(rows[3]) - leaked
    taken = {r.row.doc_id: r.n_copies for r in op04_mixing.copies(docs[4]).collect() if r.n_copies}
    assert {r.doc_id: r.n for r in docs[5].groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == taken
    assert sorted(map(str, pipeline.run(spark, DATA).collect())) == sorted(map(str, docs[5].collect()))
