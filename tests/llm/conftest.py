"""Small documents with every kind of trouble, and whole fixture tables."""

import random

import pytest


def prose(r, n):
    return " ".join("".join(r.choice(["th", "er", "on", "la", "é", "ün"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def trouble():
    """(doc_id, text): nulls, empties, copies, near copies, repeated rows, one id with two texts, shared passages, very long ones."""
    r = random.Random(5)
    base, passage = prose(r, 120), prose(r, 40)
    lines = [prose(r, 6) for _ in range(12)]
    rows = [(1, base), (2, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, "one"), (7, "\n\n\n\n"), (8, "The " * 300), (9, "The " * 300)]
    rows += [(10 + k, f"{prose(r, 30)}\n{passage}\n{prose(r, 30)}") for k in range(6)]
    rows += [(20, "\n".join(lines)), (21, "\n".join(lines[3:9])), (22, "\n".join(lines[:4] + ["x"] + lines[4:])), (20, prose(r, 50))]
    rows += [(None, base), (None, None), (30, prose(r, 20000)), (31, "  lead\t" + base.replace(" ", "\x0b ", 5) + " tail \r\n"), (32, "a" * 3000), (33, "a" * 3000), (34, "É ü x " * 60)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return trouble()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    full = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if i else None, 1, "r", 2, 3) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string, key int, id int").repartition(5)


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
