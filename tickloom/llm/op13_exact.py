"""Exact dedup in DataFrame functions only, by skew-safe combining.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
equal texts the row of the largest id stays.

1. Local: each task merges its rows of one (digest, salt, text); Spark's partial
   aggregation before the shuffle does that. The salt comes from the id, so the
   copies of a text are spread over `SALTS` groups.
2. Salted: groups of (digest, salt, text) are merged across tasks.
3. Global: the winners of the salts of a text, `SALTS` at most, are merged by
   (digest, text). The salts that occur travel as the bits of a long.

The whole text is a grouping key at every stage, so equal digests alone never
make two texts equal. Documents then look their group up by digest and salt,
without their text: a text that a third of all rows share is `SALTS` keys, which
adaptive execution may split further. Where the groups show a digest with
several texts, its documents are looked up by text, too.

Defined cases: null ids lose against any other, and a group of null ids has a
null keep_id; rows of equal id and equal text share their verdict, and
`deduped_documents` keeps one of them; other columns pass through in `row`,
whatever their names; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.llm.tables import stored

#: At most 63, the bits of a long.
SALTS = 32


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def sha256(text: Column) -> Column:
    """32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def salt(id_col: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")


def salt_bit(salt_col: str) -> Column:
    return F.expr(f"shiftleft(1L, {salt_col})")


def salts_in(bits: str, salts: int = SALTS) -> Column:
    """The salts whose bits are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda k: F.getbit(F.col(bits), k) == 1)


def text_groups(rows: DataFrame) -> DataFrame:
    """From (id, text, digest, salt) rows, one row per text: digest, keep_id, group_size, salts, and `number` and `n_texts` of the texts of its digest; the text only where those are several."""
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("id").alias("best"), F.count("*").alias("n"))
    merged = salted.repartition("digest").groupBy("digest", "text").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(salt_bit("salt")).alias("salts"))
    same = Window.partitionBy("digest")
    counted = merged.withColumn("number", F.row_number().over(same.orderBy("text"))).withColumn("n_texts", F.max("number").over(same))
    return counted.withColumn("text", F.when(F.col("n_texts") > 1, F.col("text")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, hashed: Callable[[Column], Column] = sha256) -> DataFrame:
    """`row` (the input row, or its columns in `carry`), `digest`, `number` (of the text among those of its digest), `keep_id`, `group_size`, `kept`."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    text = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("text"))
    base = text.select("row", "id", "text", hashed(F.col("text")).alias("digest"), salt(F.col("id")).alias("salt"))
    groups = stored(text_groups(base.select("id", "text", "digest", "salt")))
    known = groups.select("digest", F.explode(salts_in("salts")).alias("salt"), "text", "number", "n_texts", "keep_id", "group_size")
    found = base.drop("text").join(known.where("n_texts = 1").drop("text"), ["digest", "salt"])
    crowded = known.where("n_texts > 1")
    if not crowded.isEmpty():  # digests that several texts share
        found = found.unionByName(base.join(stored(crowded), ["digest", "salt", "text"]).drop("text"))
    return found.select("row", "digest", "number", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduped_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one for each text, as they are."""
    kept = exact_groups(docs, id_col, text_col).where("kept").dropDuplicates(["digest", "number"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    done = exact_groups(docs, carry=["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t"""
