"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source; targets follow from source weights, with a ceiling
of `MAX_REPEATS` times the source's size; each document is then taken
floor(rate) times, and once more if a hash of its id, read as a number in
[0, 1), is below the fraction of the rate. Rate is target / size of the source.

The only shuffle before the join adds sizes per source with map-side partial
sums, so a source with a third of all rows is one row a task. The table of
sources (one row each) is joined by whatever strategy its measured size allows;
a hot source in a sort-merge join is split by adaptive execution.

Defined cases: null text has size 0; null source is a source of its own, last;
a source of size 0 has target 0; repeated rows are drawn alike (same id, same
draw); a null id draws as the empty string; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.tables import checkpointed

WEIGHTS, MAX_REPEATS, SEED = (5, 2, 1), 3, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, size) rows: source, source_size, target. One row a source.

    Water filling: with a level L, a source's target is min(weight * L, ceiling).
    Sorted by ceiling / weight, a prefix of the sources is at its ceiling, and L
    is what remains of the total over the weights that remain; L rises while the
    prefix is really at its ceilings and falls after, so the level is the highest.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    spent = F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - spent) / left_weight
    return (
        by_source.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_repeats))).alias("ceiling"))
        .withColumn("level", level)
        .withColumn("free", F.col("ceiling") >= F.col("weight") * F.col("level"))
        .withColumn("water", F.max(F.when(F.col("free"), F.col("level"))).over(whole))
        .select("source", "source_size", F.least("ceiling", F.coalesce(F.col("weight") * F.col("water"), F.col("ceiling"))).alias("target"))
    )


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """`row` (the input row, or its columns in `carry`, which has to hold the id), `size`, `source_size`, `target`, `n_copies` of each document."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = checkpointed(source_targets(sized.select("source", "size"), weights, max_repeats))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    t = targets.withColumnRenamed("source", "_source")
    return (
        sized.join(t, sized["source"].eqNullSafe(t["_source"]), "left")
        .withColumn("rate", rate)
        .withColumn("n_copies", (F.floor("rate") + (draw(F.col(f"row.`{id_col}`"), seed) < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
        .select("row", "size", "source_size", "target", "n_copies")
    )


def mixed_documents(docs: DataFrame, copy_col: str | None = None, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; numbered from 0 in `copy_col`, if that is named."""
    drawn = copies(docs, **options).where("n_copies > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], *([F.col("copy").alias(copy_col)] if copy_col else []))


def digest(docs: DataFrame) -> DataFrame:
    return copies(docs, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def sizes_and_targets_sql(documents: str) -> str:
    """DuckDB CTEs sized, by_source, filled and targets over a relation of documents."""
    return rf"""
sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM {documents}),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS ceiling FROM by_source),
levelled AS (SELECT *, ((SELECT sum(source_size) FROM by_source)
    - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(ceiling, coalesce(weight * (SELECT max(level) FROM levelled WHERE ceiling >= weight * level), ceiling)) AS target FROM levelled),
rated AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)"""


ORACLE_SQL = f"""WITH {sizes_and_targets_sql("documents")}
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rated"""
