"""Line dedup: overlapping windows of three lines, later occurrences removed by merging covered positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.window_dedup import remove_repeated_windows

WINDOW_LINES = 3


def dedup_lines(docs: DataFrame, window: int = WINDOW_LINES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row`, `n_units` (\\n-split lines; none in an empty or null text), `n_removed`, `kept`.

    Lines are compared exactly. A text of fewer than `window` lines has no window and stays whole.
    """
    return remove_repeated_windows(docs, "line", window, False, id_col, text_col, carry)


def deduped_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows with repeated lines cut from `text_col`; a null text stays null, other columns stay as they are."""
    empty = F.col(f"`{text_col}`").isNull().alias("_null")
    others = [c for c in docs.columns if c != text_col]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col("doc_id").alias("id"), F.col(f"`{text_col}`").alias("text"), empty)
    done = dedup_lines(marked, id_col="id", carry=["others", "_null"])
    new = F.when(~F.col("row._null"), F.col("kept")).alias(text_col)
    return done.select(*[new if c == text_col else F.col(f"row.others.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs, carry=["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), F.col("n_units").alias("n_lines"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
