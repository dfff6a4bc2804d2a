"""Substring dedup: repeated 20-word windows, behind a count-min prefilter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.window_dedup import remove_repeated_windows

WINDOW_WORDS = 20


def dedup_substrings(docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row`, `n_units`, `n_removed`, `kept`: see :mod:`tickloom.llm.window_dedup` for the rule and the defined cases."""
    return remove_repeated_windows(docs, "word", window, True, id_col, text_col, carry)


def digest(docs: DataFrame) -> DataFrame:
    done = dedup_substrings(docs, carry=["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
