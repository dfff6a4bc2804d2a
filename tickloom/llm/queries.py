"""The queries of this subpackage, over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import op01_decontam, op02_quality, op03_suffix, op04_mixing, op05_substring, op06_simhash, op07_pii, op08_layout, op09_lines, op10_classifier, op11_whitening, op12_audit, op13_exact
from tickloom.llm.tables import table


def _on(name: str, digest: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digest(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": lambda spark, sf_dir: op01_decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_quality_rules": _on("documents", op02_quality.digest),
    "op3_suffix_dedup": _on("documents", op03_suffix.digest),
    "op4_mixing": _on("documents", op04_mixing.digest),
    "op5_substring_dedup": _on("documents", op05_substring.digest),
    "op6_simhash": _on("documents", op06_simhash.digest),
    "op7_pii": _on("documents", op07_pii.digest),
    "op8_html_layout": _on("pages", op08_layout.digest),
    "op9_line_dedup": _on("documents", op09_lines.digest),
    "op10_quality_classifier": lambda spark, sf_dir: op10_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op11_whitening": _on("embeddings", op11_whitening.digest),
    "op12_filter_audit": lambda spark, sf_dir: op12_audit.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_exact_dedup": _on("documents", op13_exact.digest),
}


def _window_sql(units: str, size: int, joiner: str, count: str) -> str:
    return f"""WITH d AS (SELECT doc_id, {units} AS w FROM documents),
win AS (SELECT doc_id, i AS pos, array_to_string(list_slice(w, i, i + {size - 1}), {joiner}) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM d)),
late AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, rank() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM late, (SELECT unnest(range(0, {size})) AS j)),
u AS (SELECT doc_id, i AS pos, w[i] AS unit FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
r AS (SELECT u.doc_id, count(g.pos) AS n_removed, string_agg(unit, {joiner} ORDER BY u.pos) FILTER (WHERE g.pos IS NULL) AS kept FROM u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.pos = g.pos GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS {count}, coalesce(r.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op4_mixing": op04_mixing.ORACLE_SQL,
    "op5_substring_dedup": _window_sql(r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')", op05_substring.WINDOW_WORDS, "' '", "n_words"),
    "op9_line_dedup": _window_sql("CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END", op09_lines.WINDOW_LINES, "chr(10)", "n_lines"),
    "op12_filter_audit": op12_audit.ORACLE_SQL,
    "op13_exact_dedup": op13_exact.ORACLE_SQL,
}
