"""Rows as they are appended by the sinks, with deterministic keys in place of database identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import gex as G
from tickloom.session import fresh_path  # noqa: F401


def gex_rows(strikes: DataFrame, spot: float, futures: float, computed_at: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot rows and level rows; the key is a hash of symbol and time, so a rerun writes the same keys."""
    at = F.lit(computed_at).cast("timestamp_ntz")
    key = lambda c: F.xxhash64(c, F.lit(computed_at)).alias("snapshot_key")
    parents = strikes.select("underlying").distinct().select(key(F.col("underlying")), F.col("underlying").alias("symbol"), at.alias("computed_at"), F.lit(spot).alias("etf_price"), F.lit(futures).alias("futures_price"))
    children = G.key_levels(strikes, spot).withColumn("snapshot_key", F.xxhash64("underlying", F.lit(computed_at))).drop("underlying")
    return parents, children


def write_gex(parents: DataFrame, children: DataFrame, path: str) -> None:
    parents.write.mode("append").parquet(f"{path}/gamma_exposure")
    children.write.mode("append").parquet(f"{path}/gamma_levels")


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars partitioned by interval, so that the reads' interval filter prunes folders."""
    bars.write.mode("append").partitionBy("interval_type").parquet(path)


def write_jdbc_bars(bars: DataFrame, url: str, table: str, **options: str) -> None:
    """Bars as a database table, in place of what was there; names are short texts, so that the database can compare them."""
    types = ", ".join(f"{c} VARCHAR(64)" for c in ("symbol", "interval_type") if c in bars.columns)
    bars.write.format("jdbc").options(url=url, dbtable=table, createTableColumnTypes=types, **options).mode("overwrite").save()


def write_rows(rows: DataFrame, path: str) -> None:
    """Feature rows or predictions as Parquet, in place of what was there."""
    rows.write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def add_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Schema migration: missing columns are added as nulls of their type; ones that exist stay."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def copy_column(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Backfill of a new column from a legacy one where it is null; the legacy column goes."""
    return rows.withColumn(new, F.coalesce(new, old)).drop(old)
