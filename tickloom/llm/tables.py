"""Reading tables, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_folder

#: Stands for a null id: it sorts first.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the folder of spark.checkpoint.dir."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A struct `row` of every input column (or those in `carry`), beside `id`, `text`, `key`, a hash of the text (64 bits), and `bytes`, its length; other columns can't clash.

    (id, key, bytes) names a document: rows that share all three are taken as repeated rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    return docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).alias("bytes"))


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet under spark.checkpoint.dir and read again; the application's folder goes when Python ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = f"{shared_folder(context)}/tables-{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_drop, context, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FOLDERS: set[str] = set()


def _drop(context, folder: str) -> None:
    if context._jsc is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
