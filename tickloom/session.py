"""The session that the package is written for."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tickloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed-join splitting; ANSI mode stays on. On a cluster, master and sizes come from the submit."""
    builder = SparkSession.builder.appName(name)
    if "SPARK_MASTER" in os.environ:
        builder = builder.master(os.environ["SPARK_MASTER"])
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    return builder.config(map=base | conf).getOrCreate()


def shared_folder(context: SparkContext) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one in local mode, and an error on a cluster."""
    top = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if top is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(top)
    return top


def fresh_path(spark: SparkSession) -> str:
    """A folder that isn't there yet, where driver and executors can write; it goes when Python ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(context)}/written-{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_drop, context, folder)
    return f"{folder}/{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def _drop(context: SparkContext, folder: str) -> None:
    if context._jsc is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read again: lineage is cut, and the planner knows its size."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
