"""A table on files that micro-batches are merged into: a manifest names the folders that are current.

Rows have a part (a month of an interval, say). A batch reads the current folders
of the parts that it touches, merges, and writes those parts anew, at most
`FILES` files each; the next manifest names them in place of the old ones. So a
read opens a bounded number of files however many batches there were, and parts
that a batch doesn't touch aren't rewritten. Manifests are numbered and put in
place by a rename; each names the last batch of every stream that it holds, so a
batch that is replayed after a restart changes nothing. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.bars import KEY, latest

FILES = 4


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a maker of its paths."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return path_of(path).getFileSystem(spark._jsc.hadoopConfiguration()), path_of


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, path_of = _files(spark, path)
    folder = path_of(f"{path}/manifest")
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """{"number", "folders": part -> folder, "batches": stream -> last batch}; the newest, or an empty one."""
    numbers = _numbers(spark, path)
    if not numbers:
        return {"number": 0, "folders": {}, "batches": {}}
    store, path_of = _files(spark, path)
    source = store.open(path_of(f"{path}/manifest/{number or numbers[-1]:012d}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    store, path_of = _files(spark, path)
    name = f"{state['number']:012d}.json"
    draft, place = path_of(f"{path}/manifest/.{name}.draft"), path_of(f"{path}/manifest/{name}")
    out = store.create(draft, True)
    out.write(json.dumps(state).encode())
    out.close()
    if store.exists(place) or not store.rename(draft, place):
        raise RuntimeError(f"another writer made version {state['number']} of {path}")


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The current rows; a table without rows needs the schema."""
    folders = sorted(manifest(spark, path)["folders"].values())
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path}/{f}" for f in folders])


def merge(path: str, rows: DataFrame, batch: int, stream: str = "main", keys: tuple[str, ...] = KEY, order: str = "fetched_at", part: Column | None = None) -> bool:
    """Merges a batch: per key the row of the highest `order` stays. False if the batch is in already. `part` is of the keys alone; by default a month of an interval."""
    spark = rows.sparkSession
    state = manifest(spark, path)
    if state["batches"].get(stream, -1) >= batch:
        return False
    part = F.concat_ws("-", "interval_type", F.date_format("date", "yyyy-MM")) if part is None else part
    named = F.regexp_replace(F.coalesce(part, F.lit("null")), "[^A-Za-z0-9.-]", "_")  # the name of a folder; parts that share one are one
    new = latest(rows, keys, order).select(*rows.columns).withColumn("_part", named).persist()
    try:
        touched = [r._part for r in new.select("_part").distinct().collect()]  # a name a part
        old = [f"{path}/{state['folders'][p]}" for p in touched if p in state["folders"]]
        whole = new if not old else latest(spark.read.schema(rows.schema).parquet(*old).withColumn("_part", named).unionByName(new), keys, order).select(*new.columns)
        number, folders = state["number"] + 1, dict(state["folders"])
        if touched:
            spread = F.pmod(F.xxhash64(*keys), F.lit(FILES))
            whole.repartition(max(1, len(touched) * FILES), "_part", spread).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/data/{number:012d}")
            folders |= {p: f"data/{number:012d}/_part={p}" for p in touched}
    finally:
        new.unpersist()
    _commit(spark, path, {"number": number, "folders": folders, "batches": state["batches"] | {stream: batch}})
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes manifests but the last `keep`, and folders that none of these names; gives the number of folders deleted."""
    store, path_of = _files(spark, path)
    numbers = _numbers(spark, path)
    named = {f for n in numbers[-keep:] for f in manifest(spark, path, n)["folders"].values()}
    data, gone = path_of(f"{path}/data"), 0
    for version in store.listStatus(data) if store.exists(data) else []:
        for folder in store.listStatus(version.getPath()):
            name = folder.getPath().getName()
            if folder.isDirectory() and f"data/{version.getPath().getName()}/{name}" not in named:
                store.delete(folder.getPath(), True)
                gone += 1
    for n in numbers[:-keep]:
        store.delete(path_of(f"{path}/manifest/{n:012d}.json"), False)
    return gone
