"""A table as SQLite files in a shared folder: the database of a cluster on which no server is named.

A file holds a range of one column, with an index on it. Tasks write the files
and tell their ends, so a read opens a file only if its range meets the pushed
filters; what can be compared alike (texts, whole numbers, times) is filtered by
the database, the rest by Spark. Times are kept as microseconds, and NaN, which SQLite lacks, as a text.
"""

from __future__ import annotations

import datetime as dt
import json
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
TIMES, COMPARED = (T.TimestampType, T.TimestampNTZType), (T.StringType, T.LongType, T.IntegerType, T.TimestampType, T.TimestampNTZType)
ROWS_AT_ONCE = 10_000


def micros(value):
    if not isinstance(value, dt.datetime):
        return value
    zone = value.tzinfo
    return (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc if zone else None)) // dt.timedelta(microseconds=1)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _plain(column: pa.Array) -> list:
    """Values as SQLite keeps them."""
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).to_pylist()
    values = column.to_pylist()
    return ["NaN" if x is not None and x != x else x for x in values] if pa.types.is_floating(column.type) else values


def write_files(rows: DataFrame, path: str, by: str, parts: int) -> list[dict]:
    """`rows` in `parts` ranges of the column `by`, a file each; returns file, and first and last value (none where all are null)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            con, n = sqlite3.connect(f"{folder}/db"), 0
            con.execute(f"CREATE TABLE bars ({', '.join(map(quoted, names))})")
            for batch in batches:
                n += batch.num_rows
                con.executemany(f"INSERT INTO bars VALUES ({', '.join('?' * len(names))})", zip(*map(_plain, batch.columns)))
            con.execute(f"CREATE INDEX places ON bars ({quoted(by)})")
            con.commit()
            first, last = con.execute(f"SELECT min({quoted(by)}), max({quoted(by)}) FROM bars").fetchone()
            con.close()
            if n:
                store, top = fs.FileSystem.from_uri(path)
                store.create_dir(top)
                file = f"{uuid.uuid4().hex}.sqlite"  # a task that is tried again writes another one; only what is told is read
                with open(f"{folder}/db", "rb") as source, store.open_output_stream(f"{top}/{file}") as target:
                    shutil.copyfileobj(source, target)
                yield pa.RecordBatch.from_pylist([{"said": json.dumps({"file": file, "first": first, "last": last})}])

    told = rows.repartitionByRange(parts, by).mapInArrow(run, "said string").collect()  # a row a file
    return [json.loads(r.said) for r in told]


class FilesSource(DataSource):
    """Options: path, by, and files, what `write_files` told."""

    @classmethod
    def name(cls) -> str:
        return "database_files"

    def reader(self, schema: T.StructType) -> FilesReader:
        return FilesReader(self.options, schema)


class FilesReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.by, self.files, self.schema = options["path"], options["by"], json.loads(options["files"]), schema
        self.asked: list[tuple[str, str, object]] = []  # column, operator, value
        self.known: list[str] = []

    def pushFilters(self, filters):
        kinds = {f.name: type(f.dataType) for f in self.schema}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull) and column in kinds:
                self.known.append(column)
            elif type(f) in OPERATORS and kinds.get(column) in COMPARED:
                self.asked.append((column, OPERATORS[type(f)], micros(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        ends = [(op, v) for c, op, v in self.asked if c == self.by]
        meets = lambda x: x["first"] is not None and all((op[0] == "<" or x["last"] >= v) and (op[0] == ">" or x["first"] <= v) for op, v in ends)
        return [InputPartition(x["file"]) for x in self.files if not ends or meets(x)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file meets the filters
            return
        arrow = to_arrow_schema(self.schema)
        store, top = fs.FileSystem.from_uri(self.path)
        where = [f"{quoted(c)} {op} ?" for c, op, _ in self.asked] + [f"{quoted(c)} IS NOT NULL" for c in self.known]
        with tempfile.TemporaryDirectory() as folder:
            with store.open_input_stream(f"{top}/{partition.value}") as source, open(f"{folder}/db", "wb") as target:
                shutil.copyfileobj(source, target)
            con = sqlite3.connect(f"{folder}/db")
            found = con.execute(f"SELECT {', '.join(quoted(f.name) for f in self.schema)} FROM bars{' WHERE ' * bool(where)}{' AND '.join(where)}", [v for _, _, v in self.asked])
            while rows := found.fetchmany(ROWS_AT_ONCE):
                columns = [self.column(list(values), field) for values, field in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            con.close()

    @staticmethod
    def column(values: list, field: pa.Field) -> pa.Array:
        if pa.types.is_timestamp(field.type):
            return pa.array(values, pa.int64()).cast(field.type)
        return pa.array([float(x) if x == "NaN" else x for x in values] if pa.types.is_floating(field.type) else values, field.type)


def read_files(spark: SparkSession, path: str, schema: T.StructType, by: str, files: list[dict]) -> DataFrame:
    spark.dataSource.register(FilesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("database_files").schema(schema).options(path=path, by=by, files=json.dumps(files)).load()
