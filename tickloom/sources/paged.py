"""Paged reads: a table behind limit and offset, a page at a time until one is short.

Page numbers are dealt out to partitions in turn, so no one has to know how many
there are: a partition stops at its first page that isn't full. An equality on a
column that the server can filter by goes into the request; Spark keeps the other
filters. Requests name an order, without which pages could overlap.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema


def http_page(url: str, params: dict[str, str], order: str, limit: int, offset: int, key: str | None = None) -> list[dict]:
    """GET url?column=eq.value&order=...&limit=...&offset=..., a JSON array of rows."""
    asked = {c: f"eq.{v}" for c, v in params.items()} | {"order": order, "limit": limit, "offset": offset}
    headers = {"Accept": "application/json"} | ({"apikey": key, "Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(f"{url}?{urllib.parse.urlencode(asked)}", headers=headers), timeout=30) as answer:
        return json.loads(answer.read())


def folder_page(url: str, params: dict[str, str], limit: int, offset: int) -> list[dict]:
    """The same from files: a folder of pages for each choice of parameters, a file of JSON rows each."""
    store, path = fs.FileSystem.from_uri(url)
    folder = "/".join([path, *(f"{c}={v}" for c, v in sorted(params.items())), f"page={offset // limit}"])
    files = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    texts = [store.open_input_file(f.path).read().decode() for f in files if f.is_file and f.base_name.startswith("part-")]
    return [json.loads(line) for text in texts for line in text.splitlines() if line]


class PagedSource(DataSource):
    """Options: url (http, https, or a folder), page_size, order, readers, columns (comma-separated, those the server filters by), key."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self):
        raise ValueError("a paged source needs a schema")

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.url, self.order, self.key = options["url"], options.get("order", ""), options.get("key")
        self.limit, self.readers = int(options.get("page_size", "1000")), int(options.get("readers", "8"))
        self.filterable = [c for c in options.get("columns", "").split(",") if c]
        self.schema, self.params = schema, {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.filterable and f.attribute[0] not in self.params:
                self.params[f.attribute[0]] = str(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.readers)]

    def page(self, offset: int) -> list[dict]:
        if self.url.startswith(("http://", "https://")):
            return http_page(self.url, self.params, self.order, self.limit, offset, self.key)
        return folder_page(self.url, self.params, self.limit, offset)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        arrow, number = to_arrow_schema(self.schema), partition.value
        while True:
            rows = self.page(number * self.limit)
            yield from pa.Table.from_pylist(rows, arrow).to_batches()
            if len(rows) < self.limit:
                return
            number += self.readers


def read_pages(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").schema(schema).options(url=url, **options).load()


def write_pages(rows: DataFrame, path: str, order: list[str], by: str | None = None, page_size: int = 1000) -> None:
    """Rows as the files that `folder_page` reads: pages of `page_size` in order; with `by`, pages for each value of that column."""
    from pyspark.sql import functions as F

    from tickloom.operators.order import numbered

    places = numbered(rows, [by, *order] if by else order)
    number = F.col("row")
    if by:
        first = places.groupBy(F.col(by).alias("_by")).agg(F.min("row").alias("_first"))
        places = places.join(first, F.col(by).eqNullSafe(F.col("_by")))
        number = F.col("row") - F.col("_first")
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    paged = places.select(*([F.col(by).alias("_by")] if by else []), F.floor(number / page_size).alias("page"), number.alias("_at"), line.alias("line"))
    keys = ["_by", "page"] if by else ["page"]
    text = paged.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"]), "\n").alias("value"))
    text.withColumnsRenamed({"_by": by} if by else {}).write.partitionBy(*([by] if by else []), "page").text(path)
