"""Pages, databases and live documents."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tickloom.plans import adapters as A
from tickloom.plans import catalog
from tickloom.sources import database_files, paged
from tickloom.sources import readers as R
from tickloom.sources.readers import live_minutes

DATA = "/root/testdata/sf0.001"
SCHEMA = "id bigint, symbol string, price double"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 100, 333])  # with full last pages
def test_pages_in_files(spark, tmp_path, n):
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("symbol"), (F.col("id") / 7).alias("price"))
    whole, by = f"{tmp_path}/whole", f"{tmp_path}/by"
    paged.write_pages(rows, whole, ["id"], page_size=50)
    paged.write_pages(rows, by, ["id"], by="symbol", page_size=50)
    want = sorted(map(tuple, rows.collect()))
    for readers in ("1", "3"):
        assert sorted(map(tuple, paged.read_pages(spark, whole, SCHEMA, page_size="50", readers=readers).collect())) == want
    some = paged.read_pages(spark, by, SCHEMA, page_size="50", columns="symbol").where("symbol = 'A' and price > 1")
    assert sorted(map(tuple, some.collect())) == [r for r in want if r[1] == "A" and r[2] > 1]


def test_pages_over_http(spark):
    rows = [{"id": k, "symbol": "AB"[k % 2], "price": None if k % 5 == 0 else k / 4} for k in range(240)]
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            asked.append((q, self.headers.get("apikey")))
            found = [r for r in rows if "symbol" not in q or f"eq.{r['symbol']}" == q["symbol"]]
            body = json.dumps(found[int(q["offset"]) : int(q["offset"]) + int(q["limit"])]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/bars"
        got = paged.read_pages(spark, url, SCHEMA, page_size="60", order="id.asc", key="k", readers="2").collect()  # the last page is full
        assert sorted(map(tuple, got), key=str) == sorted((tuple(r.values()) for r in rows), key=str)
        assert all(q["order"] == "id.asc" and key == "k" for q, key in asked)
        asked.clear()
        some = paged.read_pages(spark, url, SCHEMA, page_size="60", order="id.asc", columns="symbol").where("symbol = 'B'").collect()
        assert len(some) == 120 and all(q["symbol"] == "eq.B" for q, _ in asked)
    finally:
        server.shutdown()


def test_database_reads_push_filters_and_split(spark):
    df = catalog.QUERIES["src_jdbc_bars"](spark, DATA)
    text = plan(df)
    assert "PushedFilters: [*IsNotNull(symbol)" in text and "EqualTo(symbol,purchase)" in text and "GreaterThanOrEqual(date" in text
    assert df.rdd.getNumPartitions() == 4 and df.count() > 0


def test_a_cluster_without_a_server_reads_database_files(spark, monkeypatch):
    names = ("src_jdbc_bars", "src_jdbc_between")
    want = {n: sorted(map(tuple, catalog.QUERIES[n](spark, DATA).collect())) for n in names}
    monkeypatch.setattr(R, "jdbc_url", lambda spark: None)
    for n in names:
        df = catalog.QUERIES[n](spark, DATA)
        assert sorted(map(tuple, df.collect())) == want[n] and want[n]
        assert df.rdd.getNumPartitions() <= 3  # files out of the range aren't opened


def test_database_files_keep_values_and_filter(spark, tmp_path):
    values = [(1, "a'b", 1.5, 7), (2, None, float("nan"), 3), (3, "B", float("inf"), None), (None, "b", None, 2)]
    rows = spark.createDataFrame(values, 'id long, `sym"bol` string, x double, s long').withColumn("at", F.timestamp_seconds("s"))
    files = database_files.write_files(rows, str(tmp_path / "db"), "at", 3)
    got = database_files.read_files(spark, str(tmp_path / "db"), rows.schema, "at", files)
    text = lambda df: sorted(map(str, df.collect()))
    assert text(got) == text(rows)
    for condition in ("at >= timestamp_seconds(3)", "at < timestamp_seconds(3)", "at is null", "`sym\"bol` = 'B'", "`sym\"bol` > 'a'", "id <= 2 and x > 1", "x = 'NaN'"):
        assert text(got.where(condition)) == text(rows.where(condition)), condition
    assert database_files.write_files(rows.where("false"), str(tmp_path / "none"), "at", 3) == []
    assert database_files.read_files(spark, str(tmp_path / "none"), rows.schema, "at", []).count() == 0


def test_parquet_reads_push_a_range(spark):
    text = plan(catalog.QUERIES["src_parquet"](spark, DATA))
    assert "GreaterThanOrEqual(o_orderdate" in text and "EqualTo(o_orderstatus,O)" in text


def test_a_minute_that_returns_is_a_bar_of_its_own(spark):
    t = [60, 61, 119, 120, 125, 60, 66, 180]
    quote = {"open": [1.0, 2, 3, 4, 5, 6, 7, None], "high": [9.0, 8, 7, 6, 5, 4, 3, 2], "low": [1.0, 0.5, 3, 4, 5, 6, 7, 8], "close": [1.5, 2.5, 3.5, 4.5, None, 6.5, 7.5, 8.5], "volume": [1, None, 3, 4, 5, 6, 7, 8]}
    docs = [("X", json.dumps({"chart": {"result": [{"timestamp": t, "indicators": {"quote": [quote]}}]}})), ("none", "{}"), ("bad", "no json"), ("empty", json.dumps({"chart": {"result": [{"timestamp": [], "indicators": {"quote": [quote]}}]}}))]
    got = live_minutes(spark.createDataFrame(docs, "symbol string, json string")).collect()
    minute = lambda r: r.date.minute
    assert [(minute(r), r.open, r.high, r.low, r.close_price, r.volume) for r in got] == [(1, 1.0, 9.0, 0.5, 3.5, 4), (2, 4.0, 6.0, 4.0, 4.5, 4), (1, 6.0, 4.0, 6.0, 7.5, 13)]


def test_ticks_of_one_time_follow_their_ids(spark):
    from tickloom.operators.bars import bars_of_ticks

    rows = spark.createDataFrame([("A", 3.0, 1, 1, 30), ("A", 1.0, 1, 1, 10), ("A", 2.0, 1, 1, 20)], "symbol string, price double, volume long, s long, event_id long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    bar = bars_of_ticks(rows.repartition(3), 1).first()
    assert (bar.open, bar.close_price) == (1.0, 3.0)
    assert A.ticks(spark, DATA).columns[-1] == "event_id"
