"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators.bars import latest
from tickloom.plans import adapters as A
from tickloom.streaming import live, ohlc, store

DATA = "/root/testdata/sf0.001"


def stream(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_tumbling_bars(spark, tmp_path):
    ticks = A.ticks(spark, DATA)
    live = stream(spark, ticks, str(tmp_path / "in"))
    q = ohlc.tumbling_ohlc(live, "5 minutes").writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = ohlc.tumbling_ohlc(ticks, "5 minutes")
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, batch.collect()))


def test_upserted_bars(spark, tmp_path):
    rows = A.rewrites(spark, DATA)
    live = stream(spark, rows, str(tmp_path / "in"))
    q = ohlc.upsert_bars(live, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = ohlc.read_upserted(spark, str(tmp_path / "out"))
    want = latest(rows, ("symbol", "date", "interval_type"), "fetched_at")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.count("*")).first()[0] == rows.select("symbol", "date").distinct().count()


def files_read(df):
    return len(df.inputFiles())


def test_table_of_batches(spark, tmp_path):
    """Replays change nothing, reads stay small, untouched parts aren't rewritten, old folders go."""
    rows = A.rewrites(spark, DATA)
    path, n = str(tmp_path / "t"), 5
    part = F.date_format("date", "yyyy-MM-dd")
    for k in range(n):
        batch = rows.where(F.minute("fetched_at") % n == k)
        assert store.merge(path, batch, k, part=part)
        before = store.manifest(spark, path)
        assert not store.merge(path, batch, k, part=part) and store.manifest(spark, path) == before
    want = sorted(map(tuple, latest(rows, ohlc.KEY, "fetched_at").select(rows.columns).collect()), key=str)
    current = store.read(spark, path, rows.schema)
    assert sorted(map(tuple, current.collect()), key=str) == want
    parts = rows.select(part).distinct().count()
    assert files_read(current) <= parts * store.FILES
    one_day = rows.where(F.to_date("date") == "2024-01-05").withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 1 day"))
    assert store.merge(path, one_day, n, part=part)
    after = store.manifest(spark, path)
    assert sum(after["folders"][p] != f for p, f in before["folders"].items()) == 1
    assert store.vacuum(spark, path, keep=1) > 0 and store.manifest(spark, path) == after
    assert store.read(spark, path, rows.schema).count() == len(want)
    old = one_day.withColumn("fetched_at", F.lit("2000-01-01").cast("timestamp_ntz")).withColumn("open", F.lit(-1.0))
    store.merge(path, old, n + 1, part=part)  # an older version doesn't win
    assert store.read(spark, path, rows.schema).where("open = -1").count() == 0
    assert store.merge(path, rows.where("false"), n + 2) and store.read(spark, path, rows.schema).count() == len(want)
    assert store.read(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    store._commit(spark, path, {"number": 1, "folders": {}, "batches": {}})
    with pytest.raises(RuntimeError):
        store._commit(spark, path, {"number": 1, "folders": {}, "batches": {}})


def ticks_of(spark, rows):
    return spark.createDataFrame(rows, "symbol string, s long, event_id long, price double, volume long").select("symbol", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_id", "price", "volume")


def test_late_ticks_within_the_watermark_count(spark, tmp_path):
    """Of two late ticks the one within the watermark changes its bar, the other is left out; a restart lies between."""
    deliveries = [[("A", 30, 1, 10.0, 1), ("A", 3600, 2, 20.0, 1)], [("A", 3590, 3, 5.0, 7), ("A", 7200, 4, 30.0, 1)], [("A", 40, 5, 99.0, 1), ("A", 7100, 6, 31.0, 2)]]
    like = ticks_of(spark, deliveries[0])
    top = str(tmp_path)
    for rows in deliveries:
        ticks_of(spark, rows).coalesce(1).write.mode("append").parquet(f"{top}/in")
        bars = ohlc.tumbling_ohlc(ohlc.file_stream(like, f"{top}/in"), "5 minutes", "10 minutes")
        ohlc.drain(ohlc.merged_into(bars, f"{top}/bars", f"{top}/ck", ("symbol", "date"), part=F.lit("all")))
    got = {r.date.hour * 60 + r.date.minute: (r.open, r.high, r.close_price, r.volume) for r in store.read(spark, f"{top}/bars").collect()}
    assert got == {0: (10.0, 10.0, 10.0, 1), 55: (5.0, 5.0, 5.0, 7), 60: (20.0, 20.0, 20.0, 1), 115: (31.0, 31.0, 31.0, 2), 120: (30.0, 30.0, 30.0, 1)}


def test_polls_are_disjoint(spark, tmp_path):
    rows = A.rewrites(spark, DATA).select("symbol", "date", "close_price", "fetched_at")
    top, found = str(tmp_path), []
    poll = lambda _: found.append(ohlc.poll(ohlc.file_stream(rows, f"{top}/in"), f"{top}/client").collect())
    ohlc.in_deliveries(rows, f"{top}/in", F.floor(F.minute("fetched_at") / 30), 2, poll)
    poll(2)
    assert found[0] and found[1] and not found[2]
    assert not set(found[0]) & set(found[1]) and sorted(map(tuple, found[0] + found[1])) == sorted(map(tuple, rows.collect()))


def test_live_bars_over_restarts(spark, tmp_path):
    """Ticks move the last bar; bad ones, and older ones that come late, don't; a symbol without bars gives none."""
    bars = spark.createDataFrame([("A", 1, 100.0, 101.0, 99.0, 100.0, 7), ("A", 0, 1.0, 1.0, 1.0, 1.0, 1), ("B", 1, 50.0, 50.0, 50.0, 50.0, 3)], "symbol string, s long, open double, high double, low double, close_price double, volume long")
    bars = bars.withColumn("date", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    deliveries = [[("A", 10, 1, 100.5, 1), ("B", 10, 2, 80.0, 1), ("C", 10, 3, 5.0, 1)], [("A", 20, 5, 98.0, 0), ("A", 20, 4, 100.9, 0), ("B", 12, 6, 50.2, 1)], [("A", 15, 7, 100.1, 1), ("B", 13, 8, -1.0, 1)]]
    want = [{"A": (101.0, 99.0, 100.5, True), "B": (50.0, 50.0, 50.0, False)}, {"A": (101.0, 99.0, 100.0, False), "B": (50.2, 50.0, 50.2, True)}, {"A": (101.0, 99.0, 100.0, False), "B": (50.0, 50.0, 50.0, False)}]
    like, top = ticks_of(spark, deliveries[0]), str(tmp_path)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, live.PROVIDER)
    try:
        for rows, state in zip(deliveries, want):
            ticks_of(spark, rows).write.mode("append").parquet(f"{top}/in")
            out = live.live_bars(ohlc.file_stream(like, f"{top}/in"), bars)
            ohlc.drain(ohlc.merged_into(out, f"{top}/bars", f"{top}/ck", ("symbol",), part=F.lit("all")))
            got = {r.symbol: (r.high, r.low, r.close_price, r.moved) for r in store.read(spark, f"{top}/bars").collect()}
            assert got == state
    finally:
        spark.conf.unset(provider)
