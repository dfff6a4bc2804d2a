"""Boundaries and invariants that the tables don't reach."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import bars as B
from tickloom.operators import gex as G
from tickloom.operators import order, profile, series
from tickloom.operators.asof import asof
from tickloom.operators.indicators import atr_wilder, ema, resolve
from tickloom.sources import sinks
from tickloom.sources.readers import repair_log, tickers

BAR = "symbol string, d string, open double, high double, low double, close_price double, volume long"


def bars(spark, rows):
    return spark.createDataFrame(rows, BAR).selectExpr("symbol", "cast(d as timestamp_ntz) date", "open", "high", "low", "close_price", "volume")


def minutes(spark, closes, symbol="A"):
    return bars(spark, [(symbol, f"2024-01-{1 + k // 1440:02d} {k // 60 % 24:02d}:{k % 60:02d}:00", c, c + 1, c - 1, c, 10) for k, c in enumerate(closes)])


def test_asof_limit_is_inclusive_and_never_looks_ahead(spark):
    left = spark.createDataFrame([("A", "2024-01-01 10:15:00"), ("A", "2024-01-01 10:15:01"), ("A", "2024-01-01 09:59:59"), ("B", "2024-01-01 10:01:00"), (None, "2024-01-01 10:01:00")], "symbol string, d string").selectExpr("symbol", "cast(d as timestamp_ntz) date")
    right = spark.createDataFrame([("A", "2024-01-01 10:00:00", 1), ("A", "2024-01-01 10:15:00.5", 2)], "symbol string, t string, v int").selectExpr("symbol", "cast(t as timestamp_ntz) at", "v")
    got = {(r.symbol, r.date.strftime("%H:%M:%S")): r.v for r in asof(left, right, "date", "at").collect()}
    assert got == {("A", "10:15:00"): 1, ("A", "10:15:01"): 2}


def test_recurrences_cross_blocks_and_months(spark):
    closes = [100 + (k * 37 % 101) / 7 for k in range(1500)]
    rows = spark.createDataFrame([("A", k, c) for k, c in enumerate(closes)], "symbol string, k int, c double").selectExpr("symbol", "timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,k) date", "c open", "c+1 high", "c-1 low", "c close_price", "10L volume")
    got = [r.ema for r in ema(rows, 200).orderBy("date").collect()]
    e, want = None, []
    for k, c in enumerate(closes):
        e = sum(closes[:200]) / 200 if k == 199 else e + (c - e) * 2 / 201 if k > 199 else None
        want.append(e)
    assert got[:199] == [None] * 199 and got[199:] == pytest.approx(want[199:], rel=1e-9)
    atr, a = [r.atr for r in atr_wilder(rows).orderBy("date").collect()], None
    for k, c in enumerate(closes):
        t = 2.0 if k == 0 else max(2.0, abs(c + 1 - closes[k - 1]), abs(c - 1 - closes[k - 1]))
        a = t if k == 0 else a + (t - a) / 14
        assert atr[k] == pytest.approx(a, rel=1e-9)


def test_rolling_windows_cross_blocks(spark):
    rows = minutes(spark, [float(k) for k in range(50)])
    got = [r.m for r in series.rolling(series.indexed(rows), 5, {"m": series.mean(F.col("close_price"), 5)}, size=8).orderBy("date").collect()]
    assert got == [None] * 4 + [float(k - 2) for k in range(4, 50)]


def test_ranks_and_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, None)], "x double")
    assert sorted((r.x is None, r.x, r.x_rank) for r in order.average_ranks(rows, ["x"]).collect() if r.x) == [(False, 1.0, 2.0), (False, 2.0, 3.0), (False, 3.0, 4.5), (False, 3.0, 4.5)]
    assert sorted(r.row for r in order.numbered(spark.range(100), ["id"]).collect()) == list(range(100))


def test_profile_shapes_and_volume(spark):
    rows = bars(spark, [
        ("doji", "2024-01-01 00:00:00", 10.0, 11.0, 9.0, 10.0, 100), ("marubozu", "2024-01-01 00:00:00", 9.0, 11.0, 9.0, 11.0, 100), ("tick", "2024-01-01 00:00:00", 10.0, 10.0, 10.0, 10.0, 100),
        ("none", "2024-01-01 00:00:00", 10.0, 11.0, 9.0, 10.0, 0), ("sprint", "2024-01-01 00:00:00", 10.0, 10.5, 9.5, 10.0, 1), ("sprint", "2024-01-01 00:05:00", 10.0, 60.0, 10.0, 11.0, 100),
    ])
    got = {}
    for r in profile.volume_profile(rows).collect():
        got.setdefault(r.symbol, {})[r.bucket] = r.volume
    assert "none" not in got and got["tick"] == {40: 100.0}
    assert sum(got["doji"].values()) == pytest.approx(100) and got["doji"][40] == pytest.approx(100 * 0.55)
    assert all(v == pytest.approx(100 / 9) for v in got["marubozu"].values())
    assert sum(got["sprint"].values()) == pytest.approx(101)


def test_smoothing_keeps_a_flat_profile(spark):
    grid = spark.createDataFrame([("A", k, 2.0) for k in range(6)], "symbol string, bucket long, volume double")
    assert [r.volume for r in profile.smoothed(grid, 1.5).orderBy("bucket").collect()] == pytest.approx([2.0] * 6)
    with pytest.raises(ValueError):
        profile.normalized_columns(spark.createDataFrame([(1.0,)], "Open double"))


def test_value_area(spark):
    grid = spark.createDataFrame([("A", k, float(v)) for k, v in enumerate((1, 2, 4, 2, 1))], "symbol string, bucket long, volume double")
    r = profile.value_area(grid).first()
    assert (r.value_low, r.poc, r.value_high) == (1, 2, 3)


def test_walls_without_a_side_and_hidden_crossings(spark):
    rows = lambda xs: spark.createDataFrame([("U", float(k), float(k * 41), float(g)) for k, g in xs], "underlying string, strike_etf double, strike_futures double, gex double")
    up = rows([(10, 5), (11, 5), (12, 3)])
    assert G.walls(up, "call").first().strike_etf == 10 and G.walls(up, "put").count() == 0 and G.gamma_flip(up, 11.0).count() == 0
    assert G.gamma_flip(rows([(10, -5), (11, 5), (12, 3)]), 11.0).count() == 0  # a sum of exactly 0 hides the crossing
    flip = G.gamma_flip(rows([(10, -4), (11, 8)]), 11.0).first()
    assert flip.strike_etf == 10.5


def test_strikes_without_an_eligible_contract_are_no_strikes(spark):
    """The one between the crossing's neighbours would otherwise move the flip."""
    rows = [("U", "put", 10, 90.0, 0.2, 50, 1), ("U", "call", 10, 95.0, 0.2, 0, 1), ("U", "call", 10, 96.0, 0.001, 70, 1), ("U", "call", 10, 100.0, 0.2, 500, 1)]
    contracts = spark.createDataFrame(rows, "underlying string, side string, days_out int, strike double, implied_volatility double, open_interest long, volume long")
    strikes = G.gex_by_strike(contracts, 95.0, 3914.0)
    got = {r.strike_etf: r.gex for r in strikes.collect()}
    assert set(got) == {90.0, 100.0} and got[90.0] < 0 < got[100.0]
    flip = G.gamma_flip(strikes, 95.0).first().strike_etf
    assert flip == pytest.approx(90 + 10 * -got[90.0] / (-got[90.0] + got[90.0] + got[100.0]), abs=0.01)


def test_upsert_and_ticks(spark):
    rows = minutes(spark, [1.0, 2.0, 3.0])
    assert [r.volume for r in B.tick_bars(rows, 2).orderBy("date").collect()] == [20, 10]
    a = spark.createDataFrame([("A", 1, 10), ("A", 2, 20)], "symbol string, fetched_at int, v int")
    assert B.upsert(a.where("v = 20"), a.where("v = 10"), ("symbol",)).first().v == 20  # an older row doesn't win
    assert tickers(" spy, ,qqq") == ["SPY", "QQQ"] and resolve("sma20", {"sma20": {"period": 9}}).period == 9 and resolve("none") is None


def test_log_with_bad_lines_and_exclusions(spark):
    lines = spark.createDataFrame([("  ES=F 5m 2024-01-05 10:00:00: open 1.5->2.0, high 3->4", 0), ("== total ==", 1), ("  ES=F 1d 2024-01-05: low 7->8", 2), ("  ES=F 5m someday: low 7->8", 3)], "value string, position long")
    got = [(r.field, r.old) for r in repair_log(lines, exclude=("1d",)).orderBy("position").collect()]
    assert got == [("open", 1.5), ("high", 3.0)]


def test_migrations_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0), (2, None)], "id long, old double")
    wide = sinks.copy_column(sinks.add_columns(rows, {"new": "double", "id": "long"}), "old", "new")
    assert wide.columns == ["id", "new"] and wide.where("new is not null").count() == 1
    sinks.write_csv(wide, str(tmp_path / "csv"))
    assert spark.read.option("header", True).schema("id long, new double").csv(str(tmp_path / "csv")).count() == 2
    b = minutes(spark, [1.0]).withColumn("interval_type", F.lit("1m"))
    sinks.write_bars(b, str(tmp_path / "bars"))
    assert spark.read.parquet(str(tmp_path / "bars")).where("interval_type = '1m'").count() == 1


def test_empty_inputs(spark):
    none = minutes(spark, [1.0]).where("false")
    assert B.rollup_minutes(none, 15).count() == 0 and ema(none).count() == 0 and profile.volume_profile(none).count() == 0
    assert B.trim_period(none, "5d").count() == 0 and B.trim_period(none, "max") is none


def test_logarithms_and_rounding_of_what_is_not_finite(spark):
    inf, values = float("inf"), [0.0, -1.0, -2.0, 1.0, 3e18, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", X.rounded(X.ln(F.col("v")), 6).alias("ln"), X.rounded(X.log1p(F.col("v")), 6).alias("log1p"), X.rounded("v", 6).alias("v")).orderBy("i").collect()
    assert [str(r.ln) for r in got] == [str(-inf), "nan", "nan", "0.0", "42.545144", str(inf), "nan", "None"]
    assert [str(r.log1p) for r in got] == ["0.0", str(-inf), "nan", "0.693147", "42.545144", str(inf), "nan", "None"]
    assert [str(r.v) for r in got] == ["0.0", "-1.0", "-2.0", "1.0", "3e+18", "inf", "nan", "None"]


def test_everything_else_works_without_the_optional_parts():
    code = "import sys; sys.modules['tickloom.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'key_levels' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in e.oracle_sql()"
    import os

    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
