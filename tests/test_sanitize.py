"""The sanitizer on literal bars: phantoms, real gaps, the threshold, broken input, ties of witnesses."""

import pytest

from tickloom.operators import sanitize as SA

# name, bar (open, high, low, close), closes of the bars before, share, expected (open, high, low; None: not checked)
CASES = [
    ("phantom", (26748.75, 26849.25, 26748.75, 26848.5), [26848.0], 0.003, (26848.0, 26849.25, 26848.0)),
    ("real gap", (26000, 26010, 25890, 25900), [26000], 0.003, (26000, 26010, 25890)),
    ("gap without witness", (26000, 26010, 25890, 25900), [], 0.003, (25900, None, None)),
    ("normal", (100, 100.5, 99.8, 100.2), [100], 0.003, (100, 100.5, 99.8)),
    ("normal without witness", (100, 100.2, 99.95, 100.2), [], 0.003, (100, 100.2, 99.95)),
    ("phantom high", (100, 150, 99.8, 100.2), [100], 0.003, (100, 100.2, 99.8)),
    ("under the threshold", (997.5, 1000, 997, 1000), [], 0.003, (997.5, 1000, 997)),
    ("exactly the threshold", (997, 1000, 997, 1000), [], 0.003, (997, 1000, 997)),
    ("over the threshold", (995, 1000, 995, 1000), [], 0.003, (1000, 1000, 1000)),
    ("wider threshold", (995, 1000, 995, 1000), [], 0.01, (995, 1000, 995)),
    ("no close", (100, 150, 50, None), [], 0.003, (100, 150, 50)),
    ("zero close", (100, 150, 50, 0), [], 0.003, (100, 150, 50)),
    ("negative close", (100, 150, 50, -5), [], 0.003, (100, 150, 50)),
    ("inverted low", (99.9, 101, 100, 100.1), [], 0.02, (99.9, 101, 99.9)),
    ("inverted high", (100.1, 100, 99, 100), [], 0.02, (100.1, 100.1, 99)),
    ("phantom after phantom", (26840, 26845, 26730, 26840), [26838, 26841, 26839, 26842, 26730], 0.003, (26840, 26845, 26840)),
    ("legitimate move", (26000, 26010, 25890, 25900), [26000, 26000, 25950, 25900, 25900], 0.003, (26000, 26010, 25890)),
    ("only bad witnesses", (26748.75, 26849.25, 26748.75, 26848.5), [0.0, -5.0, 26848.0], 0.003, (26848.0, 26849.25, 26848.0)),
    ("window only", (26748.75, 26849.25, 26748.75, 26848.5), [26848, 26849, 26847.5], 0.003, (26848.0, 26849.25, 26848.0)),
    ("null witness", (100, 150, 99.8, 100.2), [None, 100.0], 0.003, (100, 100.2, 99.8)),
]


@pytest.fixture(scope="module")
def repaired(spark):
    out = {}
    for share in {c[3] for c in CASES}:
        rows = []
        for name, bar, before, s, _ in CASES:
            if s == share:
                closes = [None if x is None else float(x) for x in before]
                rows += [(name, f"2024-01-01 00:{k:02d}:00", x, x, x, x, 1) for k, x in enumerate(closes)]
                rows.append((name, "2024-01-01 01:00:00", *[None if x is None else float(x) for x in bar], 1))
        df = spark.createDataFrame(rows, "symbol string, d string, open double, high double, low double, close_price double, volume long")
        df = df.selectExpr("symbol", "cast(d as timestamp_ntz) date", "open", "high", "low", "close_price", "volume", "'kept' as extra")
        out |= {r.symbol: r for r in SA.sanitized(df, share).where("date = timestamp_ntz '2024-01-01 01:00:00'").collect()}
    return out


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_literal(repaired, case):
    r = repaired[case[0]]
    for got, want in zip((r.new_open, r.new_high, r.new_low), case[4]):
        assert want is None or got == pytest.approx(want)
    assert r.extra == "kept"


def test_bounds(repaired):
    for name, r in repaired.items():
        if r.close_price and r.close_price > 0:
            assert r.new_low <= min(r.new_open, r.close_price) and r.new_high >= max(r.new_open, r.close_price), name
