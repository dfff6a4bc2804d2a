"""Queries over option contracts, gamma snapshots and their levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import expr as X
from tickloom.operators import gex as G
from tickloom.plans import adapters as A
from tickloom.plans.registry import query
from tickloom.schemas import FUTURES_OF

SPOT, FUTURES = 950.0, 39140.0

NEAR = A.ctes("contracts") + """, firsts AS (SELECT underlying, days_out FROM (SELECT underlying, days_out, row_number() OVER (PARTITION BY underlying ORDER BY days_out) AS k FROM (SELECT DISTINCT underlying, days_out FROM contracts WHERE days_out BETWEEN 0 AND 30)) WHERE k <= 4),
near AS (SELECT c.* FROM contracts c JOIN firsts f ON c.underlying = f.underlying AND c.days_out = f.days_out)"""
STRIKES = NEAR + f""", g AS (SELECT *, CASE WHEN side = 'call' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn, greatest(days_out / 365.0::DOUBLE, 1.0::DOUBLE / 365) AS t, implied_volatility AS v FROM near WHERE strike > 0 AND open_interest > 0 AND implied_volatility >= 0.01),
a AS (SELECT *, exp(-0.5::DOUBLE * d1 * d1) / sqrt(2 * pi()) / ({SPOT}::DOUBLE * v * sqrt(t)) * open_interest * 100 * {SPOT}::DOUBLE AS amt
    FROM (SELECT *, (ln({SPOT}::DOUBLE / strike) + (0.05::DOUBLE + v * v / 2) * t) / nullif(v * sqrt(t), 0) AS d1 FROM g)),
s AS (SELECT underlying, strike, sum(CASE WHEN sgn > 0 THEN amt ELSE 0 END) AS gc, sum(CASE WHEN sgn < 0 THEN -amt ELSE 0 END) AS gp,
    sum(CASE WHEN days_out <= 0 THEN sgn * amt ELSE 0 END) AS g0, sum(CASE WHEN days_out = 1 THEN sgn * amt ELSE 0 END) AS g1, sum(CASE WHEN days_out > 1 AND days_out <= 7 THEN sgn * amt ELSE 0 END) AS gw, sum(CASE WHEN days_out > 7 THEN sgn * amt ELSE 0 END) AS gm FROM a GROUP BY underlying, strike),
strikes AS (SELECT underlying, strike AS strike_etf, floor(strike * (floor({FUTURES}::DOUBLE / {SPOT}::DOUBLE * 10000 + 0.5) / 10000) * 100 + 0.5) / 100 AS strike_futures, floor((gc + gp) * 100 + 0.5) / 100 AS gex, floor(gc * 100 + 0.5) / 100 AS gex_call, floor(gp * 100 + 0.5) / 100 AS gex_put,
    floor(g0 * 100 + 0.5) / 100 AS gex_0dte, floor(g1 * 100 + 0.5) / 100 AS gex_1dte, floor(gw * 100 + 0.5) / 100 AS gex_weekly, floor(gm * 100 + 0.5) / 100 AS gex_monthly FROM s)"""
FLIP = """, run AS (SELECT *, sum(gex) OVER (PARTITION BY underlying ORDER BY strike_etf ROWS UNBOUNDED PRECEDING) AS cum FROM strikes),
lagged AS (SELECT *, lag(cum) OVER w AS pc, lag(strike_etf) OVER w AS pe, lag(strike_futures) OVER w AS pf FROM run WINDOW w AS (PARTITION BY underlying ORDER BY strike_etf)),
crossed AS (SELECT underlying, strike_etf AS k, pe + abs(pc) / (abs(pc) + abs(cum)) * (strike_etf - pe) AS e, pf + abs(pc) / (abs(pc) + abs(cum)) * (strike_futures - pf) AS f FROM lagged WHERE pc * cum < 0),
flip AS (SELECT underlying, floor(e * 100 + 0.5) / 100 AS strike_etf, floor(f * 100 + 0.5) / 100 AS strike_futures FROM (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY abs(e - 950.0::DOUBLE), k) AS r FROM crossed) WHERE r = 1)"""
EXTRA = "gex_call, gex_put, gex_0dte, gex_1dte, gex_weekly, gex_monthly"
RANKED = """, pos AS (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY gex DESC, strike_etf) AS r FROM strikes WHERE gex > 0),
neg AS (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY gex, strike_etf) AS r FROM strikes WHERE gex < 0)"""


def _near(spark, d):
    return G.near_expirations(A.contracts(spark, d))


def _strikes(spark, d):
    return G.gex_by_strike(_near(spark, d), SPOT, FUTURES)


@query("filter_expirations", NEAR + " SELECT underlying, days_out, count(*) AS n FROM near GROUP BY underlying, days_out")
def _(spark, d):
    return _near(spark, d).groupBy("underlying", "days_out").agg(F.count("*").alias("n"))


@query("filter_contracts", A.ctes("contracts") + """ SELECT underlying, side, count(*) AS n, count(*) FILTER (WHERE open_interest > 0 AND implied_volatility >= 0.01) AS n_gex, count(*) FILTER (WHERE implied_volatility >= 0.01) AS n_iv,
sum(volume)::BIGINT AS volume, sum(open_interest)::BIGINT AS open_interest FROM contracts GROUP BY underlying, side""")
def _(spark, d):
    iv = F.col("implied_volatility") >= 0.01
    return A.contracts(spark, d).groupBy("underlying", "side").agg(F.count("*").alias("n"), F.count_if((F.col("open_interest") > 0) & iv).alias("n_gex"), F.count_if(iv).alias("n_iv"), F.sum("volume").alias("volume"), F.sum("open_interest").alias("open_interest"))


query("agg_gex_by_strike", STRIKES + f" SELECT underlying, strike_etf, strike_futures, gex, {EXTRA} FROM strikes")(_strikes)


@query("agg_pcr", A.ctes("contracts") + """, t AS (SELECT underlying, sum(CASE WHEN side = 'put' THEN volume ELSE 0 END)::DOUBLE AS pv, sum(CASE WHEN side = 'call' THEN volume ELSE 0 END)::DOUBLE AS cv,
sum(CASE WHEN side = 'put' THEN open_interest ELSE 0 END)::DOUBLE AS po, sum(CASE WHEN side = 'call' THEN open_interest ELSE 0 END)::DOUBLE AS co FROM contracts GROUP BY underlying)
SELECT underlying, floor(pv / greatest(cv, 1) * 10000 + 0.5) / 10000 AS pcr_volume, floor(po / greatest(co, 1) * 10000 + 0.5) / 10000 AS pcr_oi FROM t""")
def _(spark, d):
    return G.put_call_ratios(A.contracts(spark, d))


BOTH = NEAR + """, iv AS (SELECT underlying, strike, avg(CASE WHEN side = 'call' AND implied_volatility >= 0.01 THEN implied_volatility END) AS c, avg(CASE WHEN side = 'put' AND implied_volatility >= 0.01 THEN implied_volatility END) AS p FROM near GROUP BY underlying, strike),
both_sides AS (SELECT * FROM iv WHERE c IS NOT NULL AND p IS NOT NULL)"""


@query("agg_iv_atm", BOTH + f" SELECT underlying, floor((c + p) / 2 * 10000 + 0.5) / 10000 AS iv_atm FROM (SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY abs(strike - {SPOT}::DOUBLE), strike) AS r FROM both_sides) WHERE r = 1")
def _(spark, d):
    return G.iv_atm(_near(spark, d), SPOT)


@query("agg_iv_skew", NEAR + f""" SELECT underlying, floor((avg(CASE WHEN side = 'put' AND implied_volatility >= 0.01 AND strike BETWEEN 0.90::DOUBLE * {SPOT}::DOUBLE AND 0.97::DOUBLE * {SPOT}::DOUBLE THEN implied_volatility END)
- avg(CASE WHEN side = 'call' AND implied_volatility >= 0.01 AND strike BETWEEN 1.03::DOUBLE * {SPOT}::DOUBLE AND 1.10::DOUBLE * {SPOT}::DOUBLE THEN implied_volatility END)) * 10000 + 0.5) / 10000 AS iv_skew FROM near GROUP BY underlying""")
def _(spark, d):
    return G.iv_skew(_near(spark, d), SPOT)


@query("join_strikes_both", BOTH + " SELECT underlying, strike FROM both_sides")
def _(spark, d):
    return G.iv_by_strike(_near(spark, d)).select("underlying", "strike")


@query("set_intersect_strikes", NEAR + " SELECT underlying, strike FROM near WHERE side = 'call' AND implied_volatility >= 0.01 INTERSECT SELECT underlying, strike FROM near WHERE side = 'put' AND implied_volatility >= 0.01")
def _(spark, d):
    n = _near(spark, d).where("implied_volatility >= 0.01")
    return n.where("side = 'call'").select("underlying", "strike").intersect(n.where("side = 'put'").select("underlying", "strike"))


for _side, _table in (("call", "pos"), ("put", "neg")):
    query(f"top_{_side}_wall", STRIKES + RANKED + f" SELECT underlying, strike_etf, strike_futures, gex, {EXTRA} FROM {_table} WHERE r = 1")(lambda spark, d, side=_side: G.walls(_strikes(spark, d), side))


@query("top_significant", STRIKES + RANKED + " SELECT underlying, 'pos' AS sign, r - 1 AS k, strike_etf, gex FROM pos WHERE r BETWEEN 2 AND 4 UNION ALL SELECT underlying, 'neg', r - 1, strike_etf, gex FROM neg WHERE r BETWEEN 2 AND 4")
def _(spark, d):
    s = _strikes(spark, d)
    pick = lambda sign: G.significant(s, sign == "pos").select("underlying", F.lit(sign).alias("sign"), F.col("k").cast("long").alias("k"), "strike_etf", "gex")
    return pick("pos").unionByName(pick("neg"))


@query("win_gamma_flip", STRIKES + FLIP + " SELECT * FROM flip")
def _(spark, d):
    return G.gamma_flip(_strikes(spark, d), SPOT)


def _pivot_sql(zero: str) -> str:
    def fill(x: str) -> str:
        return f"CASE WHEN max(gex_0dte IS NOT NULL) THEN coalesce({x}, 0) END" if zero else x

    return A.ctes("snapshots", "levels") + f""", p AS (SELECT s.symbol, s.computed_at, max(CASE WHEN label = 'call_wall' THEN strike_etf END) AS call_wall, max(CASE WHEN label = 'put_wall' THEN strike_etf END) AS put_wall, max(CASE WHEN label = 'zero_gamma' THEN strike_etf END) AS zero_gamma,
max(CASE WHEN label = 'call_wall' THEN gex END) AS call_wall_gex, max(CASE WHEN label = 'put_wall' THEN gex END) AS put_wall_gex, {fill("max(CASE WHEN label = 'call_wall' THEN gex_0dte END)")} AS call_wall_0dte_gex, {fill("max(CASE WHEN label = 'put_wall' THEN gex_0dte END)")} AS put_wall_0dte_gex,
sum(gex) AS net_gex, sum(abs(gex)) AS abs_gex_total, sum(gex * gex) AS sum_gex_squared, sum(gex_0dte) AS net_gex_0dte_raw, sum(abs(gex_0dte)) AS abs_gex_0dte_total FROM snapshots s JOIN levels l ON s.id = l.gamma_exposure_id GROUP BY s.symbol, s.computed_at)"""


@query("agg_snapshot_pivot", _pivot_sql("") + " SELECT * FROM p")
def _(spark, d):
    return G.snapshot_pivot(A.snapshots(spark, d), A.levels(spark, d))


@query("agg_snapshot_pivot_rest", _pivot_sql("0") + " SELECT * FROM p")
def _(spark, d):
    return G.snapshot_pivot(A.snapshots(spark, d), A.levels(spark, d), null_as_zero=True)


RATIOS = _pivot_sql("") + """, ratios AS (SELECT symbol, computed_at, call_wall, put_wall, zero_gamma, net_gex, abs_gex_total, sum_gex_squared / nullif(abs_gex_total, 0) / nullif(abs_gex_total, 0) AS gex_concentration, abs(call_wall_gex) / nullif(abs_gex_total, 0) AS call_wall_strength, abs(put_wall_gex) / nullif(abs_gex_total, 0) AS put_wall_strength,
abs_gex_0dte_total / nullif(abs_gex_total, 0) AS gex_0dte_fraction, net_gex_0dte_raw / nullif(abs_gex_0dte_total, 0) AS gex_0dte_polarity, call_wall_0dte_gex / nullif(abs_gex_total, 0) AS call_wall_0dte_share, put_wall_0dte_gex / nullif(abs_gex_total, 0) AS put_wall_0dte_share FROM p)"""


@query("agg_snapshot_ratios", RATIOS + " SELECT * FROM ratios")
def _(spark, d):
    return G.snapshot_ratios(G.snapshot_pivot(A.snapshots(spark, d), A.levels(spark, d)))


@query("join_exposure_levels", A.ctes("snapshots", "levels") + " SELECT s.id, s.computed_at, l.label, l.strike_etf, l.gex FROM snapshots s JOIN levels l ON s.id = l.gamma_exposure_id WHERE s.symbol = 'ALL'")
def _(spark, d):
    s = A.snapshots(spark, d).where("symbol = 'ALL'").select("id", "computed_at")
    return s.join(A.levels(spark, d).select("gamma_exposure_id", "label", "strike_etf", "gex"), F.col("id") == F.col("gamma_exposure_id")).drop("gamma_exposure_id")


@query("join_semi_valid", A.ctes("snapshots", "levels") + " SELECT s.id, s.computed_at FROM snapshots s WHERE etf_price IS NOT NULL AND futures_price IS NOT NULL AND EXISTS (SELECT 1 FROM levels l WHERE l.gamma_exposure_id = s.id AND strike_etf IS NOT NULL AND strike_futures IS NOT NULL)")
def _(spark, d):
    return G.with_usable_levels(A.snapshots(spark, d), A.levels(spark, d)).select("id", "computed_at")


@query("join_anti_notin", A.ctes("snapshots", "levels") + " SELECT id FROM snapshots WHERE id NOT IN (SELECT DISTINCT gamma_exposure_id FROM levels WHERE strike_etf IS NOT NULL)")
def _(spark, d):
    return G.orphans(A.snapshots(spark, d), A.levels(spark, d).where("strike_etf is not null")).select("id")


@query("join_one_to_many", A.ctes("snapshots", "levels") + " SELECT s.id, string_agg(label || '=' || gex::BIGINT, ',' ORDER BY l.id) AS levels FROM snapshots s LEFT JOIN levels l ON s.id = l.gamma_exposure_id GROUP BY s.id")
def _(spark, d):
    lv = A.levels(spark, d).select(F.col("id").alias("level_id"), "gamma_exposure_id", F.concat("label", F.lit("="), F.col("gex").cast("long").cast("string")).alias("t"))
    per = lv.groupBy("gamma_exposure_id").agg(F.array_sort(F.collect_list(F.struct("level_id", "t"))).alias("l"))
    s = A.snapshots(spark, d).select("id")
    return s.join(per, s["id"] == per["gamma_exposure_id"], "left").select("id", F.array_join(F.transform("l", lambda x: x["t"]), ",").alias("levels"))


@query("filter_levels_with_strike", A.ctes("levels") + " SELECT id, gamma_exposure_id, strike_futures FROM levels WHERE strike_futures IS NOT NULL")
def _(spark, d):
    return A.levels(spark, d).where("strike_futures is not null").select("id", "gamma_exposure_id", "strike_futures")


@query("top_latest", A.ctes("snapshots", "levels") + """, m AS (SELECT s.*, EXISTS (SELECT 1 FROM levels l WHERE l.gamma_exposure_id = s.id AND l.strike_futures IS NOT NULL) AS valid FROM snapshots s)
SELECT symbol, id, computed_at, etf_price, valid FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY valid DESC, computed_at DESC) AS r FROM m) WHERE r = 1""")
def _(spark, d):
    return G.latest_valid(A.snapshots(spark, d), A.levels(spark, d)).select("symbol", "id", "computed_at", "etf_price", "valid")


_GOOD = A.ctes("snapshots", "levels") + """, ok AS (SELECT s.* FROM snapshots s WHERE etf_price IS NOT NULL AND futures_price IS NOT NULL AND EXISTS (SELECT 1 FROM levels l WHERE l.gamma_exposure_id = s.id AND strike_etf IS NOT NULL AND strike_futures IS NOT NULL)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY computed_at DESC) AS r FROM ok) WHERE r = 1)"""


@query("sink_gex_fallback", _GOOD + " SELECT b.id AS from_id, b.symbol, b.etf_price, b.conversion_ratio, false AS market_open, l.label, l.strike_etf, l.gex FROM best b JOIN levels l ON b.id = l.gamma_exposure_id WHERE l.strike_etf IS NOT NULL AND l.strike_futures IS NOT NULL")
def _(spark, d):
    parent, lv = G.fallback(A.snapshots(spark, d), A.levels(spark, d))
    return parent.join(lv, F.col("from_id") == F.col("gamma_exposure_id")).select("from_id", "symbol", "etf_price", "conversion_ratio", "market_open", "label", "strike_etf", "gex")


@query("sink_backfill_delete", A.ctes("snapshots", "levels") + " SELECT id FROM snapshots WHERE etf_price IS NOT NULL AND futures_price IS NOT NULL AND id IN (SELECT gamma_exposure_id FROM levels WHERE strike_etf IS NOT NULL AND strike_futures IS NOT NULL)")
def _(spark, d):
    return G.clean_up(A.snapshots(spark, d), A.levels(spark, d))[0].select("id")


LEVELS = STRIKES + FLIP + RANKED + f""", levels AS (SELECT underlying, 'call_wall' AS label, 1 AS place, strike_etf, strike_futures, gex, {EXTRA} FROM pos WHERE r = 1
UNION ALL SELECT underlying, 'put_wall', 1, strike_etf, strike_futures, gex, {EXTRA} FROM neg WHERE r = 1
UNION ALL SELECT underlying, 'zero_gamma', 1, strike_etf, strike_futures, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0 FROM flip
UNION ALL SELECT underlying, 'significant_pos', (r - 1)::INT, strike_etf, strike_futures, gex, {EXTRA} FROM pos WHERE r BETWEEN 2 AND 4
UNION ALL SELECT underlying, 'significant_neg', (r - 1)::INT, strike_etf, strike_futures, gex, {EXTRA} FROM neg WHERE r BETWEEN 2 AND 4)"""
query("key_levels", LEVELS + " SELECT * FROM levels")(lambda spark, d: G.key_levels(_strikes(spark, d), SPOT))


@query("sink_insert_gex", LEVELS + f" SELECT underlying AS symbol, {SPOT}::DOUBLE AS etf_price, {FUTURES}::DOUBLE AS futures_price, label, place, strike_etf, gex, gex_0dte FROM levels")
def _(spark, d):
    """Snapshots and their levels, written under deterministic keys, read again and joined on them; the keys, hashes, have no SQL form."""
    from tickloom.sources.sinks import fresh_path, gex_rows, write_gex

    parents, children = gex_rows(_strikes(spark, d), SPOT, FUTURES, "2024-01-31 00:00:00")
    path = fresh_path(spark)
    write_gex(parents, children, path)
    joined = spark.read.parquet(f"{path}/gamma_levels").join(spark.read.parquet(f"{path}/gamma_exposure"), "snapshot_key")
    return joined.select("symbol", "etf_price", "futures_price", "label", "place", "strike_etf", "gex", "gex_0dte")


@query("join_dim_lookup", "SELECT e.event_id, e.symbol, m.f AS futures FROM (SELECT event_id, ['QQQ', 'SPY', 'IWM', 'DIA', 'AAPL'][event_id % 5 + 1] AS symbol FROM events) e LEFT JOIN (VALUES ('QQQ', 'NQ=F'), ('SPY', 'ES=F'), ('IWM', 'RTY=F'), ('DIA', 'YM=F')) m(e, f) ON e.symbol = m.e")
def _(spark, d):
    """The futures of each event's fund; one (AAPL) has none."""
    pairs = F.create_map(*[F.lit(x) for kv in FUTURES_OF.items() for x in kv])
    symbol = F.element_at(F.array(*map(F.lit, (*FUTURES_OF, "AAPL"))), (F.col("event_id") % 5 + 1).cast("int"))
    return A.table(spark, d, "events").select("event_id", symbol.alias("symbol")).withColumn("futures", F.try_element_at(pairs, F.col("symbol")))


@query("proj_gex_price", A.ctes("levels") + """ SELECT id, etf_price, fut_price, label FROM (SELECT id, strike_etf AS etf_price, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE strike_futures END, strike_etf * 41.2::DOUBLE) AS fut_price,
(CASE WHEN gex < 0 THEN '-' ELSE '' END) || (abs(gex)::BIGINT // 1000) || '.' || ((abs(gex)::BIGINT % 1000) // 100) || 'M' AS label FROM levels) WHERE fut_price IS NOT NULL AND fut_price <> 0""")
def _(spark, d):
    lv = A.levels(spark, d)
    fut = F.coalesce(F.when(F.col("id") % 3 != 0, F.col("strike_futures")), F.col("strike_etf") * 41.2)
    whole = F.abs("gex").cast("long")
    label = F.concat(F.when(F.col("gex") < 0, "-").otherwise(""), F.floor(whole / 1000).cast("string"), F.lit("."), F.floor(whole % 1000 / 100).cast("string"), F.lit("M"))
    return lv.select("id", F.col("strike_etf").alias("etf_price"), fut.alias("fut_price"), label.alias("label")).where("fut_price is not null and fut_price <> 0")


@query("fn_bs_gamma", A.ctes("contracts") + f""" SELECT strike, days_out, floor(implied_volatility * 100 + 0.5)::BIGINT AS iv_pct, floor(max(CASE WHEN implied_volatility <= 0 THEN 0 ELSE exp(-0.5::DOUBLE * d1 * d1) / sqrt(2 * pi()) / ({SPOT}::DOUBLE * implied_volatility * sqrt(t)) END) * 1e9 + 0.5) / 1e9 AS gamma
FROM (SELECT *, (ln({SPOT}::DOUBLE / strike) + (0.05::DOUBLE + implied_volatility * implied_volatility / 2) * t) / nullif(implied_volatility * sqrt(t), 0) AS d1 FROM (SELECT *, greatest(days_out / 365.0::DOUBLE, 1.0::DOUBLE / 365) AS t FROM contracts)) GROUP BY ALL""")
def _(spark, d):
    g = X.bs_gamma(F.lit(SPOT), F.col("strike"), X.years_to_expiry(F.col("days_out")), F.col("implied_volatility"))
    return A.contracts(spark, d).groupBy("strike", "days_out", F.floor(F.col("implied_volatility") * 100 + 0.5).cast("long").alias("iv_pct")).agg(X.rounded(F.max(g), 9).alias("gamma"))


@query("fn_dte_bucket", A.ctes("contracts") + " SELECT CASE WHEN days_out <= 0 THEN '0dte' WHEN days_out = 1 THEN '1dte' WHEN days_out <= 7 THEN 'weekly' ELSE 'monthly' END AS bucket, count(*) AS n, floor(max(greatest(days_out / 365.0::DOUBLE, 1.0::DOUBLE / 365)) * 1e6 + 0.5) / 1e6 AS years FROM contracts GROUP BY 1")
def _(spark, d):
    return A.contracts(spark, d).groupBy(X.dte_bucket(F.col("days_out")).alias("bucket")).agg(F.count("*").alias("n"), X.rounded(F.max(X.years_to_expiry(F.col("days_out"))), 6).alias("years"))


@query("fn_conversion_ratio", A.ctes("snapshots") + " SELECT id, floor(futures_price / nullif(etf_price, 0) * 10000 + 0.5) / 10000 AS conversion_ratio FROM snapshots")
def _(spark, d):
    return A.snapshots(spark, d).select("id", X.rounded(X.ratio(F.col("futures_price"), F.col("etf_price")), 4).alias("conversion_ratio"))
