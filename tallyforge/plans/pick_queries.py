"""Queries of all gates, both scores and what follows a ranking, and their SQL.

The tables' prices are no real ones: at the shipped limits hardly any quote passes, so the queries loosen them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import fundamentals as FU
from tallyforge.operators import picks as PK
from tallyforge.operators import series as S
from tallyforge.plans.score_queries import _ASKED, _FACTORS, _QUOTES, _asked, quotes
from tallyforge.plans.series_queries import SQL as SERIES
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

LOOSE = PK.Limits(range=30, cagr=-25, cagr_life=-30, floor_1y=-80, floor_5y=-80, floor_8y=-90, drop_1m=60, maxdd=98, vol=500, vol_coin=400, daily=3500, peg=-5, margin=4.5, swing=1.5, dilution=40, cover=8, fcf=3.2, turnover=1000)
NOTCH = PK.Limits(**{**LOOSE.__dict__, "range": 20, "maxdd": 98.5, "cover": 7.5, "margin": 4.2, "fcf": 3, "swing": 2})
W = PK.Weights(value=0.5)
DAY = "2001-03-31"
NAMES = ["Fund 3x Long", "USD Coin", "Physical Gold", "World Fund", "Inverse Bond"]


def full(s, d):
    """Quotes with horizon returns, factors as of a day, yields, class and what coins and funds have."""
    h = S.horizon_changes(T.bars(s, d)).groupBy("ticker").pivot("horizon", ["1M", "1Y", "5Y", "8Y", "20Y"]).agg(F.first("change"))
    h = h.select("ticker", *[F.col(c).alias(f"ret_{c.lower()}") for c in ("1M", "1Y", "5Y", "8Y", "20Y")])
    f = FU.factors(_asked(s, d).filter(F.col("cutoff") == DAY), T.filings(s, d)).select("ticker", "eps_growth", "net_margin", "margin_stability", "buyback", "interest_cover", "fcf_margin", "quality", "roic", "net_debt")
    last = FU.as_of(_asked(s, d).filter(F.col("cutoff") == DAY), T.filings(s, d)).select("ticker", F.col("f.eps").alias("eps"), F.col("f.revenue").alias("revenue"))
    px = T.bars(s, d).groupBy("ticker").agg(F.max_by("close", "bar_date").alias("price"))
    inc = S.income(T.bars(s, d), T.dividends(s, d), T.splits(s, d)).select("ticker", "yield_1y")
    rows = quotes(s, d).join(h, "ticker", "left").join(f, "ticker", "left").join(last, "ticker", "left").join(px, "ticker", "left").join(inc, "ticker", "left")
    v = FU.valuation(F.col("price"), F.col("eps"), F.col("eps_growth"), *[F.lit(None).cast("double")] * 3)
    k = F.substring("ticker", 2, 9).cast("int")
    return rows.withColumns({"earnings_yield": v["earnings_yield"], "peg_yield": v["peg_yield"], "net_cash_rev": -F.col("net_debt") / F.col("revenue") * 100, "eps_never": F.col("eps").isNull(), "aum": k * 1e6, "mvrv": k / 10, "eu_payer": F.col("market") == "EUROPE"})


def _scored(s, d):
    rows = full(s, d).withColumns({"failed": PK.failed(LOOSE), "growth": F.round(PK.growth_score(W), 6), "sale": F.round(PK.on_sale_score(W), 6)})
    return rows


def _refilled(s, d):
    rows = _scored(s, d).withColumns({"score": F.col("growth"), "base": F.substring("ticker", 1, 3), "pinned": F.endswith("ticker", F.lit("5"))}).filter("score IS NOT NULL")
    return PK.refilled(rows, "market", 5, 2)


def _damps(s, d):
    rows = T.table(s, d, "part").select("p_partkey", (F.col("p_size") / 10).alias("ter"), (F.col("p_size") % 7).cast("double").alias("y"), (F.col("p_partkey") % 3 == 0).alias("acc"), (F.col("p_retailprice") % 2 - 0.5).alias("nupl"))
    return rows.select("p_partkey", F.round(PK.damps(F.col("ter"), F.col("y"), F.col("acc")), 6).alias("damp"), F.round(PK.coin_factor(F.col("nupl"), F.col("ter") * 40 - 50, F.col("y") * 20), 6).alias("coin"))


QUERIES = {
    "gates_all": lambda s, d: _scored(s, d).select("ticker", F.array_join("failed", "+").alias("failed")),
    "gates_near_misses": lambda s, d: PK.near_misses(full(s, d), LOOSE, NOTCH),
    "score_growth": lambda s, d: _scored(s, d).select("ticker", F.col("growth").alias("score"), F.round(PK.long_leg("cagr"), 6).alias("long_cagr"), PK.long_leg("years").alias("years")),
    "score_on_sale": lambda s, d: _scored(s, d).select("ticker", F.col("sale").alias("score")),
    "score_damps": _damps,
    "picks_refilled": _refilled,
    "picks_refusals": lambda s, d: T.table(s, d, "part").select("p_partkey", PK.refusal(F.concat_ws(" ", "p_name", F.get(F.array(*map(F.lit, NAMES)), F.col("p_partkey") % 5))).alias("refusal")),
}

_LEG = "CASE WHEN ret_20y IS NOT NULL THEN (power(greatest(1 + ret_20y / 100, 1e-9), 0.05::DOUBLE) - 1) * 100 WHEN ret_8y IS NOT NULL THEN (power(greatest(1 + ret_8y / 100, 1e-9), 0.125::DOUBLE) - 1) * 100 WHEN ret_5y IS NOT NULL THEN (power(greatest(1 + ret_5y / 100, 1e-9), 0.2::DOUBLE) - 1) * 100 END"
_FULL = _QUOTES + ", " + VIEWS["bars"] + ", " + VIEWS["filings"] + ", " + _ASKED + _FACTORS + f""", hz AS ({SERIES['horizon_changes']}), ic AS ({SERIES['series_income']}),
h AS (SELECT ticker, max(change) FILTER (WHERE horizon = '1M') AS ret_1m, max(change) FILTER (WHERE horizon = '1Y') AS ret_1y, max(change) FILTER (WHERE horizon = '5Y') AS ret_5y, max(change) FILTER (WHERE horizon = '8Y') AS ret_8y, max(change) FILTER (WHERE horizon = '20Y') AS ret_20y FROM hz GROUP BY 1),
fa AS (SELECT ticker, eps_growth, net_margin, margin_stability, buyback, interest_cover, fcf_margin, quality, roic, net_debt FROM factors WHERE cutoff = DATE '{DAY}'), la AS (SELECT a.ticker, f.eps, f.revenue FROM asked a ASOF LEFT JOIN filings f ON a.ticker = f.ticker AND a.cutoff >= f.filed WHERE a.cutoff = DATE '{DAY}'),
px AS (SELECT ticker, arg_max(close, bar_date) AS price FROM bars GROUP BY 1),
f0 AS (SELECT quotes.*, h.* EXCLUDE (ticker), fa.* EXCLUDE (ticker), la.eps, la.revenue, price, yield_1y, substr(quotes.ticker, 2)::INT AS k FROM quotes LEFT JOIN h USING (ticker) LEFT JOIN fa USING (ticker) LEFT JOIN la USING (ticker) LEFT JOIN px USING (ticker) LEFT JOIN ic USING (ticker)),
f1 AS (SELECT *, CASE WHEN price > 0 THEN eps / price * 100 END AS earnings_yield, -net_debt / revenue * 100 AS net_cash_rev, k * 1e6 AS aum, k / 10 AS mvrv, {_LEG} AS leg, CASE WHEN ret_20y IS NOT NULL THEN 20 WHEN ret_8y IS NOT NULL THEN 8 WHEN ret_5y IS NOT NULL THEN 5 END::DOUBLE AS legy FROM f0),
fq AS (SELECT *, CASE WHEN earnings_yield > 0 AND eps_growth > 0 THEN earnings_yield * eps_growth END AS peg_yield FROM f1)"""


def _failed_sql(k: PK.Limits) -> str:
    tests = [
        ("young", f"age_years < {k.young}"), ("range", f"pct_rank < {k.range}"), ("cagr", f"leg < {k.cagr}"), ("cagr-life", f"coalesce(capped_cagr, life_cagr) < {k.cagr_life}"), ("1Y+", f"ret_1y <= {k.floor_1y}"), ("5Y+", f"ret_5y <= {k.floor_5y}"), ("8Y+", f"ret_8y <= {k.floor_8y}"),
        ("1M", f"ret_1m < {-k.drop_1m}"), ("history", "legy IS NULL"), ("maxdd", f"max_drawdown > {k.maxdd}"), ("stretch", f"above_ma > {k.stretch}"), ("uptrend", "life_return <= 0"), ("vol-coin", f"class = 0 AND volatility > {k.vol_coin}"), ("vol", f"class <> 0 AND volatility > {k.vol}"),
        ("daily", f"class <> 0 AND max_daily > {k.daily}"), ("aum", f"class = 1 AND aum < {k.aum}"), ("peg", f"class = 2 AND (peg_yield < {k.peg} OR eps <= 0)"), ("no-eps", "class = 2 AND eps IS NULL"), ("margin", f"class = 2 AND net_margin < {k.margin}"), ("swing", f"class = 2 AND -margin_stability > {k.swing}"),
        ("dilution", f"class = 2 AND -buyback > {k.dilution}"), ("cover", f"class = 2 AND interest_cover < {k.cover}"), ("fcf", f"class = 2 AND fcf_margin < {k.fcf}"), ("cash", f"class = 2 AND net_cash_rev < {k.cash}"), ("mvrv", f"class = 0 AND mvrv > {k.mvrv}"), ("turnover", f"avg_turnover < {k.turnover}"),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests) + "], lambda x: x IS NOT NULL)"


_GROWTH = f"""round((0.15 * least(leg, 30.0) + 0.5 * coalesce(greatest(0, least(ret_1y - leg, 50.0)), 0) + 2 * least(coalesce(leg / nullif(volatility, 0), 0), 3.0) + 2 * least(coalesce(leg / nullif(max_drawdown, 0), 0), 3.0) + 0.15 * greatest(0, least(coalesce(quality, 0), 40.0))
  + 0.5 * least(coalesce(yield_1y, 0), 6.0) * CASE WHEN market = 'EUROPE' THEN 0.76 ELSE 0.72 END + 0.07 * greatest(0, least(coalesce(peg_yield, 0), 300.0)) + 0.25 * greatest(0, least(coalesce(roic, 17.3), 40.0)) + 5 * coalesce(trend_r2, 0) - 0.1 * coalesce(underwater_years, 0))
  * greatest(0, 1 + (pct_rank / 100 - 1)) * (1 + {W.value} * (coalesce(greatest(0.5, least(20 * earnings_yield / 100, 1.5)), 1) - 1)) * sqrt((CASE WHEN legy >= 10 THEN 1.0 ELSE 0.5 END) * (1 - 0.5 * least(above_ma / 150.0, 1.0))) + 0.1 * ln(greatest(avg_turnover, 1.0) / 1e9), 6)"""

SQL = {
    "gates_all": _FULL + f" SELECT ticker, array_to_string({_failed_sql(LOOSE)}, '+') AS failed FROM fq",
    "gates_near_misses": _FULL + f", x AS (SELECT ticker, pct_rank, {_failed_sql(LOOSE)} AS f, {_failed_sql(NOTCH)} AS g FROM fq), r AS (SELECT f[1] AS gate, ticker, row_number() OVER (PARTITION BY f[1] ORDER BY pct_rank DESC, ticker) AS place FROM x WHERE len(f) = 1 AND len(g) = 0) SELECT gate, place::INT AS place, ticker FROM r WHERE place <= 15",
    "score_growth": _FULL + f" SELECT ticker, {_GROWTH} AS score, round(leg, 6) AS long_cagr, legy AS years FROM fq",
    "score_on_sale": _FULL + """ SELECT ticker, round((100 * (100 - pct_rank) / 100 * CASE WHEN leg > 0 THEN 1.0 ELSE 0.5 END * CASE WHEN ret_1m >= 0 THEN 1.0 ELSE 0.8 END + 0.5 * greatest(0, least(leg, 30.0)) + 10 * greatest(0, least(coalesce(earnings_yield / 100, 0), 1.0)) + 0.5 * least(coalesce(yield_1y, 0), 6.0))
  * sqrt((1 - least(from_high / 200, 0.5)) * (CASE WHEN legy >= 10 THEN 1.0 ELSE 0.5 END)), 6) AS score FROM fq""",
    "score_damps": """WITH x AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS t, (p_size % 7)::DOUBLE AS y, p_partkey % 3 = 0 AS a, p_retailprice % 2 - 0.5 AS n FROM part)
SELECT p_partkey, round(power(1 - t / 100, 20) * CASE WHEN a THEN power(1 - y / 100 * 0.28, 20) ELSE 1 END, 6) AS damp, round(CASE WHEN n < 0 THEN 1.2 WHEN n > 0.75 THEN 1 - 0.5 * (n - 0.75) / 0.25 ELSE 1 END * greatest(0.5, least(1 + 0.3 * (t * 40 - 50 - y * 20) / 100, 2.0)), 6) AS coin FROM x""",
    "picks_refilled": _FULL + f""", x AS (SELECT market, sector, ticker, {_GROWTH} AS score, substr(ticker, 1, 3) AS base, ends_with(ticker, '5') AS pinned FROM fq), tw AS (SELECT *, row_number() OVER (PARTITION BY market, base ORDER BY pinned DESC, score DESC, ticker) AS t FROM x WHERE score IS NOT NULL),
us AS (SELECT *, row_number() OVER (PARTITION BY market, sector ORDER BY score DESC, ticker) AS s FROM tw WHERE t = 1 OR pinned), rk AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY score DESC, ticker) AS place FROM us WHERE s <= 2 OR pinned) SELECT market, place::INT AS place, ticker, score FROM rk WHERE place <= 5""",
    "picks_refusals": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'leveraged' WHEN 1 THEN 'stablecoin' WHEN 2 THEN 'commodity' WHEN 4 THEN 'leveraged' END AS refusal FROM part",
}
