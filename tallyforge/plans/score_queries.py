"""Queries of fundamentals, gates and scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import fundamentals as FU
from tallyforge.operators import scoring as C
from tallyforge.operators import series as S
from tallyforge.plans.series_queries import SQL as SERIES
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

CUTOFFS = ("1998-06-30", "1999-12-31", "2001-03-31")
ARMS = [(k, 1 + 0.05 * ((k * 7) % 5 - 2), 1 + 0.05 * ((k * 3) % 5 - 2), 1 + 0.05 * ((k * 11) % 5 - 2)) for k in range(9)]


def quotes(s, d):
    """One row a ticker: the measures that gates and score read, from one pass over the bars."""
    parts = [S.growth_part(), S.trend_part(), S.drawdown_part(), S.risk_part()]
    return S.measured(T.bars(s, d), parts, T.dividends(s, d)).join(T.sectors(s, d), "ticker", "left")


def _asked(s, d):
    days = s.createDataFrame([(c,) for c in CUTOFFS], "c string").select(F.col("c").cast("date").alias("cutoff"), F.lit(1).alias("one"))
    return T.bars(s, d).select("ticker").distinct().withColumn("one", F.lit(1)).join(F.broadcast(days), "one").drop("one")


def _valuation(s, d):
    px = T.bars(s, d).groupBy("ticker").agg(F.max_by("close", "bar_date").alias("price"))
    last = T.filings(s, d).groupBy("ticker").agg(F.max_by(F.struct("eps", "revenue", "net_income", "shares", "net_margin"), "filed").alias("f"))
    v = FU.valuation(F.col("price"), F.col("f.eps"), F.col("f.net_margin"), F.col("f.net_income") * 1.3, F.col("f.shares"), F.lit(None).cast("double"))
    rows = px.join(last, "ticker")
    return rows.select("ticker", *[F.round(c, 6).alias(n) for n, c in v.items()], F.round(FU.quality_return(F.col("f.net_income") / (F.col("f.revenue") / 10) * 100, F.col("f.net_income") / F.col("f.revenue") * 100, F.col("f.net_margin")), 6).alias("quality"))


def _rates(s, d):
    """Rates to the euro of two currencies, from suppliers' bars."""
    return T.bars(s, d).filter("ticker IN ('S1', 'S3')").select(F.when(F.col("ticker") == "S1", "USD").otherwise("GBP").alias("ccy"), "bar_date", (F.col("close") / 1e5).alias("rate"))


def _converted(s, d):
    """Each cutoff's revenue in pounds: filers report in dollars, pounds or an unknown currency."""
    rows = FU.as_of(_asked(s, d), T.filings(s, d)).withColumn("ccy", F.get(F.array(*map(F.lit, ["USD", "GBP", "XXX"])), F.substring("ticker", 2, 9).cast("int") % 3))
    one = FU.rates_as_of(rows, _rates(s, d)).withColumnRenamed("rate", "from_rate").withColumnRenamed("ccy", "from_ccy").withColumn("ccy", F.lit("GBP"))
    two = FU.rates_as_of(one, _rates(s, d))
    return two.select("ticker", "cutoff", F.round(FU.converted(F.col("f.revenue"), F.col("from_ccy"), F.col("ccy"), F.col("from_rate"), F.col("rate")), 4).alias("revenue"))


def _patched(s, d):
    """Filings without earnings of every third ticker, patched by instances of each second quarter."""
    rows = T.filings(s, d).select("ticker", "period_end", F.when(F.substring("ticker", 2, 9).cast("int") % 3 != 0, F.col("eps")).alias("eps"), "shares", "prior_eps", "prior_shares")
    inst = T.filings(s, d).filter(F.quarter("period_end") % 2 == 0).select("ticker", "period_end", (F.col("eps") * 2).alias("eps"), (F.col("shares") / 2).alias("shares"))
    return FU.patched(rows, inst).select("ticker", "period_end", *[F.round(c, 6).alias(c) for c in ("eps", "shares", "prior_eps", "prior_shares")])


def _routed(s, d):
    years = FU.annual_rollup(T.filings(s, d)).select("ticker", "year", "revenue")
    return FU.routed(years.filter(F.substring("ticker", 2, 9).cast("int") % 2 == 0), years.withColumn("revenue", F.round(F.col("revenue") * 2, 2)))


def _enriched(s, d):
    px = T.bars(s, d).groupBy("ticker").agg(F.max_by("close", "bar_date").alias("price")).join(T.sectors(s, d).select("ticker", "class"), "ticker")
    latest = FU.factors(_asked(s, d).filter("cutoff = '2001-03-31'"), T.filings(s, d)).join(T.filings(s, d).groupBy("ticker").agg(F.max_by("eps", "filed").alias("eps")), "ticker").select("ticker", "eps", "eps_growth")
    return FU.enriched(px, latest)


def _insider(s, d):
    o = T.table(s, d, "orders").select(T.ticker("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("tx_date"), (F.col("o_orderstatus") == "F").alias("buy"))
    return FU.insider_net(_asked(s, d), o)


def _sizes(s, d):
    rows = quotes(s, d).select("ticker", F.when(F.col("market").isin("ASIA", "EUROPE"), "core").otherwise("other").alias("class"), F.col("pct_rank").alias("score"), "volatility")
    return C.sizes(rows, s.createDataFrame([("core", 60.0), ("other", 30.0), ("unused", 10.0)], "class string, budget double"), 0.05)


QUERIES = {
    "flagship_screen": lambda s, d: C.screen(quotes(s, d)),
    "gate_funnel": lambda s, d: C.funnel(quotes(s, d), C.Knobs(), "market"),
    "gate_combinations": lambda s, d: C.gate_combinations(quotes(s, d), C.Knobs()),
    "rank_robustness": lambda s, d: C.robustness(quotes(s, d), s.createDataFrame(ARMS, "arm int, a double, b double, c double")),
    "position_sizes": _sizes,
    "fund_as_of": lambda s, d: FU.as_of(_asked(s, d), T.filings(s, d)).select("ticker", "cutoff", F.col("f.filed").alias("filed"), F.col("f.period_end").alias("period_end"), F.round("f.revenue", 2).alias("revenue")),
    "fund_factors": lambda s, d: FU.factors(_asked(s, d), T.filings(s, d)),
    "annual_rollup": lambda s, d: FU.annual_rollup(T.filings(s, d)),
    "income_snapshot": lambda s, d: FU.income_snapshot(FU.annual_rollup(T.filings(s, d))),
    "annual_brief": lambda s, d: FU.annual_brief(FU.annual_rollup(T.filings(s, d))),
    "fund_in_currency": _converted,
    "fund_patched": _patched,
    "fund_routed": _routed,
    "fund_enriched": _enriched,
    "insider_net_buys": _insider,
    "valuation_yields": _valuation,
}

_QUOTES = "WITH " + ", ".join(f"q_{n} AS ({SERIES['series_' + n]})" for n in ("growth", "trend", "drawdown", "risk")) + ", " + VIEWS["sectors"] + ", quotes AS (SELECT * FROM q_growth JOIN q_trend USING (ticker) JOIN q_drawdown USING (ticker) JOIN q_risk USING (ticker) LEFT JOIN sectors USING (ticker))"
_K = C.Knobs()
_FAILED = f""", told AS (SELECT *, list_filter([CASE WHEN age_years < {_K.min_age} THEN 'young' END, CASE WHEN pct_rank < {_K.min_range} THEN 'range' END, CASE WHEN life_cagr < {_K.min_cagr} THEN 'cagr' END, CASE WHEN max_drawdown > {_K.max_drawdown} THEN 'maxdd' END,
  CASE WHEN above_ma > {_K.max_above_ma} THEN 'stretch' END, CASE WHEN volatility > {_K.max_volatility} THEN 'vol' END, CASE WHEN avg_turnover < {_K.min_turnover} THEN 'turnover' END], lambda x: x IS NOT NULL) AS failed FROM quotes)"""
_ASKED = "asked AS (SELECT DISTINCT ticker, cutoff FROM bars, (VALUES " + ", ".join(f"(DATE '{c}')" for c in CUTOFFS) + ") v(cutoff))"
_ARMS = ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, a, b, c in ARMS)

#: The factors from the filings, each written out from its definition.
_FACTORS = """, k AS (SELECT *, cutoff - 730 AS c2, cutoff - 365 AS c1 FROM asked), n AS (SELECT k.*, f.* EXCLUDE (ticker) FROM k ASOF LEFT JOIN filings f ON k.ticker = f.ticker AND k.cutoff >= f.filed),
t AS (SELECT n.*, f.revenue AS tr, f.assets AS ta, f.eps AS te FROM n ASOF LEFT JOIN filings f ON n.ticker = f.ticker AND n.c2 >= f.filed), g AS (SELECT t.*, f.revenue AS ar, f.shares AS ash, f.op_margin AS ao, f.eps AS ae FROM t ASOF LEFT JOIN filings f ON t.ticker = f.ticker AND t.c1 >= f.filed),
kn AS (SELECT a.ticker, a.cutoff, f.period_end AS pe, f.net_margin, f.eps, f.prior_eps, f.shares FROM asked a JOIN filings f ON f.ticker = a.ticker AND f.filed <= a.cutoff),
m AS (SELECT ticker, cutoff, CASE WHEN count(*) >= 3 THEN -stddev_samp(net_margin) END AS ms FROM (SELECT *, row_number() OVER (PARTITION BY ticker, cutoff ORDER BY pe DESC) AS r FROM kn WHERE net_margin IS NOT NULL) WHERE r <= 3 GROUP BY 1, 2),
ch AS (SELECT ticker, cutoff, CASE WHEN count(*) FILTER (WHERE eps > 0 AND prior_eps > 0) = 2 THEN product(eps / prior_eps) FILTER (WHERE eps > 0 AND prior_eps > 0) END AS chain FROM (SELECT *, row_number() OVER (PARTITION BY ticker, cutoff ORDER BY pe DESC) AS r FROM kn WHERE pe > cutoff - 1095) WHERE r <= 2 GROUP BY 1, 2),
sp AS (SELECT ticker, cutoff, coalesce(bool_or(was > 0 AND abs(shares / was - 1) > 0.4), false) AS jump FROM (SELECT *, lag(shares) OVER (PARTITION BY ticker, cutoff ORDER BY pe) AS was FROM kn WHERE pe >= cutoff - 730) GROUP BY 1, 2),
fx AS (SELECT g.*, ms, chain, coalesce(jump, false) AS jump FROM g LEFT JOIN m USING (ticker, cutoff) LEFT JOIN ch USING (ticker, cutoff) LEFT JOIN sp USING (ticker, cutoff)),
fy AS (SELECT *, CASE WHEN tr > 0 THEN (sqrt(revenue / tr) - 1) * 100 END AS gr, CASE WHEN ar > 0 THEN (revenue / ar - 1) * 100 END AS y1, op_margin / 100 * revenue AS ebit, net_margin / 100 * revenue / (nullif(roe, 0) / 100) + net_debt AS cap, net_margin / 100 * revenue / (nullif(roa, 0) / 100) AS ast FROM fx),
factors AS (SELECT ticker, cutoff, period_end, round(gr, 6) AS rev_cagr, round(y1, 6) AS rev_1y, round(y1 - gr, 6) AS rev_accel, round(CASE WHEN ta > 0 THEN -(sqrt(assets / ta) - 1) * 100 END, 6) AS asset_growth, round(op_margin - ao, 6) AS margin_trend,
  round(CASE WHEN chain IS NOT NULL THEN (sqrt(chain) - 1) * 100 WHEN eps > 0 AND te > 0 AND NOT jump THEN (sqrt(eps / te) - 1) * 100 END, 6) AS eps_growth, round(CASE WHEN prior_eps IS NOT NULL THEN (eps / nullif(prior_eps, 0) - 1) * 100 WHEN ae <> 0 AND NOT coalesce(ash > 0 AND abs(shares / ash - 1) > 0.4, false) THEN (eps / ae - 1) * 100 END, 6) AS eps_yoy,
  round(CASE WHEN prior_shares IS NOT NULL THEN -(shares / nullif(prior_shares, 0) - 1) * 100 WHEN ash > 0 AND abs(shares / ash - 1) <= 0.4 THEN -(shares / ash - 1) * 100 END, 6) AS buyback, round(ms, 6) AS margin_stability, round(CASE WHEN shares > 0 THEN -((eps - fcf_margin / 100 * revenue / shares) / greatest(abs(eps), 0.5)) END, 6) AS accrual_gap,
  round(gross_margin, 6) AS gross_margin, round(op_margin, 6) AS op_margin, round(net_margin, 6) AS net_margin, round(roe, 6) AS roe, round(CASE WHEN roe IS NOT NULL AND (roe >= 0) = (net_margin >= 0) AND NOT (roa > 0 AND roe / roa >= 20) THEN roe ELSE roa END, 6) AS quality,
  round(ebit / CASE WHEN cap > 0 THEN cap WHEN ast > 0 THEN ast END * 100, 6) AS roic, round(fcf_margin, 6) AS fcf_margin, round(interest_cover, 6) AS interest_cover, round(net_debt, 6) AS net_debt FROM fy)"""
_ROLLUP = """, y AS (SELECT ticker, year(period_end)::INT AS year, sum(CAST(round(revenue, 4) AS DECIMAL(30,4)))::DOUBLE AS revenue, sum(gross_margin * revenue) / sum(revenue) AS gross_margin, sum(op_margin * revenue) / sum(revenue) AS op_margin, sum(net_margin * revenue) / sum(revenue) AS net_margin,
  sum(eps) AS eps, avg(shares) AS shares, first(prior_eps ORDER BY period_end DESC) AS prior_eps, first(prior_shares ORDER BY period_end DESC) AS prior_shares, count(*) AS quarters FROM filings GROUP BY 1, 2),
w AS (SELECT ticker, year, (revenue / nullif(lag(revenue) OVER (PARTITION BY ticker ORDER BY year), 0) - 1) * 100 AS yoy FROM y WHERE quarters = 1 OR quarters >= 4),
rollup AS (SELECT ticker, year, round(revenue, 2) AS revenue, round(gross_margin, 6) AS gross_margin, round(op_margin, 6) AS op_margin, round(net_margin, 6) AS net_margin, round(eps, 6) AS eps, round(prior_eps, 6) AS prior_eps, round(shares, 4) AS shares, round(prior_shares, 4) AS prior_shares, quarters, round(yoy, 6) AS yoy FROM y LEFT JOIN w USING (ticker, year))"""



def _sizes_sql(passes: int = 5, cap: float = 0.05) -> str:
    """The passes one after another, each written out."""
    parts = [", z AS (SELECT ticker, CASE WHEN market IN ('ASIA', 'EUROPE') THEN 'core' ELSE 'other' END AS class, pct_rank / volatility AS raw FROM quotes WHERE pct_rank > 0 AND volatility > 0), b(class, budget) AS (VALUES ('core', 60.0::DOUBLE), ('other', 30.0)), y0 AS (SELECT ticker, class, raw, budget / (SELECT sum(budget) FROM b WHERE class IN (SELECT class FROM z)) AS room, 0.0::DOUBLE AS weight FROM z JOIN b USING (class))"]
    for k in range(passes):
        parts.append(f"y{k + 1} AS (SELECT ticker, class, raw, room, CASE WHEN weight < {cap} THEN least({cap}, weight + coalesce((room - sum(weight) OVER (PARTITION BY class)) * raw / nullif(sum(CASE WHEN weight < {cap} THEN raw END) OVER (PARTITION BY class), 0), 0)) ELSE weight END AS weight FROM y{k})")
    return ", ".join(parts) + f" SELECT ticker, class, round(weight, 6) AS weight FROM y{passes}"


SQL = {
    "position_sizes": _QUOTES + _sizes_sql(),
    "flagship_screen": _QUOTES + _FAILED + """, sc AS (SELECT *, round((least(life_cagr, 30.0) + 2.0 * least(coalesce(life_cagr / nullif(volatility, 0), 0), 3.0) + 2.0 * least(coalesce(life_cagr / nullif(max_drawdown, 0), 0), 3.0) + 5.0 * coalesce(trend_r2, 0))
  * greatest(0, 1 + (pct_rank / 100 - 1)) * sqrt((CASE WHEN age_years >= 10 THEN 1.0 ELSE 0.5 END) * (1 - 0.5 * least(above_ma / 150.0, 1.0))) + 0.1 * ln(greatest(avg_turnover, 1.0) / 1e9), 6) AS score FROM told WHERE len(failed) = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY score DESC, ticker) AS place FROM sc) SELECT market, CAST(place AS INT) AS place, ticker, score FROM p WHERE place <= 10""",
    "gate_funnel": _QUOTES + _FAILED + ", u AS (SELECT market, unnest(failed) AS gate, len(failed) = 1 AS sole FROM told) SELECT market, gate, count(*) AS n_failed, count(*) FILTER (WHERE sole) AS n_sole FROM u GROUP BY 1, 2",
    "gate_combinations": _QUOTES + _FAILED + " SELECT array_to_string(list_sort(failed), '+') AS gates, count(*) AS n FROM told WHERE len(failed) >= 2 GROUP BY 1",
    "rank_robustness": _QUOTES + f""", arms(arm, a, b, c) AS (VALUES {_ARMS}), k AS (SELECT arm, ticker, row_number() OVER (PARTITION BY arm ORDER BY round(a * life_cagr + b * pct_rank - c * max_drawdown, 6) DESC, ticker) AS rank FROM quotes, arms)
SELECT ticker, quantile_cont(rank, 0.5) AS median_rank, quantile_cont(rank, 0.75) - quantile_cont(rank, 0.25) AS iqr FROM k GROUP BY 1""",
    "fund_as_of": "WITH " + VIEWS["bars"] + ", " + VIEWS["filings"] + ", " + _ASKED + " SELECT a.ticker, a.cutoff, f.filed, f.period_end, round(f.revenue, 2) AS revenue FROM asked a ASOF LEFT JOIN filings f ON a.ticker = f.ticker AND a.cutoff >= f.filed",
    "fund_factors": "WITH " + VIEWS["bars"] + ", " + VIEWS["filings"] + ", " + _ASKED + _FACTORS + " SELECT * FROM factors",
    "annual_rollup": "WITH " + VIEWS["filings"] + _ROLLUP + " SELECT * FROM rollup",
    "income_snapshot": "WITH " + VIEWS["filings"] + _ROLLUP + """, l AS (SELECT *, lag(revenue) OVER w AS pr, lag(eps) OVER w AS pe, lag(shares) OVER w AS ps FROM rollup WINDOW w AS (PARTITION BY ticker ORDER BY year)), n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS rn FROM l WHERE quarters = 1 OR quarters >= 4)
SELECT ticker, year, round(CASE WHEN pr > 0 THEN (revenue / pr - 1) * 100 END, 6) AS rev_yoy, round(CASE WHEN prior_eps IS NOT NULL THEN (eps / nullif(prior_eps, 0) - 1) * 100 WHEN pe <> 0 AND NOT coalesce(ps > 0 AND abs(shares / ps - 1) > 0.4, false) THEN (eps / pe - 1) * 100 END, 6) AS eps_yoy, net_margin,
  round(CASE WHEN prior_shares IS NOT NULL THEN -(shares / nullif(prior_shares, 0) - 1) * 100 WHEN ps > 0 AND abs(shares / ps - 1) <= 0.4 THEN -(shares / ps - 1) * 100 END, 6) AS buyback FROM n WHERE rn = 1""",
    "annual_brief": "WITH " + VIEWS["filings"] + _ROLLUP + """, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS rn FROM rollup WHERE quarters = 1 OR quarters >= 4)
SELECT ticker, count(*) AS n, string_agg(printf('%.2fM', revenue / 1e6), ' > ' ORDER BY year) AS chain, round(CASE WHEN arg_min(revenue, year) > 0 AND arg_max(revenue, year) > 0 THEN (power(arg_max(revenue, year) / arg_min(revenue, year), 1.0::DOUBLE / (count(*) - 1)) - 1) * 100 END, 6) AS rev_cagr, arg_min(net_margin, year) AS first_margin, arg_max(net_margin, year) AS last_margin
FROM n WHERE rn <= 5 GROUP BY ticker HAVING count(*) >= 2""",
    "fund_in_currency": "WITH " + VIEWS["bars"] + ", " + VIEWS["filings"] + ", " + _ASKED + """, r AS (SELECT CASE ticker WHEN 'S1' THEN 'USD' ELSE 'GBP' END AS ccy, bar_date, close / 1e5 AS rate FROM bars WHERE ticker IN ('S1', 'S3')), f AS (SELECT a.ticker, a.cutoff, ['USD', 'GBP', 'XXX'][substr(a.ticker, 2)::INT % 3 + 1] AS c1, 'GBP' AS c2, f.revenue AS v FROM asked a ASOF LEFT JOIN filings f ON a.ticker = f.ticker AND a.cutoff >= f.filed),
g AS (SELECT f.*, r.rate AS r1 FROM f ASOF LEFT JOIN r ON f.c1 = r.ccy AND f.cutoff >= r.bar_date), h AS (SELECT g.*, r.rate AS r2 FROM g ASOF LEFT JOIN r ON g.c2 = r.ccy AND g.cutoff >= r.bar_date) SELECT ticker, cutoff, round(CASE WHEN c1 = c2 THEN v WHEN r1 > 0 AND r2 > 0 THEN v * r1 / r2 END, 4) AS revenue FROM h""",
    "fund_patched": "WITH " + VIEWS["filings"] + """, i AS (SELECT ticker, period_end, eps * 2 AS e, shares / 2 AS s, lag(eps * 2) OVER w AS pe, lag(shares / 2) OVER w AS ps FROM filings WHERE quarter(period_end) % 2 = 0 WINDOW w AS (PARTITION BY ticker ORDER BY period_end)), x AS (SELECT f.*, substr(f.ticker, 2)::INT % 3 = 0 AS none, i.e, i.s, i.pe, i.ps FROM filings f LEFT JOIN i USING (ticker, period_end))
SELECT ticker, period_end, round(CASE WHEN none THEN e ELSE eps END, 6) AS eps, round(CASE WHEN none AND e IS NOT NULL THEN s ELSE shares END, 6) AS shares, round(CASE WHEN none AND pe IS NOT NULL THEN pe ELSE prior_eps END, 6) AS prior_eps, round(CASE WHEN none AND pe IS NOT NULL THEN ps ELSE prior_shares END, 6) AS prior_shares FROM x""",
    "fund_routed": "WITH " + VIEWS["filings"] + _ROLLUP + " SELECT ticker, year, CASE WHEN substr(ticker, 2)::INT % 2 = 0 THEN revenue ELSE round(revenue * 2, 2) END AS revenue, CASE WHEN substr(ticker, 2)::INT % 2 = 0 THEN 'first' ELSE 'second' END AS source FROM rollup",
    "fund_enriched": "WITH " + VIEWS["bars"] + ", " + VIEWS["filings"] + ", " + VIEWS["sectors"] + ", " + _ASKED + _FACTORS + """, p AS (SELECT ticker, arg_max(close, bar_date) AS price FROM bars GROUP BY 1), l AS (SELECT ticker, arg_max(eps, filed) AS eps FROM filings GROUP BY 1), x AS (SELECT p.ticker, price, class, CASE WHEN price > 0 THEN eps / price * 100 END AS ey, eps_growth AS g FROM p JOIN sectors USING (ticker) LEFT JOIN l USING (ticker) LEFT JOIN (SELECT * FROM factors WHERE cutoff = DATE '2001-03-31') f USING (ticker))
SELECT ticker, price, class, round(CASE WHEN class <> 0 THEN ey END, 6) AS earnings_yield, round(CASE WHEN class <> 0 AND ey > 0 AND g > 0 THEN ey * g END, 6) AS peg_yield FROM x""",
    "insider_net_buys": "WITH " + VIEWS["bars"] + ", " + _ASKED + ", o AS (SELECT 'S' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS v FROM orders) SELECT a.ticker, a.cutoff, CAST((SELECT sum(v) FROM o WHERE o.ticker = a.ticker AND d >= a.cutoff - 180 AND d < a.cutoff) AS DOUBLE) AS net FROM asked a",
    "valuation_yields": "WITH " + VIEWS["bars"] + ", " + VIEWS["filings"] + """, p AS (SELECT ticker, arg_max(close, bar_date) AS price FROM bars GROUP BY 1), l AS (SELECT ticker, arg_max(eps, filed) AS eps, arg_max(revenue, filed) AS revenue, arg_max(net_income, filed) AS ni, arg_max(shares, filed) AS shares, arg_max(net_margin, filed) AS nm FROM filings GROUP BY 1),
x AS (SELECT *, CASE WHEN price > 0 THEN eps / price * 100 END AS ey, ni / nullif(revenue / 10, 0) * 100 AS roe, ni / nullif(revenue, 0) * 100 AS roa FROM p JOIN l USING (ticker))
SELECT ticker, round(ey, 6) AS earnings_yield, round(CASE WHEN ni > 0 AND shares > 0 AND price > 0 THEN ni * 1.3 / (shares * price) * 100 END, 6) AS ebitda_yield, round(CASE WHEN ey > 0 AND nm > 0 THEN ey * nm END, 6) AS peg_yield,
  round(CASE WHEN roe IS NOT NULL AND (roe >= 0) = (nm >= 0) AND NOT (roa > 0 AND roe / roa >= 20) THEN roe ELSE roa END, 6) AS quality FROM x""",
}
