"""Queries of reference data, the paper portfolio and the searches over walk-forward samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import journal as J
from tallyforge.operators import portfolio as PF
from tallyforge.operators import refdata as R
from tallyforge.operators import universe as U
from tallyforge.operators import walk as K
from tallyforge.plans.score_queries import _QUOTES, quotes
from tallyforge.plans.walk_queries import _RHO, _SAMPLES, _samples
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

TODAY = "2001-11-01"
LOSERS = ["LEH", "ENRN", "S3", "WCOM"]
EDGE = "1999-01-01"
FACTORS = ["cagr_life", "max_dd", "vol", "range_pct", "r2"]


def _part(s, d, *columns):
    return T.table(s, d, "part").selectExpr(*columns)


def _asked(s, d):
    return _part(s, d, "'X' || p_partkey AS isin")


def _known(s, d):
    return _part(s, d, "'X' || p_partkey AS isin", "IF(p_partkey % 6 = 0, ' ', 'P' || p_partkey) AS symbol").filter("substr(isin, 2) % 3 = 0")


def _misses(s, d):
    return _part(s, d, "'X' || p_partkey AS isin", "date_sub(DATE '2001-11-01', p_size) AS missed_on").filter("substr(isin, 2) % 4 = 1")


def _answers(s, d):
    return _part(s, d, "'X' || p_partkey AS isin", "element_at(array('empty', 'found', 'failed'), CAST(p_partkey % 3 AS INT) + 1) AS status").filter("substr(isin, 2) % 5 < 3")


def _charts(s, d):
    b = T.bars(s, d).filter(F.month("bar_date") > 2)
    one = b.groupBy("ticker").agg(F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"), F.count("*").alias("n"))
    k = F.substring("ticker", 2, 9).cast("int")
    return one.select(F.concat("ticker", F.lit(".DE")).alias("ticker"), F.when(k % 4 == 0, "USD").otherwise("EUR").alias("currency"), "first_date", "last_date", "n")


def _mapping(s, d):
    return T.table(s, d, "supplier").filter("s_suppkey % 5 <> 0").selectExpr("'S' || s_suppkey AS symbol", "IF(s_suppkey % 7 = 0, '', 'S' || s_suppkey || '.DE') AS listing")


def _swaps(s, d):
    return R.swapped_listings(T.sectors(s, d).selectExpr("ticker AS symbol"), _mapping(s, d), _charts(s, d))


def _facts(s, d, k, scale=1.0):
    return _part(s, d, "'X' || p_partkey AS isin", f"IF(p_partkey % {k} = 0, p_size / 10D * {scale}D, NULL) AS ter", f"IF(p_partkey % {k + 1} = 0, p_retailprice * {scale}D, NULL) AS aum")


def _entries(s, d):
    return _part(s, d, "'X' || p_partkey AS isin", "IF(p_partkey % 9 = 0, NULL, date_sub(DATE '2001-11-01', p_size % 6)) AS cached_on")


def _lots(s, d):
    j = T.journal(s, d).filter("rank <= 3")
    return j.select("day", "ticker", F.round(100 / F.col("px"), 6).alias("qty"), F.lit(100.0).alias("cost"))


def _levels(s, d):
    return T.journal(s, d).groupBy("day").agg(F.round(F.avg("px"), 6).alias("level"))


def _meta(s, d, later):
    shift = "p_partkey % 11" if later else "0"
    return _part(s, d, "'X' || p_partkey AS isin", f"round(p_size / 10D + IF({shift} = 3, 0.05D, 0D), 6) AS ter", f"p_retailprice * IF({shift} = 4, 0.5D, 1D) AS aum", f"IF({shift} = 5, 'Dist', 'Acc') AS share_class", f"IF(p_partkey % 13 = 0, NULL, IF({shift} = 6, 'Swap', 'Full')) AS replication")


def _gated(s, d, low):
    return quotes(s, d).select("ticker", F.array_compact(F.array(F.when(F.col("pct_rank") < low, "range"), F.when(F.col("max_drawdown") > 97, "maxdd"))).alias("failed"))


def _quotes(s, d):
    return _part(s, d, "'P' || p_partkey || IF(p_partkey % 2 = 0, '.DE', '') AS ticker", "IF(p_partkey % 5 = 0, NULL, 'I' || (p_partkey DIV 2)) AS isin", "'B' || (p_partkey DIV 3) AS base", "IF(p_partkey % 2 = 0, 'EUR', 'USD') AS currency")


def _owned(s, d):
    return _part(s, d, "'O' || p_partkey AS owned", "IF(p_partkey % 3 = 0, NULL, 'I' || p_partkey) AS isin", "IF(p_partkey % 4 = 0, 'P', 'B') || (p_partkey DIV 2) AS base")


def _fund_table(s, d):
    return _part(s, d, "'F' || p_partkey AS fund", "p_brand AS key", "IF(p_partkey % 3 = 0, NULL, IF(right(p_brand, 1) = '1', 20D, p_size + 0D)) AS pe")


def _legs(s, d):
    rows = T.table(s, d, "lineitem").selectExpr("'F' || l_suppkey AS fund", "year(l_shipdate) AS years", "CAST(l_extendedprice AS DECIMAL(18,2)) AS x").groupBy("fund", "years").agg(F.sum("x").cast("double").alias("ret"))
    return rows.select("fund", F.concat(F.col("years").cast("string"), F.lit("Y")).alias("leg"), "years", "ret")


QUERIES = {
    "refdata_misses": lambda s, d: R.remembered_misses(_misses(s, d), _answers(s, d), TODAY),
    "refdata_resolve": lambda s, d: R.resolve_symbols(_asked(s, d), _known(s, d), _misses(s, d), TODAY),
    "refdata_last_good": lambda s, d: R.last_good(_part(s, d, "p_brand AS venue", "p_partkey AS k").filter("venue < 'Brand#3'"), _part(s, d, "p_brand AS venue", "-p_partkey AS k")),
    "refdata_swaps": _swaps,
    "refdata_swap_tally": lambda s, d: R.swap_tally(_swaps(s, d), _mapping(s, d), T.table(s, d, "supplier").filter("s_suppkey % 2 = 0").selectExpr("'S' || s_suppkey AS symbol")),
    "refdata_homes": lambda s, d: R.home_of(_swaps(s, d)),
    "refdata_filled": lambda s, d: R.filled(_facts(s, d, 2), _facts(s, d, 3, 2.0), _facts(s, d, 5, 3.0)),
    "refdata_cache_use": lambda s, d: _entries(s, d).select("isin", R.cache_use(F.col("cached_on"), TODAY)[0].alias("serve"), R.cache_use(F.col("cached_on"), TODAY)[1].alias("refetch")),
    "refdata_refetch": lambda s, d: R.to_refetch(_entries(s, d), TODAY, 50),
    "refdata_coverage": lambda s, d: R.coverage(T.spans(s, d), T.bars(s, d).filter("close > 90000")),
    "refdata_dead": lambda s, d: _part(s, d, "p_partkey", "IF(p_partkey % 2 = 0, 'MUTUALFUND', 'EQUITY') AS kind", "IF(p_partkey % 3 = 0, CAST(p_size AS STRING), p_name) AS name").select("p_partkey", R.is_dead(F.col("kind"), F.col("name")).alias("dead")),
    "refdata_losers": lambda s, d: R.with_losers(T.sectors(s, d), LOSERS),
    "refdata_fresh": lambda s, d: R.fresh_listings(T.bars(s, d).groupBy("ticker").agg(F.max("bar_date").alias("last_date")).withColumn("last_date", F.when(~F.endswith("ticker", F.lit("7")), F.col("last_date"))), TODAY),
    "refdata_class_census": lambda s, d: R.class_census(quotes(s, d).select("class", F.when(F.col("pct_rank") >= 40, F.col("pct_rank")).alias("score"))),
    "report_twins": lambda s, d: R.twin_groups(T.table(s, d, "part").selectExpr("'P' || p_partkey AS ticker", "p_brand", "p_type", "p_size"), ["p_brand", "p_type", "p_size"]),
    "report_borrowed": lambda s, d: R.borrowed(_fund_table(s, d), "pe"),
    "report_headlines": lambda s, d: R.headline_rows(T.table(s, d, "part").selectExpr("'P' || p_partkey AS ticker", "p_type || ' ' || p_size AS title")),
    "report_premium": lambda s, d: R.premium(T.table(s, d, "supplier").selectExpr("'F' || s_suppkey AS fund", "abs(s_acctbal) AS pe"), _legs(s, d), "F1"),
    "report_worst": lambda s, d: R.worst(quotes(s, d), "market", "worst_rolling"),
    "portfolio_holdings": lambda s, d: PF.holdings(_lots(s, d)).select("ticker", F.round("qty", 6).alias("qty"), F.round("cost", 4).alias("cost")),
    "portfolio_digest": lambda s, d: PF.digest(_lots(s, d), T.journal(s, d).groupBy("ticker").agg(F.max_by("px", "day").alias("px")), _levels(s, d), 2500.0),
    "portfolio_fact_alerts": lambda s, d: PF.fact_alerts(_meta(s, d, False), _meta(s, d, True)),
    "portfolio_exits": lambda s, d: PF.exit_review(_gated(s, d, 20), _gated(s, d, 60)),
    "portfolio_owned": lambda s, d: PF.resolve_owned(_owned(s, d), _quotes(s, d)),
    "portfolio_orders": lambda s, d: T.bars(s, d).groupBy("ticker").agg(F.max_by("close", "bar_date").alias("px")).select("ticker", PF.order_quantity(F.lit(1000.0), F.col("px")).alias("qty"), PF.valuation_state(F.col("px") / 1000 - 40).alias("state")),
    "portfolio_fund_flows": lambda s, d: PF.fund_flows(T.journal(s, d).select("day", "ticker", "px", (F.col("px") * (30 - F.col("rank"))).alias("aum"))),
    "journal_deploy": lambda s, d: _levels(s, d).select("day", J.market_state(F.col("level") / 50 - 60).alias("state"), J.deploy_multiplier(J.market_state(F.col("level") / 50 - 60)).alias("times")),
    "universe_tiered": lambda s, d: U.tiered(_part(s, d, "'P' || p_partkey || '.DE' AS symbol", "p_name AS name").distinct(), _part(s, d, "'P' || p_partkey || '.DE' AS symbol", "p_size AS value").filter("value < 10"), _part(s, d, "'P' || p_partkey AS stem", "p_size AS value").filter("value > 40"), _part(s, d, "p_name AS known", "0 AS value").distinct()).groupBy("tier").agg(F.count("*").alias("n"), F.sum("value").alias("total")),
    "walk_cadences": lambda s, d: K.cadences(T.bars(s, d)),
}

_X = "'X' || p_partkey"
_SW = "WITH " + VIEWS["bars"] + ", " + VIEWS["sectors"] + """, c AS (SELECT ticker || '.DE' AS listing, substr(ticker, 2)::INT AS k, min(bar_date) AS a, max(bar_date) AS b, count(*) AS n FROM bars WHERE month(bar_date) > 2 GROUP BY 1, 2), m AS (SELECT 'S' || s_suppkey AS symbol, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'S' || s_suppkey || '.DE' END AS listing FROM supplier WHERE s_suppkey % 5 <> 0),
g AS (SELECT m.* FROM m JOIN c USING (listing) WHERE k % 4 <> 0 AND a <= b - INTERVAL 60 MONTH AND n >= 60), w AS (SELECT s.ticker AS symbol, coalesce(g.listing, s.ticker) AS listing FROM sectors s LEFT JOIN g ON g.symbol = s.ticker)"""
_LOT = "WITH " + VIEWS["journal"] + ", lots AS (SELECT day, ticker, round(100 / px, 6) AS qty, 100.0::DOUBLE AS cost FROM journal WHERE rank <= 3)"


SQL = {
    "refdata_misses": f"SELECT isin, max(missed_on) AS missed_on FROM (SELECT {_X} AS isin, DATE '2001-11-01' - p_size AS missed_on FROM part WHERE p_partkey % 4 = 1 AND NOT (p_partkey % 3 = 1 AND p_partkey % 5 < 3) UNION ALL SELECT {_X}, DATE '2001-11-01' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 < 3) GROUP BY 1",
    "refdata_resolve": f"SELECT {_X} AS isin, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 6 <> 0 THEN 'P' || p_partkey END AS symbol, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 6 <> 0 THEN 'known' WHEN p_partkey % 4 = 1 AND p_size < 30 THEN 'blocked' ELSE 'ask' END AS state FROM part",
    "refdata_last_good": "SELECT p_brand AS venue, CASE WHEN p_brand < 'Brand#3' THEN p_partkey ELSE -p_partkey END AS k FROM part",
    "refdata_swaps": _SW + " SELECT * FROM w",
    "refdata_swap_tally": _SW + " SELECT count(*) FILTER (WHERE symbol <> listing) AS swapped, count(*) FILTER (WHERE symbol = listing AND symbol IN (SELECT symbol FROM m WHERE listing <> '')) AS unproven, count(*) FILTER (WHERE symbol = listing AND symbol NOT IN (SELECT symbol FROM m WHERE listing <> '')) AS unmapped, count(*) FILTER (WHERE symbol <> listing AND substr(symbol, 2)::INT % 2 = 0) AS shadowed FROM w",
    "refdata_homes": _SW + " SELECT listing, min(symbol) AS symbol FROM w WHERE symbol <> listing GROUP BY 1",
    "refdata_filled": f"SELECT {_X} AS isin, CASE WHEN p_partkey % 2 = 0 THEN p_size / 10.0::DOUBLE WHEN p_partkey % 3 = 0 THEN p_size / 10.0::DOUBLE * 2 WHEN p_partkey % 5 = 0 THEN p_size / 10.0::DOUBLE * 3 END AS ter, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_partkey % 4 = 0 THEN p_retailprice * 2 WHEN p_partkey % 6 = 0 THEN p_retailprice * 3 END AS aum FROM part",
    "refdata_cache_use": f"SELECT {_X} AS isin, p_partkey % 9 <> 0 AND p_size % 6 <= 3 AS serve, p_partkey % 9 = 0 OR p_size % 6 >= 1 AS refetch FROM part",
    "refdata_refetch": f"SELECT isin FROM (SELECT {_X} AS isin, CASE WHEN p_partkey % 9 <> 0 THEN DATE '2001-11-01' - p_size % 6 END AS c FROM part) WHERE c IS NULL OR c <= DATE '2001-10-31' ORDER BY c NULLS FIRST, isin LIMIT 50",
    "refdata_coverage": "WITH " + VIEWS["bars"] + ", " + VIEWS["spans"] + ", s AS (SELECT DISTINCT ticker, ticker IN (SELECT ticker FROM bars WHERE close > 90000) AS ok FROM spans) SELECT count(*) AS members, count(*) FILTER (WHERE ok) AS served, count(*) FILTER (WHERE NOT ok) AS unserved FROM s",
    "refdata_dead": "SELECT p_partkey, p_partkey % 6 = 0 AS dead FROM part",
    "refdata_losers": "SELECT 'S' || s_suppkey AS ticker FROM supplier UNION SELECT unnest(['LEH', 'ENRN', 'S3', 'WCOM'])",
    "refdata_fresh": "WITH " + VIEWS["bars"] + " SELECT ticker, CASE WHEN NOT ends_with(ticker, '7') THEN max(bar_date) END AS last_date FROM bars GROUP BY 1 HAVING ends_with(ticker, '7') OR DATE '2001-11-01' - max(bar_date) <= 7",
    "refdata_class_census": _QUOTES + " SELECT class, count(*) AS total, count(*) FILTER (WHERE pct_rank >= 40) AS scored FROM quotes GROUP BY 1",
    "report_worst": _QUOTES + ", r AS (SELECT market, ticker, worst_rolling, row_number() OVER (PARTITION BY market ORDER BY worst_rolling, ticker) AS place FROM quotes WHERE worst_rolling IS NOT NULL) SELECT market, place::INT AS place, ticker, worst_rolling FROM r WHERE place <= 3",
    "portfolio_exits": _QUOTES + ", x AS (SELECT ticker, list_filter([CASE WHEN pct_rank < 60 THEN 'range' END, CASE WHEN max_drawdown > 97 THEN 'maxdd' END], lambda x: x IS NOT NULL) AS f FROM quotes WHERE NOT pct_rank < 20 AND NOT max_drawdown > 97) SELECT ticker, array_to_string(f, '+') AS failed FROM x WHERE len(f) > 0",
    "report_twins": "SELECT string_agg(DISTINCT 'P' || p_partkey, ' ' ORDER BY 'P' || p_partkey) AS members, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_brand, p_type, p_size HAVING count(DISTINCT p_partkey) > 1",
    "report_borrowed": "WITH f AS (SELECT 'F' || p_partkey AS fund, p_brand AS key, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN right(p_brand, 1) = '1' THEN 20 ELSE p_size END END::DOUBLE AS pe FROM part), k AS (SELECT key, avg(pe) AS m FROM f WHERE pe IS NOT NULL GROUP BY 1 HAVING max(pe) - min(pe) <= 0.01 * abs(max(pe))) SELECT fund, round(coalesce(pe, m), 6) AS value, pe IS NOT NULL AS own FROM f LEFT JOIN k USING (key)",
    "report_headlines": "SELECT p_type || ' ' || p_size AS title, string_agg(DISTINCT 'P' || p_partkey, ' ' ORDER BY 'P' || p_partkey) AS tickers FROM part GROUP BY 1",
    "report_premium": """WITH l AS (SELECT 'F' || l_suppkey AS fund, year(l_shipdate)::INT AS y, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS r FROM lineitem GROUP BY 1, 2), h AS (SELECT * FROM l WHERE fund = 'F1'), m AS (SELECT l.fund, max(l.y) AS y FROM l JOIN h USING (y) GROUP BY 1), p AS (SELECT 'F' || s_suppkey AS fund, abs(s_acctbal) AS pe FROM supplier)
SELECT p.fund, round(100 * (pe / (SELECT pe FROM p WHERE fund = 'F1') - 1), 6) AS premium, m.y || 'Y' AS leg, round(l.r - h.r, 6) AS excess FROM p LEFT JOIN m USING (fund) LEFT JOIN l ON l.fund = m.fund AND l.y = m.y LEFT JOIN h ON h.y = m.y WHERE p.fund <> 'F1'""",
    "portfolio_holdings": _LOT + " SELECT ticker, round(sum(qty), 6) AS qty, round(sum(cost), 4) AS cost FROM lots GROUP BY 1",
    "portfolio_digest": _LOT + ", px AS (SELECT ticker, arg_max(px, day) AS px FROM journal GROUP BY 1), lv AS (SELECT day, round(avg(px), 6) AS level FROM journal GROUP BY 1), h AS (SELECT ticker, sum(qty) AS q, sum(cost) AS c FROM lots GROUP BY 1) SELECT round(sum(c), 4) AS cost, round(sum(q * px), 4) AS value, count(*) AS n_priced, count(*) AS n, (SELECT round(sum((cost - 1) / level) * 2500, 4) FROM lots JOIN lv USING (day)) AS bench_value FROM h JOIN px USING (ticker)",
    "portfolio_fact_alerts": f"SELECT {_X} AS isin, CASE p_partkey % 11 WHEN 3 THEN 'fee' WHEN 4 THEN 'size' WHEN 5 THEN 'class' ELSE 'replication' END AS alert FROM part WHERE p_partkey % 11 IN (3, 4, 5) OR (p_partkey % 11 = 6 AND p_partkey % 13 <> 0)",
    "portfolio_owned": """WITH q AS (SELECT 'P' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.DE' ELSE '' END AS ticker, CASE WHEN p_partkey % 5 <> 0 THEN 'I' || (p_partkey // 2) END AS isin, 'B' || (p_partkey // 3) AS base, p_partkey % 2 AS far FROM part), c AS (SELECT isin, first(ticker ORDER BY far, ticker) AS t1 FROM q WHERE isin IS NOT NULL GROUP BY 1), b AS (SELECT base, min(ticker) AS t2 FROM q GROUP BY 1 HAVING count(*) = 1),
o AS (SELECT 'O' || p_partkey AS owned, CASE WHEN p_partkey % 3 <> 0 THEN 'I' || p_partkey END AS isin, CASE WHEN p_partkey % 4 = 0 THEN 'P' ELSE 'B' END || (p_partkey // 2) AS base FROM part) SELECT owned, coalesce(t1, t2) AS ticker, CASE WHEN t1 IS NOT NULL THEN 'code' WHEN t2 IS NOT NULL THEN 'base' END AS how FROM o LEFT JOIN c USING (isin) LEFT JOIN b USING (base)""",
    "portfolio_orders": "WITH " + VIEWS["bars"] + ", p AS (SELECT ticker, arg_max(close, bar_date) AS px FROM bars GROUP BY 1) SELECT ticker, round(floor(1000 / px / 0.0001) * 0.0001, 6) AS qty, CASE WHEN px / 1000 - 40 <= -10 THEN 'CHEAP' WHEN px / 1000 - 40 >= 10 THEN 'RICH' ELSE 'NEUTRAL' END AS state FROM p",
    "portfolio_fund_flows": "WITH " + VIEWS["journal"] + ", x AS (SELECT ticker, arg_min(px * (30 - rank), day) AS a0, arg_max(px * (30 - rank), day) AS a1, arg_min(px, day) AS p0, arg_max(px, day) AS p1 FROM journal WHERE px > 0 GROUP BY 1 HAVING count(DISTINCT day) > 1) SELECT ticker, round(100 * ((a1 / a0) / (p1 / p0) - 1), 6) AS flow FROM x",
    "journal_deploy": "WITH " + VIEWS["journal"] + ", l AS (SELECT day, round(avg(px), 6) / 50 - 60 AS x FROM journal GROUP BY 1) SELECT day, CASE WHEN x <= -15 THEN 'BEAR' WHEN x <= -5 THEN 'PULLBACK' ELSE 'NEAR-HIGH' END AS state, CASE WHEN x <= -15 THEN 2.0 WHEN x <= -5 THEN 1.5 ELSE 1 END::DOUBLE AS times FROM l",
    "universe_tiered": """WITH q AS (SELECT DISTINCT 'P' || p_partkey AS stem, p_partkey, p_name AS name FROM part), v AS (SELECT q.*, CASE WHEN p_size < 10 THEN p_size END AS v1, CASE WHEN p_size > 40 THEN p_size END AS v2, CASE WHEN length(name) >= 10 THEN 0 END AS v3 FROM q JOIN part USING (p_partkey))
SELECT CASE WHEN v1 IS NOT NULL THEN 1 WHEN v2 IS NOT NULL THEN 2 WHEN v3 IS NOT NULL THEN 3 END AS tier, count(*) AS n, sum(coalesce(v1, v2, v3))::BIGINT AS total FROM v GROUP BY 1""",
    "walk_cadences": "WITH " + VIEWS["bars"] + ", r AS (SELECT ticker, (count(*) - 1) * 365.25::DOUBLE / nullif(max(bar_date) - min(bar_date), 0) AS r FROM bars GROUP BY 1) SELECT ticker, round(r, 6) AS per_year, greatest(floor(r + 0.5), 1)::BIGINT AS history, greatest(floor(r * 3 + 0.5), 1)::BIGINT AS hold, greatest(floor(r * 0.5 + 0.5), 1)::BIGINT AS step FROM r",
}
