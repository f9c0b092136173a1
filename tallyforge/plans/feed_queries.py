"""Queries of the feed parsers over documents that are made of the tables' rows, and SQL that gets the same from the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.sources import feeds as P
from tallyforge.sources import tables as T

E = F.expr


def _charts(s, d):
    """A chart of each user: an entry for each second with an event."""
    e = T.table(s, d, "events").select(E("'U' || user_id AS ticker"), E("unix_timestamp(CAST(ts AS TIMESTAMP)) AS t"), "event_id", "value")
    one = e.groupBy("ticker", "t").agg(F.max("event_id").alias("k"), F.max_by("value", "event_id").alias("v"))
    g = one.groupBy("ticker").agg(E("sort_array(collect_list(struct(t, k, v)))").alias("r"))
    quote = "array(named_struct('close', transform(r, x -> IF(x.k % 7 = 0, NULL, x.v)), 'volume', transform(r, x -> IF(x.k % 5 = 0, NULL, x.k % 100))))"
    return g.select("ticker", E(f"to_json(named_struct('chart', named_struct('result', array(named_struct('timestamp', transform(r, x -> x.t), 'indicators', named_struct('quote', {quote}))))))").alias("json"))


_PART = "p_partkey AS k, p_name AS name, p_brand AS brand, IF(p_partkey % 6 = 0, 'ie', 'IE') || lpad(CAST(p_partkey AS STRING), 9, '0') || (p_partkey % 10) AS isin"


def _venue_lists(s, d):
    rows = T.table(s, d, "part").selectExpr(*_PART.split(", p_name")[:1], "p_name AS name", "p_brand AS brand", _PART.split("p_brand AS brand, ")[1])
    rows = rows.withColumns({"symbol": E("CASE WHEN k % 9 = 0 THEN '' WHEN k % 11 = 0 THEN 'A-' || k ELSE ' P' || k END"), "fund": E("name || IF(k % 3 = 0, ' UCITS ETF', '')")})
    return rows.groupBy("brand").agg(E("to_json(named_struct('aaData', collect_list(array(name, isin, symbol)), 'rowData', collect_list(array(isin, fund))))").alias("json"))


def _registry(s, d):
    rec = "concat('<FinInstrmGnlAttrbts>', IF(k % 2 = 0, '\\n ', ''), '<Id>', id, '</Id>', IF(k % 2 = 0, '\\n', ''), '<FullNm>', name, IF(k % 3 = 0, ' UCITS ETF', ' Fund'), '</FullNm>', IF(k % 4 = 0, '<ShrtNm>x</ShrtNm>', ''), '<ClssfctnTp>', IF(k % 5 = 0, 'ESVUFR', 'CEOGES'), '</ClssfctnTp></FinInstrmGnlAttrbts>')"
    rows = T.table(s, d, "part").selectExpr("p_partkey AS k", "p_name AS name", "p_brand AS brand", "element_at(array('IE', 'US', 'LU', 'HK'), CAST(p_partkey % 4 AS INT) + 1) || lpad(CAST(p_partkey DIV 2 AS STRING), 9, '0') || '7' AS id")
    return rows.groupBy("brand").agg(E(f"'<x>' || array_join(collect_list({rec}), '') || '</x>'").alias("xml"))


def _links(s, d):
    rows = T.table(s, d, "supplier").selectExpr("s_suppkey % 2 AS half", "named_struct('file_name', 'FULINS_' || IF(s_suppkey % 3 = 0, 'D_', 'C_') || lpad(CAST(s_suppkey AS STRING), 6, '0'), 'download_link', 'https://example.org/' || s_suppkey) AS f")
    g = rows.groupBy("half").agg(F.collect_list("f").alias("f"))
    return g.select(E("IF(half = 0, to_json(named_struct('response', named_struct('docs', f))), to_json(named_struct('hits', named_struct('hits', transform(f, x -> named_struct('_source', x))))))").alias("json"))


def _zips(s, d):
    """The registry's documents in archives, two documents and a note in each."""
    import io
    import zipfile

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            for brand, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("a.xml", xml)
                    z.writestr("notes.txt", "not this")
                yield pa.RecordBatch.from_arrays([pa.array([brand], pa.string()), pa.array([held.getvalue()], pa.binary())], names=["path", "content"])

    return _registry(s, d).select("brand", "xml").mapInArrow(pack, "path string, content binary")


def years(s, d):
    """(ticker, k, y, rev, net, qty): sums of a supplier's year."""
    rows = T.table(s, d, "lineitem").selectExpr("'S' || l_suppkey AS ticker", "l_suppkey AS k", "year(l_shipdate) AS y", "CAST(l_extendedprice AS DECIMAL(18,2)) AS p", "CAST(l_discount AS DECIMAL(6,4)) AS dc", "CAST(l_quantity AS DECIMAL(18,2)) AS q")
    return rows.groupBy("ticker", "k", "y").agg(E("CAST(sum(p) AS DOUBLE) AS rev"), E("CAST(sum(CAST(p * dc AS DECIMAL(18,4))) AS DOUBLE) AS net"), E("CAST(sum(q) AS DOUBLE) AS qty"))


def _company_facts(s, d):
    """Yearly filings of each supplier: the year, the year before restated, an amendment every third year, and a quarter."""
    r = years(s, d)
    def fact(v: str, y: str, filed: str, form: str, instant: bool) -> str:
        start = "CAST(NULL AS STRING)" if instant else f"concat({y}, '-01-01')"
        return f"named_struct('start', {start}, 'end', concat({y}, '-12-31'), 'val', {v}, 'filed', {filed}, 'form', '{form}')"

    def each(v: str, instant: bool = False) -> str:
        first, again, change = fact(v, "y", "concat(y + 1, '-02-15')", "10-K", instant), fact(f"{v} * 1.01D", "y", "concat(y + 2, '-02-15')", "10-K", instant), fact(f"{v} * 1.02D", "y", "concat(y + 1, '-06-01')", "10-K/A", instant)
        quarter = fact(v, "y", "concat(y + 1, '-02-15')", "10-Q", instant)
        return f"flatten(collect_list(concat(array({first}, {again}, {quarter}), IF(y % 3 = 0, array({change}), array()))))"

    lists = {"rev": "rev", "net": "net", "eps": "net / qty", "qty": "qty"}
    g = r.groupBy("ticker", "k").agg(*[E(each(v)).alias(n) for n, v in lists.items()], E(each("rev * 3", True)).alias("assets"), E(each("rev / 2", True)).alias("equity"))
    unit = lambda ccy, c: f"named_struct('units', map('{ccy}', {c}))"
    home = f"to_json(named_struct('facts', map('us-gaap', map(IF(k % 2 = 0, 'Revenues', 'SalesRevenueNet'), {unit('USD', 'rev')}, 'NetIncomeLoss', {unit('USD', 'net')}, 'EarningsPerShareDiluted', {unit('USD/shares', 'eps')}, 'WeightedAverageNumberOfDilutedSharesOutstanding', {unit('shares', 'qty')}, 'Assets', {unit('USD', 'assets')}, 'StockholdersEquity', {unit('USD', 'equity')}))))"
    abroad = f"to_json(named_struct('facts', map('ifrs-full', map('Revenue', {unit('EUR', 'rev')}, 'ProfitLoss', {unit('EUR', 'net')}, 'DilutedEarningsLossPerShare', {unit('EUR/shares', 'eps')}, 'WeightedAverageShares', {unit('shares', 'qty')}, 'Assets', {unit('EUR', 'assets')}, 'Equity', {unit('EUR', 'equity')}))))"
    return g.select("ticker", E(f"IF(k % 5 = 0, {abroad}, {home})").alias("json"))


def filed_years(s, d):
    rows = P.filed_years(_company_facts(s, d))
    return rows.select("ticker", "filed", "period_end", *[F.round(c, 6).alias(c) for c in ("revenue", "net_margin", "eps", "shares", "prior_eps", "prior_shares", "roe", "roa", "assets")], "currency")


def _instances(s, d):
    """Instance documents: two share classes a year, of which the second has few shares; every third filer's net income fits none."""
    ctx = "concat('<xbrli:context id=\"', y, c, '\"><p>', '<xbrli:startDate>', y, '-01-01</xbrli:startDate><xbrli:endDate>', y, '-12-31</xbrli:endDate></p>', IF(c = 'n', '', concat('<xbrldi:explicitMember dimension=\"d\">Class', c, 'Member</xbrldi:explicitMember>')), '</xbrli:context>')"
    val = "IF(c = 'n', concat('<us-gaap:NetIncomeLoss id=\"i\" contextRef=\"', y, 'n\" x=\"1\">', net * IF(k % 3 = 0, 4, 1), '</us-gaap:NetIncomeLoss>'), concat('<us-gaap:EarningsPerShareDiluted contextRef=\"', y, c, '\">', round(net / qty, 4), '</us-gaap:EarningsPerShareDiluted><us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding contextRef=\"', y, c, '\">', IF(c = 'A', qty, qty / 10), '</us-gaap:WeightedAverageNumberOfDilutedSharesOutstanding>'))"
    r = years(s, d).crossJoin(F.broadcast(s.createDataFrame([("A",), ("B",), ("n",)], "c string")))
    return r.groupBy("ticker").agg(E(f"array_join(collect_list(concat({ctx}, {val})), '\\n')").alias("xml"))


def _filers(s, d):
    rows = T.table(s, d, "supplier").selectExpr("s_suppkey AS k", "named_struct('cik_str', s_suppkey * 7, 'ticker', 'S' || s_suppkey) AS r")
    return rows.groupBy().agg(E("to_json(map_from_entries(collect_list(struct(CAST(k AS STRING), r))))").alias("json"))


def _swaps(s, d):
    return T.table(s, d, "supplier").filter("s_suppkey % 4 = 0").selectExpr("'S' || s_suppkey AS home", "'E' || s_suppkey || '.DE' AS ticker")


def _ratios(s, d):
    rows = T.table(s, d, "events").selectExpr("event_id AS k", "user_id % 4 AS part", "named_struct('asset', 'a' || user_id % 20, 'CapMVRVCur', CAST(value - 1 AS STRING), 'time', date_format(ts, 'yyyy-MM-dd') || 'T00:00:00Z') AS r")
    return rows.groupBy("part").agg(E("to_json(named_struct('data', transform(sort_array(collect_list(struct(k, r))), x -> x.r)))").alias("json"))


def _fund_rows(s, d):
    fee = "CASE k % 4 WHEN 0 THEN concat('\"TER\": ', f) WHEN 1 THEN concat('\"costs\": {\"ongoingCharges\": \"', replace(CAST(f AS STRING), '.', ','), ' %\"}') WHEN 2 THEN concat('\"totalExpenseRatio\": \"', f, '\"') ELSE '\"none\": 1' END"
    use = "CASE k % 3 WHEN 0 THEN '{\"translations\": {\"en\": \"Accumulating\"}}' WHEN 1 THEN '{\"originalValue\": \"Distributing\"}' ELSE '{\"originalValue\": \"odd\"}' END"
    rows = T.table(s, d, "part").selectExpr("p_partkey AS k", "CAST(p_size AS DECIMAL(8,4)) / 1000 AS f", "p_retailprice AS a", "p_brand AS b")
    return rows.select(E("'X' || k AS isin"), E(f"concat('{{', {fee}, ', \"overview\": {{\"assetsUnderManagement\": ', IF(k % 7 = 0, -1, a), '}}, \"keyData\": {{\"useOfProfits\": ', {use}, ', \"replicationMethod\": {{\"originalValue\": \"', IF(k % 2 = 0, 'Swap-based', 'Sample'), '\"}}, \"benchmark\": {{\"originalValue\": \" ', b, ' \"}}}}}}')").alias("json"))


def _profiles(s, d):
    rows = T.table(s, d, "part").selectExpr("p_partkey AS k", "p_size AS z")
    return rows.select(E("'X' || k AS isin"), E("concat('<td data-testid=\"tl_etf-basics_value_ter\"> 0.', lpad(CAST(z AS STRING), 2, '0'), '% p.a.</td><tr data-testid=\"etf-basics_row_fund-size\"><td><div>EUR ', IF(k % 2 = 0, '1,', ''), 100 + z, CASE k % 3 WHEN 0 THEN ' m ' WHEN 1 THEN ' b' ELSE ' k' END, '</div></td></tr>')").alias("html"))


def _summaries(s, d):
    """A fund of each order: its lines are the holdings."""
    rows = T.table(s, d, "lineitem").selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_partkey AS p", "l_quantity AS q", "l_returnflag AS f", "l_extendedprice AS x")
    hold = "named_struct('symbol', IF(p % 5 = 0, '', 'p' || p), 'holdingName', 'name ' || p, 'holdingPercent', IF(p % 3 = 0, NULL, named_struct('raw', q / 100)))"
    sector = "map(CASE f WHEN 'R' THEN 'realestate' WHEN 'A' THEN 'basic_materials' ELSE 'consumer_cyclical' END, IF(p % 2 = 0, q / 100, 0D))"
    g = rows.groupBy("o").agg(E(f"transform(sort_array(collect_list(struct(n, p, q, x, {hold} AS h))), y -> y.h)").alias("h"), E(f"collect_list({sector})").alias("w"), F.max("q").alias("q"), F.sum(E("CAST(x AS DECIMAL(18,2))")).cast("double").alias("x"))
    told = "named_struct('fundProfile', named_struct('categoryName', IF(o % 2 = 0, ' Large Blend ', ' '), 'feesExpensesInvestment', named_struct('annualReportExpenseRatio', named_struct('raw', q / 10000))), 'summaryDetail', IF(o % 3 = 0, NULL, named_struct('totalAssets', named_struct('raw', x))), 'defaultKeyStatistics', named_struct('totalAssets', named_struct('raw', x / 2)), 'topHoldings', named_struct('holdings', h, 'sectorWeightings', w, 'stockPosition', IF(o % 4 = 0, NULL, named_struct('raw', 0.5D)), 'equityHoldings', named_struct('priceToEarnings', q / 1000)))"
    return g.select(E("'F' || o AS fund"), E(f"to_json(named_struct('quoteSummary', named_struct('result', array({told}))))").alias("json"))


def _cubes(s, d):
    rows = T.benchmark_bars(s, d).selectExpr("date_format(bar_date, 'yyyy-MM') AS m", "CAST(close AS DECIMAL(18,2)) AS c").groupBy("m").agg(E("CAST(sum(c) AS DOUBLE)").alias("v"))
    g = rows.groupBy().agg(E("sort_array(collect_list(struct(m, v)))").alias("r"))
    index = "map_from_entries(transform(r, (x, i) -> struct(x.m, i)))"
    value = "map_from_entries(filter(transform(r, (x, i) -> IF(month(to_date(x.m, 'yyyy-MM')) = 12, NULL, struct(CAST(i AS STRING), x.v))), e -> e IS NOT NULL))"
    return g.select(F.lit("all").alias("series"), E(f"to_json(named_struct('dimension', named_struct('time', named_struct('category', named_struct('index', {index}))), 'value', {value}))").alias("json"))


def _dated(s, d):
    g = _cubes_rows(s, d)
    as_list = "to_json(named_struct('dimension', named_struct('reference_date', named_struct('category', named_struct('index', transform(r, x -> x.m)))), 'value', transform(r, x -> IF(x.q < 10, NULL, x.v))))"
    by_place = "to_json(named_struct('dimension', named_struct('reference_date', named_struct('category', named_struct('index', map_from_entries(transform(r, (x, i) -> struct(x.m, i)))))), 'value', transform(r, x -> IF(x.q < 10, NULL, x.v))))"
    return g.select("series", E(f"IF(series % 2 = 0, {as_list}, {by_place})").alias("json")).select(E("'s' || series AS series"), "json")


def _cubes_rows(s, d):
    rows = T.table(s, d, "lineitem").selectExpr("l_suppkey AS series", "date_format(l_shipdate, 'yyyy-MM-dd') AS m", "l_quantity AS q", "l_extendedprice AS x").groupBy("series", "m").agg(F.max("q").alias("q"), F.max("x").alias("v"))
    return rows.groupBy("series").agg(E("sort_array(collect_list(struct(m, q, v)))").alias("r"))


_CCYS = [("S1", "USD", "EUR"), ("S2", "EUR", "JPY"), ("S3", "GBP", "EUR"), ("S4", "EUR", "USD"), ("S5", "EUR", "CHF")]
_ASKED = [("USD", "EUR"), ("EUR", "JPY"), ("GBP", "JPY"), ("USD", "GBP"), ("EUR", "EUR"), ("CHF", "XXX")]


def _euro(s, d):
    dim = F.broadcast(s.createDataFrame(_CCYS, "ticker string, base string, quote string"))
    return P.euro_rates(T.bars(s, d).join(dim, "ticker"))


QUERIES = {
    "feed_intraday_bars": lambda s, d: P.intraday_bars(_charts(s, d)),
    "feed_last_close": lambda s, d: P.last_close(_charts(s, d)),
    "feed_venue_symbols": lambda s, d: P.symbols_of_list(_venue_lists(s, d), 2, ".LS"),
    "feed_venue_isins": lambda s, d: P.isins_of_list(_venue_lists(s, d), "aaData", 1),
    "feed_venue_fund_isins": lambda s, d: P.isins_of_list(_venue_lists(s, d), "rowData", 0, 1),
    "feed_registry": lambda s, d: P.registry_isins(_registry(s, d)),
    "feed_registry_link": lambda s, d: P.newest_link(_links(s, d)),
    "feed_registry_zip": lambda s, d: P.merged_codes(P.registry_isins(P.zip_members(_zips(s, d)).select(F.col("text").alias("xml"))), T.table(s, d, "part").selectExpr("'OLD' || p_partkey AS isin").filter("isin LIKE '%7'")),
    "feed_company_facts": filed_years,
    "feed_instance_eps": lambda s, d: P.instance_eps(_instances(s, d)),
    "feed_filer_ids": lambda s, d: P.filer_ids(_filers(s, d), _swaps(s, d)),
    "feed_newest_ratios": lambda s, d: P.newest_ratios(_ratios(s, d), "2024-01-30"),
    "feed_fund_rows": lambda s, d: P.fund_rows(_fund_rows(s, d)),
    "feed_class_from_name": lambda s, d: T.table(s, d, "part").selectExpr("p_partkey", "p_name || element_at(array(' (Acc)', ' dist.', ' Accent', ' DISTRIBUTING acc'), CAST(p_partkey % 4 AS INT) + 1) AS name").select("p_partkey", P.class_from_name(F.col("name")).alias("told")),
    "feed_fund_profile": lambda s, d: P.fund_profile(_profiles(s, d)),
    "feed_fund_facts": lambda s, d: P.fund_facts(_summaries(s, d)),
    "feed_composition": lambda s, d: P.composition(_summaries(s, d)),
    "feed_fund_sectors": lambda s, d: P.fund_sectors(_summaries(s, d)).groupBy("fund", "sector").agg(F.round(F.sum("weight"), 6).alias("weight")),
    "feed_cube_rates": lambda s, d: P.cube_rates(_cubes(s, d)),
    "feed_dated_rates": lambda s, d: P.dated_rates(_dated(s, d)),
    "feed_reference_rate": lambda s, d: P.reference_rate(T.table(s, d, "pages")),
    "feed_euro_rates": lambda s, d: _euro(s, d).select("ccy", "bar_date", F.round("rate", 10).alias("rate")),
    "feed_cross_rates": lambda s, d: P.cross_rates(_euro(s, d), s.createDataFrame(_ASKED, "`from` string, `to` string")).select("from", "to", "bar_date", F.round("factor", 10).alias("factor")),
}

_EV = "WITH e AS (SELECT 'U' || user_id AS ticker, date_trunc('second', ts) AS ts, max(event_id) AS k, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2), b AS (SELECT ticker, ts, v AS close, CASE WHEN k % 5 = 0 THEN 0 ELSE k % 100 END::DOUBLE AS volume FROM e WHERE k % 7 <> 0)"
_P = "WITH p AS (SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 6 = 0 THEN 'ie' ELSE 'IE' END || lpad(p_partkey::VARCHAR, 9, '0') || (p_partkey % 10) AS isin FROM part)"
_REG = "WITH r AS (SELECT DISTINCT ['IE', 'US', 'LU', 'HK'][p_partkey % 4 + 1] || lpad((p_partkey // 2)::VARCHAR, 9, '0') || '7' AS isin FROM part WHERE (p_partkey % 3 = 0 OR regexp_matches(lower(p_name), 'etf|ucits')) AND p_partkey % 5 <> 0 AND p_partkey % 4 IN (0, 2))"
_YEARS = "WITH ys AS (SELECT 'S' || l_suppkey AS ticker, l_suppkey AS k, year(l_shipdate) AS y, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS rev, sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(6,4)) AS DECIMAL(18,4)))::DOUBLE AS net, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS qty FROM lineitem GROUP BY 1, 2, 3)"
FILED_YEARS = _YEARS + """, f AS (SELECT *, CASE WHEN y % 3 = 0 THEN 1.02::DOUBLE ELSE 1 END AS m FROM ys), b AS (SELECT f.*, p.net / p.qty * 1.01::DOUBLE AS pe, p.qty * 1.01::DOUBLE AS ps FROM f LEFT JOIN ys p ON p.ticker = f.ticker AND p.y = f.y - 1),
filed AS (SELECT ticker, CASE WHEN y % 3 = 0 THEN make_date(y + 1, 6, 1) ELSE make_date(y + 1, 2, 15) END AS filed, make_date(y, 12, 31) AS period_end, round(rev * m, 6) AS revenue, round(net * m / (rev * m) * 100, 6) AS net_margin, round(net / qty * m, 6) AS eps, round(qty * m, 6) AS shares,
  round(CASE WHEN y % 3 <> 0 THEN pe END, 6) AS prior_eps, round(CASE WHEN y % 3 <> 0 THEN ps END, 6) AS prior_shares, round(net * m / (rev / 2 * m) * 100, 6) AS roe, round(net * m / (rev * 3 * m) * 100, 6) AS roa, round(rev * 3 * m, 6) AS assets, CASE WHEN k % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM b)"""
_LINES = "WITH l AS (SELECT 'F' || l_orderkey AS fund, l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS n, l_partkey AS p, l_quantity AS q, l_returnflag AS f, l_extendedprice AS x FROM lineitem)"
_RATES = "WITH b AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS bar_date, max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2), r(ticker, ccy, inv) AS (VALUES ('S1', 'USD', 0), ('S2', 'JPY', 1), ('S3', 'GBP', 0), ('S5', 'CHF', 1)), x AS (SELECT ccy, bar_date, CASE WHEN inv = 1 THEN 1 / close ELSE close END AS rate FROM b JOIN r USING (ticker) WHERE close > 0)"

SQL = {
    "feed_intraday_bars": _EV + " SELECT * FROM b",
    "feed_last_close": _EV + " SELECT ticker, arg_max(close, ts) AS close FROM b GROUP BY 1",
    "feed_venue_symbols": _P + " SELECT 'P' || k || '.LS' AS symbol FROM p WHERE k % 9 <> 0 AND k % 11 <> 0",
    "feed_venue_isins": _P + " SELECT isin FROM p WHERE k % 6 <> 0",
    "feed_venue_fund_isins": _P + " SELECT isin FROM p WHERE k % 6 <> 0 AND (k % 3 = 0 OR regexp_matches(lower(name), 'etf|ucits'))",
    "feed_registry": _REG + " SELECT isin FROM r",
    "feed_registry_link": "SELECT 'https://example.org/' || max(s_suppkey) AS link FROM supplier WHERE s_suppkey % 3 <> 0",
    "feed_registry_zip": _REG + " SELECT isin FROM r UNION SELECT 'OLD' || p_partkey FROM part WHERE p_partkey % 10 = 7",
    "feed_company_facts": FILED_YEARS + " SELECT * FROM filed",
    "feed_instance_eps": _YEARS + ", c AS (SELECT ticker, make_date(y, 12, 31) AS period_end, round(net / qty, 4) AS eps, net * CASE WHEN k % 3 = 0 THEN 4 ELSE 1 END AS n, qty FROM ys) SELECT ticker, period_end, eps, CASE WHEN abs(qty * eps - n) <= abs(qty / 10 * eps - n) THEN qty ELSE qty / 10 END AS shares FROM c",
    "feed_filer_ids": "SELECT 'S' || s_suppkey AS ticker, lpad((s_suppkey * 7)::VARCHAR, 10, '0') AS cik FROM supplier UNION ALL SELECT 'E' || s_suppkey || '.DE', lpad((s_suppkey * 7)::VARCHAR, 10, '0') FROM supplier WHERE s_suppkey % 4 = 0",
    "feed_newest_ratios": "WITH k AS (SELECT 'a' || user_id % 20 AS asset, user_id % 4 AS part, value - 1 AS v, event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20' AND value > 1) SELECT asset, arg_max(v, event_id) AS ratio FROM k GROUP BY 1",
    "feed_fund_rows": "SELECT 'X' || p_partkey AS isin, round(CASE WHEN p_partkey % 4 <> 3 THEN CASE WHEN p_size / 10.0::DOUBLE < 5 THEN p_size / 10.0::DOUBLE END END, 6) AS ter, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS aum, CASE p_partkey % 3 WHEN 0 THEN 'Acc' WHEN 1 THEN 'Dist' END AS share_class, CASE WHEN p_partkey % 2 = 0 THEN 'Swap' ELSE 'Samp' END AS replication, lower(p_brand) AS benchmark FROM part",
    "feed_class_from_name": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Acc' WHEN 1 THEN 'Dist' WHEN 3 THEN 'Acc' END AS told FROM part",
    "feed_fund_profile": "SELECT 'X' || p_partkey AS isin, CASE WHEN p_size > 0 THEN ('0.' || lpad(p_size::VARCHAR, 2, '0'))::DOUBLE END AS ter, (CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 0 END + 100 + p_size) * CASE p_partkey % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e9 END AS aum FROM part",
    "feed_fund_facts": _LINES + ", g AS (SELECT fund, o, max(q) AS q, sum(CAST(x AS DECIMAL(18,2)))::DOUBLE AS x FROM l GROUP BY 1, 2) SELECT fund, round(q / 100, 6) AS ter, CASE WHEN o % 3 = 0 THEN x / 2 ELSE x END AS aum, CASE WHEN o % 4 <> 0 THEN 0.5::DOUBLE END AS stock, CASE WHEN o % 4 <> 0 THEN 0::DOUBLE END AS bond, round(1000 / q, 6) AS pe, CASE WHEN o % 2 = 0 THEN 'Large Blend' END AS category FROM g",
    "feed_composition": _LINES + " SELECT fund, n::INT AS at, CASE WHEN p % 5 = 0 THEN 'NAME ' || p ELSE 'P' || p END AS symbol, CASE WHEN p % 3 = 0 THEN 0 ELSE q / 100 END::DOUBLE AS weight FROM l WHERE n < 10",
    "feed_fund_sectors": _LINES + " SELECT fund, CASE f WHEN 'R' THEN 'Real Estate' WHEN 'A' THEN 'Basic Materials' ELSE 'Consumer Cyclical' END AS sector, round(sum(q / 100), 6) AS weight FROM l WHERE p % 2 = 0 GROUP BY 1, 2",
    "feed_cube_rates": "WITH b AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS c FROM lineitem GROUP BY 1), m AS (SELECT date_trunc('month', d) AS m, sum(CAST(c AS DECIMAL(18,2)))::DOUBLE AS v FROM b GROUP BY 1) SELECT 'all' AS series, year(m)::INT AS year, arg_max(v, m) AS rate FROM m WHERE month(m) <> 12 GROUP BY 2",
    "feed_dated_rates": "WITH m AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, max(l_quantity) AS q, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT 's' || k AS series, year(d)::INT AS year, arg_max(v, d) AS rate FROM m WHERE q >= 10 GROUP BY 1, 2",
    "feed_reference_rate": "SELECT page_id, nullif(regexp_extract(html, '(-?\\d+\\.\\d+)\\s*%', 1), '')::DOUBLE AS rate FROM pages",
    "feed_euro_rates": _RATES + " SELECT ccy, bar_date, round(rate, 10) AS rate FROM x",
    "feed_cross_rates": _RATES + """ SELECT 'USD' AS "from", 'EUR' AS "to", bar_date, round(rate, 10) AS factor FROM x WHERE ccy = 'USD' UNION ALL SELECT 'EUR', 'JPY', bar_date, round(1 / rate, 10) FROM x WHERE ccy = 'JPY'
UNION ALL SELECT a.ccy, b.ccy, a.bar_date, round(a.rate / b.rate, 10) FROM x a JOIN x b USING (bar_date) WHERE (a.ccy = 'GBP' AND b.ccy = 'JPY') OR (a.ccy = 'USD' AND b.ccy = 'GBP')""",
}
