"""Queries of the feed parsers over documents that are made of the tables' rows, and SQL that gets the same from the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.feed_queries import _charts, _registry
from tallyforge.sources import parsers as P
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

E = F.expr
TODAY = "2001-11-01"


def _chart_events(s, d):
    """A chart of each user: every fifth event pays, every eleventh splits, by nothing now and then."""
    e = T.table(s, d, "events").selectExpr("'U' || user_id AS ticker", "event_id AS k", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS t", "value")
    of = lambda when, entry: E(f"map_from_entries(collect_list(IF({when}, struct(CAST(k AS STRING), {entry}), NULL)))")
    one = e.groupBy("ticker").agg(of("k % 5 = 0", "named_struct('date', t, 'amount', value)").alias("paid"), of("k % 11 = 0", "named_struct('date', t, 'numerator', k % 4 + 1, 'denominator', k % 3)").alias("cut"))
    return one.select("ticker", E("to_json(named_struct('chart', named_struct('result', array(named_struct('events', named_struct('dividends', paid, 'splits', cut))))))").alias("json"))


def _statements(s, d):
    """A supplier's years as statements: odd years don't tell their end, every seventh supplier has no revenue, 1998 was filed on no day."""
    y = T.table(s, d, "lineitem").groupBy("l_suppkey", E("year(l_shipdate) AS y")).agg(E("CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS r"), E("CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q"))
    row = "named_struct('filingDate', IF(y = 1998, 'none', (y + 1) || '-02-01'), 'date', IF(y % 2 = 0, y || '-12-31', NULL), 'revenue', IF(l_suppkey % 7 = 0, 0, r), 'grossProfit', q * 100, 'operatingIncome', q * 50, 'netIncome', q * 20, 'eps', q / 8)"
    return y.groupBy(E("'S' || l_suppkey AS ticker")).agg(E(f"to_json(collect_list({row})) AS json"))


def _company_facts(s, d):
    """Yearly sums as facts, filed again a year later with another value; every third year is amended twice; half-years and other forms besides."""
    y = T.table(s, d, "lineitem").groupBy("l_suppkey", E("year(l_shipdate) AS y")).agg(E("CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q"))
    fact = lambda val, filed, form, end="12-31": f"named_struct('start', y || '-01-01', 'end', y || '-{end}', 'val', {val}, 'filed', {filed}, 'form', '{form}')"
    facts = f"concat(array({fact('q', "(y + 1) || '-02-01'", '10-K')}, {fact('q + 1', "(y + 2) || '-02-01'", '10-K')}, {fact('q / 2', "y || '-08-01'", '10-K', '06-30')}, {fact('q + 9', "y || '-12-31'", '8-K')}), IF(y % 3 = 0, array({fact('q + 2', "(y + 1) || '-05-01'", '10-K/A')}, {fact('q + 3', "(y + 1) || '-06-01'", '10-K/A')}), array()))"
    return y.groupBy(E("'S' || l_suppkey AS ticker")).agg(E(f"to_json(map('Revenues', flatten(collect_list({facts})))) AS json"))


def _eps_facts(s, d):
    """A full year's and each half-year's earnings a share, the full ones up to 2000, both filed twice."""
    li = T.table(s, d, "lineitem").selectExpr("'S' || l_suppkey AS ticker", "year(l_shipdate) AS y", "month(l_shipdate) <= 6 AS early", "CAST(l_discount * 100 AS DECIMAL(18,4)) AS x")
    years = li.filter("y <= 2000").groupBy("ticker", "y").agg(E("CAST(sum(x) AS DOUBLE) AS val")).selectExpr("ticker", "make_date(y, 1, 1) AS start", "make_date(y, 12, 31) AS end", "val", "make_date(y + 1, 2, 1) AS filed")
    halves = li.filter("early").groupBy("ticker", "y").agg(E("CAST(sum(x) AS DOUBLE) AS val")).selectExpr("ticker", "make_date(y, 1, 1) AS start", "make_date(y, 6, 30) AS end", "val", "make_date(y, 8, 1) AS filed")
    both = years.union(halves)
    return both.union(both.selectExpr("ticker", "start", "end", "val - 1", "date_sub(filed, 30)"))


def _forms(s, d):
    """A form of each hundred orders' lines."""
    rec = "concat('<t><transactionDate>\\n<value>', date_format(l_shipdate, 'yyyy-MM-dd'), '</value></transactionDate><transactionCode> ', CASE l_returnflag WHEN 'R' THEN 'P' WHEN 'A' THEN 'S' ELSE 'M' END, ' </transactionCode></t>')"
    return T.table(s, d, "lineitem").groupBy(E("'O' || (l_orderkey DIV 100) AS ticker")).agg(E(f"array_join(collect_list({rec}), '') AS xml"))


def _pages(s, d):
    """A page of each hundred parts; some rows lack a symbol, a sector or cells."""
    row = "concat('<tr class=\"x\"><td><a href=\"/p\">', IF(k % 13 = 0, '', 'P' || k), '</a></td>', IF(k % 17 = 0, '', concat('<td>', p_name, '</td><td>', IF(k % 7 = 0, ' ', p_brand), '</td>')), '</tr>')"
    rows = T.table(s, d, "part").withColumn("k", F.col("p_partkey"))
    return rows.groupBy(E("k DIV 100 AS page")).agg(E(f"concat('<p>x</p><table id=\"constituents\"><tr><th>Symbol</th></tr>', array_join(collect_list({row}), '\\n'), '</table><table><tr><td>no</td><td>no</td><td>no</td></tr></table>') AS html"))


def _csv(s, d):
    return T.table(s, d, "part").select(E("concat(IF(p_partkey % 9 = 0, ' ', 'P' || p_partkey), ',\"', p_name, ', Inc.\",', IF(p_partkey % 4 = 0, '', p_brand)) AS line"))


def _span_lines(s, d):
    return T.table(s, d, "supplier").select(E("concat(IF(s_suppkey % 11 = 0, '', 'S.' || s_suppkey), ',', IF(s_suppkey % 5 = 0, 'x', '199' || s_suppkey % 10 || '-01-01'), ',', CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '2000-06-30' WHEN 2 THEN 'y' ELSE ' ' END) AS line"))


def _mixes(s, d):
    """Sixteen orders are a fund, their lines its holdings: some without a symbol or a weight."""
    rows = T.table(s, d, "lineitem").groupBy(E("l_orderkey DIV 16 AS f"), "l_partkey").agg(E("CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS w"))
    h = "named_struct('symbol', IF(x.l_partkey % 5 = 0, ' ', 'P' || x.l_partkey), 'holdingName', 'name ' || x.l_partkey, 'holdingPercent', IF(x.l_partkey % 6 = 0, NULL, x.w / 1000))"
    one = rows.groupBy("f").agg(E("sort_array(collect_list(struct(l_partkey, w))) AS r"))
    return one.select(E("'F' || f AS fund"), E(f"to_json(named_struct('holdings', transform(r, x -> {h}), 'priceToEarnings', IF(f % 3 = 0, 0, 1 / (f % 30 + 1)))) AS json"))


def _levels(s, d):
    """A price index: the mean order of each month, and a thirteenth month a year."""
    m = T.table(s, d, "orders").groupBy(E("year(o_orderdate) AS y"), E("month(o_orderdate) AS m")).agg(E("round(CAST(avg(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 4) AS v"))
    every = m.union(m.selectExpr("y", "13", "999.0D").distinct())
    return every.agg(E("to_json(collect_list(named_struct('year', CAST(y AS STRING), 'period', 'M' || lpad(CAST(m AS STRING), 2, '0'), 'value', CAST(v AS STRING)))) AS json"))  # a row a month


def _news(s, d):
    rows = T.table(s, d, "part").groupBy(E("p_partkey DIV 8 AS g")).agg(E("sort_array(collect_list(struct(p_partkey, p_name))) AS r"))
    item = "CASE WHEN x.p_partkey % 3 = 0 THEN named_struct('title', x.p_name, 'content', CAST(NULL AS STRUCT<title: STRING>)) WHEN x.p_partkey % 3 = 1 THEN named_struct('title', CAST(NULL AS STRING), 'content', named_struct('title', x.p_name)) ELSE named_struct('title', CAST(NULL AS STRING), 'content', CAST(NULL AS STRUCT<title: STRING>)) END"
    return rows.select(E("'G' || g AS ticker"), E(f"to_json(transform(r, x -> {item})) AS json"))


def _journal_lines(s, d):
    """The journal's days as lines, every fifth of them broken off, and an empty line."""
    one = T.journal(s, d).groupBy("day").agg(E("to_json(named_struct('date', CAST(day AS STRING), 'rows', transform(sort_array(collect_list(struct(rank, ticker, px))), x -> array(x.ticker, CAST(x.px AS STRING))))) AS j"))
    line = one.select(E("IF(dayofmonth(day) % 5 = 0, substr(j, 1, 12), j) AS line"))
    return line.union(one.filter("dayofmonth(day) = 1").selectExpr("'' AS line"))


QUERIES = {
    "parse_chart_bars": lambda s, d: P.chart_bars(_charts(s, d)),
    "parse_chart_events": lambda s, d: P.chart_events(_chart_events(s, d)),
    "parse_statements": lambda s, d: P.statements(_statements(s, d)),
    "parse_company_facts": lambda s, d: P.company_facts(_company_facts(s, d), ["Revenues", "SalesRevenueNet"]),
    "parse_ttm_eps": lambda s, d: P.ttm_eps(_eps_facts(s, d), TODAY),
    "parse_trade_forms": lambda s, d: P.trade_forms(_forms(s, d)),
    "parse_html_table": lambda s, d: P.html_table(_pages(s, d), "constituents"),
    "parse_page_links": lambda s, d: P.links(T.table(s, d, "pages")),
    "parse_constituents": lambda s, d: P.constituents(_csv(s, d)),
    "parse_member_spans": lambda s, d: P.member_spans(_span_lines(s, d)),
    "parse_registry": lambda s, d: P.registry_isins(_registry(s, d)),
    "parse_composition": lambda s, d: P.composition(_mixes(s, d)),
    "parse_price_index": lambda s, d: P.price_index_rates(_levels(s, d)),
    "parse_titles": lambda s, d: P.titles(_news(s, d)),
    "parse_journal": lambda s, d: P.journal_lines(_journal_lines(s, d)),
    "parse_journal_corrupt": lambda s, d: P.corrupt_lines(_journal_lines(s, d)),
    "parse_merged_months": lambda s, d: P.merge_monthly(T.bars(s, d).filter("bar_date >= '1999-01-01'").select("ticker", "bar_date", "close"), T.bars(s, d).groupBy("ticker", F.last_day("bar_date").alias("bar_date")).agg(F.max_by("close", "bar_date").alias("close"))),
    "parse_names": lambda s, d: T.table(s, d, "part").select("p_partkey", P.name_of(E("IF(p_partkey % 3 = 0, ' ', IF(p_partkey % 3 = 1, NULL, p_name))"), E("IF(p_partkey % 2 = 0, p_brand, '')"), E("'P' || p_partkey")).alias("name")),
}

_YEARS = "y AS (SELECT l_suppkey AS k, year(l_shipdate) AS y, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS r, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS q FROM lineitem GROUP BY 1, 2)"
_MARGIN = "round(q * {m} / nullif(CASE WHEN k % 7 = 0 THEN 0 ELSE r END, 0) * 100, 6)"

SQL = {
    "parse_chart_bars": """WITH o AS (SELECT 'U' || user_id AS ticker, floor(epoch(ts)) AS t, max(event_id) AS k, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2)
SELECT ticker, CAST(to_timestamp(t) AT TIME ZONE 'UTC' AS DATE) AS bar_date, v AS close, CASE WHEN k % 5 = 0 THEN 0 ELSE k % 100 END::DOUBLE AS volume FROM o WHERE k % 7 <> 0""",
    "parse_chart_events": """SELECT 'U' || user_id AS ticker, 'dividend' AS kind, CAST(ts AS DATE) AS day, value FROM events WHERE event_id % 5 = 0
UNION ALL SELECT 'U' || user_id, 'split', CAST(ts AS DATE), (event_id % 4 + 1) / (event_id % 3)::DOUBLE FROM events WHERE event_id % 11 = 0 AND event_id % 3 <> 0""",
    "parse_statements": f"""WITH {_YEARS} SELECT 'S' || k AS ticker, make_date(y + 1, 2, 1) AS filed, CASE WHEN y % 2 = 0 THEN make_date(y, 12, 31) ELSE make_date(y + 1, 2, 1) END AS period_end, CASE WHEN k % 7 = 0 THEN 0 ELSE r END AS revenue,
  {_MARGIN.format(m=100)} AS gross_margin, {_MARGIN.format(m=50)} AS operating_margin, {_MARGIN.format(m=20)} AS net_margin, q / 8 AS eps FROM y WHERE y <> 1998""",
    "parse_company_facts": f"""WITH {_YEARS} SELECT 'S' || k AS ticker, make_date(y, 12, 31) AS period_end, CASE WHEN y % 3 = 0 THEN q + 3 ELSE q END AS value, CASE WHEN y % 3 = 0 THEN make_date(y + 1, 6, 1) ELSE make_date(y + 1, 2, 1) END AS filed FROM y""",
    "parse_ttm_eps": f"""WITH x AS (SELECT 'S' || l_suppkey AS ticker, year(l_shipdate) AS y, month(l_shipdate) <= 6 AS early, CAST(l_discount * 100 AS DECIMAL(18,4)) AS v FROM lineitem),
f AS (SELECT ticker, max(y) AS y FROM x WHERE y <= 2000 GROUP BY 1), a AS (SELECT ticker, y, sum(v)::DOUBLE AS v FROM x GROUP BY 1, 2), h AS (SELECT ticker, y, sum(v)::DOUBLE AS v FROM x WHERE early GROUP BY 1, 2),
r AS (SELECT f.ticker, a.v AS full_, CASE WHEN n.v IS NULL THEN a.v ELSE a.v + n.v - p.v END AS v, CASE WHEN n.v IS NULL THEN make_date(f.y, 12, 31) ELSE make_date(n.y, 6, 30) END AS e FROM f JOIN a USING (ticker, y) LEFT JOIN h n ON n.ticker = f.ticker AND n.y = (SELECT max(y) FROM h WHERE h.ticker = f.ticker AND h.y > f.y) LEFT JOIN h p ON p.ticker = f.ticker AND p.y = n.y - 1)
SELECT ticker, round(CASE WHEN DATE '{TODAY}' - e <= 730 AND abs(v) <= 100 * abs(full_) THEN v END, 6) AS eps FROM r""",
    "parse_trade_forms": "SELECT 'O' || (l_orderkey // 100) AS ticker, CAST(l_shipdate AS DATE) AS tx_date, l_returnflag = 'R' AS buy FROM lineitem WHERE l_returnflag IN ('R', 'A')",
    "parse_html_table": "SELECT 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_brand END AS sector FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0",
    "parse_page_links": """WITH m AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages),
u AS (SELECT page_id, unnest(range(len(h))) AS i, h, l FROM m) SELECT page_id, CAST(i AS INT) AS at, h[i + 1] AS href, l[i + 1] AS label FROM u""",
    "parse_constituents": "SELECT 'P' || p_partkey AS symbol, p_name || ', Inc.' AS name, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_brand END AS sector FROM part WHERE p_partkey % 9 <> 0",
    "parse_member_spans": "SELECT 'S-' || s_suppkey AS ticker, make_date(1990 + s_suppkey % 10, 1, 1) AS start_date, CASE WHEN s_suppkey % 4 = 1 THEN DATE '2000-06-30' END AS end_date FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 2",
    "parse_registry": "SELECT DISTINCT ['IE', 'US', 'LU', 'HK'][p_partkey % 4 + 1] || right('000000000' || (p_partkey // 2), 9) || '7' AS isin FROM part WHERE p_partkey % 5 <> 0",
    "parse_composition": """WITH r AS (SELECT l_orderkey // 16 AS f, l_partkey AS k, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) AS rn FROM r)
SELECT 'F' || f AS fund, CASE WHEN k % 5 = 0 THEN 'NAME ' || k ELSE 'P' || k END AS symbol, round(100 * CASE WHEN k % 6 = 0 THEN 0 ELSE w / 1000 END, 6) AS weight, round(CASE WHEN f % 3 <> 0 THEN f % 30 + 1 END::DOUBLE, 6) AS pe FROM n WHERE rn <= 10""",
    "parse_price_index": """WITH m AS (SELECT year(o_orderdate)::INT AS y, month(o_orderdate) AS m, round(avg(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE, 4) AS v FROM orders GROUP BY 1, 2)
SELECT a.y AS year, round(100 * (arg_max(a.v / b.v, a.m) - 1), 6) AS rate FROM m a JOIN m b ON b.y = a.y - 1 AND b.m = a.m GROUP BY 1""",
    "parse_titles": "SELECT 'G' || (p_partkey // 8) AS ticker, p_name AS title FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey) AS rn FROM part WHERE p_partkey % 3 <> 2) WHERE rn <= 3",
    "parse_journal": "WITH " + VIEWS["journal"] + " SELECT day, row_number() OVER (PARTITION BY day ORDER BY rank)::INT AS rank, ticker, px FROM journal WHERE day(day) % 5 <> 0",
    "parse_journal_corrupt": "WITH " + VIEWS["journal"] + " SELECT count(DISTINCT day) AS n_corrupt FROM journal WHERE day(day) % 5 = 0",
    "parse_merged_months": "WITH " + VIEWS["bars"] + """, f AS (SELECT ticker, min(bar_date) AS first FROM bars WHERE bar_date >= DATE '1999-01-01' GROUP BY 1), m AS (SELECT ticker, last_day(bar_date) AS bar_date, arg_max(close, bar_date) AS close FROM bars GROUP BY 1, 2)
SELECT ticker, bar_date, close FROM bars WHERE bar_date >= DATE '1999-01-01' UNION ALL SELECT m.* FROM m JOIN f USING (ticker) WHERE m.bar_date < first""",
    "parse_names": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'P' || p_partkey END AS name FROM part",
}
