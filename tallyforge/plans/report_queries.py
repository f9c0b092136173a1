"""Queries of the journal, universe and report operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import journal as J
from tallyforge.operators import universe as U
from tallyforge.sources import tables as T
from tallyforge.sources.tables import SQL as VIEWS

LADDER = [(1, 0.0), (2, 0.25), (6, 0.5), (10, 1.0)]
#: Codes of parts: good ones, and others with small letters, a letter at the end, a digit too many, or none at all.
CODE = "CASE p_partkey % 6 WHEN 0 THEN 'ie' WHEN 1 THEN '' ELSE 'US' END || right('00000000' || p_partkey, 8) || CASE p_partkey % 4 WHEN 0 THEN 'a' ELSE '7' END || CASE p_partkey % 5 WHEN 0 THEN 'X' WHEN 1 THEN '12' ELSE '3' END"
CCY = "CASE n_nationkey WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'GBp' ELSE 'C' || n_nationkey END"


def _inline(s, kind, rows):
    return s.createDataFrame(rows, kind)


def _symbols(s, d):
    """A symbol of each part: plain, with a share class, with one of the venues' suffixes or an unknown one, or a coin."""
    suffixes = F.array(*map(F.lit, [*U.VENUES, "XX", "ls"]))
    k = F.col("p_partkey")
    name = F.concat(F.lit("P"), k.cast("string"))
    tail = F.when(k % 5 == 0, "").when(k % 5 == 1, ".A").when(k % 5 == 2, "-USD").otherwise(F.concat(F.lit("."), F.get(suffixes, F.floor(k / 5) % len([*U.VENUES, "XX", "ls"]))))
    return T.table(s, d, "part").select(F.concat(name, tail).alias("symbol"))


def _holdings(s, d):
    """What a fund of sixteen orders holds: parts, by quantity."""
    rows = T.table(s, d, "lineitem").select(F.floor(F.col("l_orderkey") / 16).alias("o"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), "l_quantity")
    return rows.groupBy("o", "symbol").agg(F.sum("l_quantity").alias("weight")).select((F.col("o") % 7).alias("report"), F.concat(F.lit("F"), F.col("o").cast("string")).alias("fund"), "symbol", "weight")


def _positions(s, d):
    funds = _holdings(s, d).groupBy("fund").agg(F.max("weight").alias("weight")).withColumnRenamed("fund", "ticker")
    return funds.union(T.table(s, d, "part").filter("p_size = 7").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.col("p_size").cast("double")))


def _shares(s, d, name, key):
    rows = T.table(s, d, name).groupBy(F.concat(F.lit("N"), F.col(key).cast("string")).alias("ticker")).agg(F.count("*").alias("n"))
    return rows.withColumn("weight", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).drop("n")


def _fund_names(s, d):
    k = F.col("p_partkey")
    issuer = F.get(F.array(*map(F.lit, [*U.ISSUERS, "Nobody"])), k % (len(U.ISSUERS) + 1))
    return T.table(s, d, "part").select(F.concat_ws(" ", F.upper(issuer), F.when(k % 3 == 0, F.concat(F.upper(issuer), F.lit(" Core"))), F.col("p_type"), F.when(k % 4 == 0, "S&P-500 U.S."), F.lit("UCITS ETF USD (Acc)")).alias("name")).distinct()


def _levels(s, d):
    return T.benchmark_bars(s, d).groupBy(F.trunc("bar_date", "month").alias("day")).agg(F.round(F.sum("close"), 4).alias("level"))


def _grades(s, d):
    j = T.journal(s, d)
    ends = j.groupBy("ticker").agg(F.max_by("px", "day").alias("px_now"))
    lv = j.groupBy("day").agg(F.avg("px").alias("level"))
    index = lv.withColumn("level_now", F.max_by("level", "day").over(Window.partitionBy(F.lit(1))))
    return J.grade(j, ends, index)


def _ponds(s, d):
    sup = T.sectors(s, d).select(F.col("ticker").alias("symbol"), "sector", "market")
    return U.union_first_wins([sup.filter("market = 'ASIA'"), sup.filter("market IN ('ASIA', 'EUROPE')").withColumn("sector", F.lower("sector")), sup.withColumn("sector", F.lit("rest"))], [10, 20, None])


def _lists(s, d):
    main = T.table(s, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("isin"), F.col("p_retailprice").alias("size")).filter("size > 1500")
    return U.merge_lists(main, T.table(s, d, "part").filter("p_size < 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("isin")), 50)


def _pool(s, d):
    sp = T.spans(s, d)
    return U.pit_pool(T.sectors(s, d), sp.filter("end_date IS NULL"), sp.filter("start_date < '1997-01-01'"))


def _pairs(s, d):
    """A currency pair of most nations, its price the suppliers' mean balance: even ones against the euro, odd ones the other way."""
    mean = F.round(F.avg(F.abs("s_acctbal").cast("decimal(18,4)")).cast("double") / 1000, 6)
    both = T.table(s, d, "nation").join(T.table(s, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).filter("n_nationkey % 7 <> 5 AND n_nationkey NOT IN (0, 2)")
    priced = both.groupBy("n_nationkey", F.expr(CCY).alias("ccy")).agg(mean.alias("px"))
    even = F.col("n_nationkey") % 2 == 0
    return priced.select(F.when(even, F.col("ccy")).otherwise("EUR").alias("base"), F.when(even, "EUR").otherwise(F.col("ccy")).alias("quote"), "px")


def _savings(s, d):
    """Orders as deposits, until 2002, by priority."""
    paid = T.table(s, d, "orders").select("o_orderpriority", (F.lit(2002) - F.year("o_orderdate")).alias("years"), F.col("o_totalprice").cast("decimal(18,4)").alias("x")).groupBy("o_orderpriority", "years").agg(F.sum("x").cast("double").alias("paid"))
    grown = paid.withColumn("gain", J.savings_gain(F.col("years"), LADDER, 2.0))
    return grown.groupBy("o_orderpriority").agg(F.round(F.sum("paid"), 2).alias("paid"), F.round(F.sum(F.col("paid") * (1 + F.col("gain") / 100)), 2).alias("value"))


QUERIES = {
    "journal_grade": _grades,
    "journal_summary": lambda s, d: J.summary(_grades(s, d)),
    "journal_leaders": lambda s, d: J.leaders(T.journal(s, d), 0.2),
    "journal_rank_trend": lambda s, d: J.rank_trend(T.journal(s, d)),
    "journal_stability": lambda s, d: J.stability(T.journal(s, d)),
    "journal_membership_diff": lambda s, d: J.membership_diff(T.journal(s, d)),
    "journal_append_once": lambda s, d: J.append_once(T.journal(s, d).filter("day < '2024-01-11'"), T.journal(s, d).withColumn("px", F.col("px") * 2)),
    "journal_restate": lambda s, d: J.restate(T.journal(s, d), _inline(s, "s_ticker string, eff string, ratio double", [("U1", "2024-01-10", 2.0), ("U1", "2024-01-20", 3.0), ("U7", "2024-01-15", 0.5)]).select("s_ticker", F.col("eff").cast("date").alias("eff_date"), "ratio")),
    "journal_paper_savings": lambda s, d: J.paper_savings(T.journal(s, d), period="week"),  # the journal spans a month
    "journal_dip_alerts": lambda s, d: J.dip_alerts(T.journal(s, d)),
    "market_state_flips": lambda s, d: J.state_flips(_levels(s, d)),
    "savings_ladder": _savings,
    "universe_first_wins": _ponds,
    "universe_merge_lists": _lists,
    "universe_pit_pool": _pool,
    "universe_symbols": lambda s, d: _symbols(s, d).select("symbol", U.normal_symbol(F.col("symbol")).alias("normal"), U.market_of(F.col("symbol")).alias("country"), U.listing_currency(F.col("symbol")).alias("currency"), U.asset_class(F.col("symbol"), F.endswith("symbol", F.lit("0"))).alias("class")),
    "universe_isins": lambda s, d: T.table(s, d, "part").select(F.expr(CODE).alias("code")).distinct().select("code", U.is_isin(F.col("code")).alias("ok")),
    "universe_sector_filter": lambda s, d: T.sectors(s, d).filter(U.sector_matches(F.col("sector"), ["nation_1", " _2"])).groupBy("sector").agg(F.count("*").alias("n")),
    "universe_prefix_lookup": lambda s, d: U.prefix_lookup(T.table(s, d, "part").select(F.left("p_name", F.lit(12)).alias("name")).distinct(), T.table(s, d, "part").groupBy(F.col("p_name").alias("known")).agg(F.min("p_size").alias("value")), 6),
    "universe_quality_counters": lambda s, d: U.quality_counters(T.table(s, d, "events").select(F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.zz").alias("zz"), "event_type"), ["k", "zz", "event_type"]),
    "report_overlaps": lambda s, d: U.overlaps(_holdings(s, d)),
    "report_overlap_groups": lambda s, d: U.overlap_groups(_holdings(s, d)),
    "report_concentration": lambda s, d: U.concentration(_holdings(s, d), most=150.0),
    "report_look_through": lambda s, d: U.look_through(_positions(s, d), _holdings(s, d), T.table(s, d, "part").filter("p_size > 2").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_brand").alias("field"))),
    "report_allocation_gaps": lambda s, d: U.allocation_gaps(_shares(s, d, "supplier", "s_nationkey"), _shares(s, d, "customer", "c_nationkey"), 1.0),
    "report_index_keys": lambda s, d: _fund_names(s, d).select("name", U.index_key(F.col("name")).alias("key")),
    "fx_rates": lambda s, d: U.fx_rates(T.table(s, d, "nation").selectExpr(f"{CCY} AS ccy"), _pairs(s, d)),
    "relational_rollup": lambda s, d: T.table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")),
    "relational_pivot": lambda s, d: T.table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))),
    "relational_set_ops": lambda s, d: T.table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(T.table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).exceptAll(s.range(0, 3).select(F.col("id").cast("int").alias("k"))),
    "event_windows": lambda s, d: T.table(s, d, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total")),
}

_J = "WITH " + VIEWS["journal"]
_GRADES = _J + """, e AS (SELECT ticker, arg_max(px, day) AS px_now FROM journal GROUP BY 1), lv AS (SELECT day, avg(px) AS level FROM journal GROUP BY 1), ix AS (SELECT *, (SELECT arg_max(level, day) FROM lv) AS level_now FROM lv),
g AS (SELECT day, count(*) AS n, round(100 * avg(px_now / px - 1), 6) AS ret, round(100 * (avg(px_now / px - 1) - max(level_now / level - 1)), 6) AS excess FROM journal JOIN e USING (ticker) JOIN ix USING (day) WHERE rank <= 10 AND px > 0 GROUP BY day)"""
_SEC = "WITH " + VIEWS["sectors"]

_HOLD = "WITH h AS (SELECT 'F' || (l_orderkey // 16) AS fund, 'P' || l_partkey AS symbol, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)"


def _v(columns: str, rows: list) -> str:
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(q(x) for x in r) + ')' for r in rows)}) v({columns})"


SQL = {
    "journal_grade": _GRADES + " SELECT * FROM g",
    "journal_summary": _GRADES + " SELECT count(*) AS n, count(*) FILTER (WHERE excess > 0) AS wins, round(sum(excess), 4) AS sum_excess FROM g",
    "journal_leaders": _J + " SELECT ticker, count(DISTINCT day) AS n FROM journal GROUP BY 1 HAVING count(DISTINCT day) >= 0.2::DOUBLE * (SELECT count(DISTINCT day) FROM journal)",
    "journal_rank_trend": _J + """, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM journal),
x AS (SELECT ticker, n, round(avg(rank), 6) AS mean_rank, round(avg(rank) FILTER (WHERE k <= n // 2), 6) AS early, round(avg(rank) FILTER (WHERE k > n // 2), 6) AS late FROM k WHERE n >= 3 GROUP BY 1, 2) SELECT *, CASE WHEN late < early - 1 THEN 'up' WHEN late > early + 1 THEN 'down' ELSE 'flat' END AS trend FROM x""",
    "journal_stability": _J + ", b AS (SELECT day, array_agg(DISTINCT ticker) AS held FROM journal WHERE rank <= 10 GROUP BY 1), l AS (SELECT *, lag(held) OVER (ORDER BY day) AS was FROM b) SELECT round(avg(len(list_intersect(held, was))::DOUBLE / least(len(held), len(was))), 6) AS stability FROM l WHERE was IS NOT NULL",
    "journal_membership_diff": _J + """, d AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM journal)) SELECT j.day, j.ticker, '+' AS change FROM journal j JOIN d USING (day) WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM journal o WHERE o.day = before AND o.ticker = j.ticker)
UNION ALL SELECT d.day, o.ticker, '-' FROM d JOIN journal o ON o.day = before WHERE NOT EXISTS (SELECT 1 FROM journal j WHERE j.day = d.day AND j.ticker = o.ticker)""",
    "journal_append_once": _J + " SELECT day, rank, ticker, CASE WHEN day < DATE '2024-01-11' THEN px ELSE px * 2 END AS px FROM journal",
    "journal_restate": _J + """, s(t, eff, ratio) AS (VALUES ('U1', DATE '2024-01-10', 2.0), ('U1', DATE '2024-01-20', 3.0), ('U7', DATE '2024-01-15', 0.5)) SELECT day, rank, ticker, round(px / coalesce((SELECT product(ratio) FROM s WHERE t = ticker AND eff > day), 1), 6) AS px FROM journal""",
    "journal_paper_savings": _J + """, f AS (SELECT CAST(date_trunc('week', day) AS DATE) AS period, min(day) AS day FROM journal GROUP BY 1), p AS (SELECT period, ticker, px FROM journal JOIN f USING (day) WHERE rank <= 5 AND px > 0), c AS (SELECT period, count(*) AS names FROM p GROUP BY 1),
e AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM f)::TIMESTAMP, (SELECT max(period) FROM f)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS period), t AS (SELECT e.period, names, row_number() OVER (ORDER BY e.period) AS k FROM e LEFT JOIN c USING (period)),
u AS (SELECT *, max(CASE WHEN names > 0 THEN k END) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM t), b AS (SELECT period, 100.0::DOUBLE * (k - coalesce(last, 0)) / names AS alloc FROM u WHERE names > 0)
SELECT ticker, count(*) AS lots, round(sum((alloc - 1) / px), 6) AS qty, round(sum(alloc), 4) AS cost FROM p JOIN b USING (period) WHERE alloc > 1 GROUP BY 1""",
    "journal_dip_alerts": _J + ", r AS (SELECT *, px <= 0.7::DOUBLE * max(px) OVER (PARTITION BY ticker ORDER BY day) AS dip FROM journal), l AS (SELECT *, lag(dip) OVER (PARTITION BY ticker ORDER BY day) AS was FROM r) SELECT ticker, day FROM l WHERE dip AND NOT coalesce(was, false)",
    "market_state_flips": "WITH " + VIEWS["bench"] + """, m AS (SELECT CAST(date_trunc('month', bar_date) AS DATE) AS day, round(sum(close), 4) AS level FROM bench GROUP BY 1), d AS (SELECT *, 100 * (level / max(level) OVER (ORDER BY day) - 1) AS dd FROM m),
s AS (SELECT day, CASE WHEN dd <= -15 THEN 'BEAR' WHEN dd <= -5 THEN 'PULLBACK' ELSE 'NEAR-HIGH' END AS state FROM d), l AS (SELECT *, lag(state) OVER (ORDER BY day) AS was FROM s) SELECT day, was, state FROM l WHERE was IS NOT NULL AND was <> state""",
    "savings_ladder": """WITH RECURSIVE g(years, f) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT years + 1, f * (1 + (2.0 + CASE WHEN years + 1 >= 10 THEN 1.0 WHEN years + 1 >= 6 THEN 0.5 WHEN years + 1 >= 2 THEN 0.25 ELSE 0 END) / 100) FROM g WHERE years < 15),
p AS (SELECT o_orderpriority, 2002 - year(o_orderdate) AS years, sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE AS paid FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round(sum(paid), 2) AS paid, round(sum(paid * f), 2) AS value FROM p JOIN g USING (years) GROUP BY 1""",
    "universe_first_wins": _SEC + """, a AS (SELECT ticker AS symbol, sector, 0 AS pond FROM sectors WHERE market = 'ASIA' ORDER BY symbol LIMIT 10), b AS (SELECT ticker AS symbol, lower(sector) AS sector, 1 AS pond FROM sectors WHERE market IN ('ASIA', 'EUROPE') ORDER BY symbol LIMIT 20), c AS (SELECT ticker AS symbol, 'rest' AS sector, 2 AS pond FROM sectors),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT symbol, arg_min(sector, pond) AS sector, min(pond)::INT AS pond FROM u GROUP BY 1""",
    "universe_merge_lists": "WITH m AS (SELECT 'P' || p_partkey AS isin, p_retailprice AS size FROM part WHERE p_retailprice > 1500), h AS (SELECT isin, false AS speculative FROM m ORDER BY size DESC, isin LIMIT 50) SELECT * FROM h UNION ALL SELECT DISTINCT 'P' || p_partkey, true FROM part WHERE p_size < 10 AND 'P' || p_partkey NOT IN (SELECT isin FROM m)",
    "universe_pit_pool": _SEC + ", " + VIEWS["spans"] + " SELECT ticker FROM sectors WHERE ticker NOT IN (SELECT ticker FROM spans WHERE end_date IS NULL) UNION SELECT ticker FROM spans WHERE start_date < DATE '1997-01-01'",
    "universe_symbols": f"""WITH v(suffix, country, currency) AS (VALUES {', '.join(f"('{k}', '{c}', '{m}')" for k, (c, m) in U.VENUES.items())}), x AS (SELECT 'P' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.A' WHEN 2 THEN '-USD' ELSE '.' || {[*U.VENUES, "XX", "ls"]}[p_partkey // 5 % {len(U.VENUES) + 2} + 1] END AS symbol FROM part),
y AS (SELECT symbol, CASE WHEN contains(symbol, '.') THEN regexp_extract(symbol, '[^.]*$') END AS sx FROM x)
SELECT symbol, CASE WHEN list_contains({U.SYMBOL_VENUES}, sx) THEN symbol ELSE replace(symbol, '.', '-') END AS normal, CASE WHEN sx IS NOT NULL THEN coalesce(u.country, upper(sx)) WHEN regexp_matches(symbol, '-(USD|EUR)$') THEN 'Crypto' ELSE 'USA' END AS country,
  CASE WHEN sx IS NULL THEN 'USD' ELSE w.currency END AS currency, CASE WHEN regexp_matches(symbol, '-(USD|EUR)$') THEN 0 WHEN ends_with(symbol, '0') THEN 1 ELSE 2 END::INT AS class FROM y LEFT JOIN v u ON u.suffix = upper(sx) LEFT JOIN v w ON w.suffix = sx""",
    "universe_isins": f"SELECT code, regexp_full_match(code, '[A-Z]{{2}}[0-9A-Za-z]{{9}}[0-9]') AS ok FROM (SELECT DISTINCT {CODE} AS code FROM part)",
    "universe_sector_filter": _SEC + " SELECT sector, count(*) AS n FROM sectors WHERE contains(lower(sector), 'nation_1') OR contains(lower(sector), '_2') GROUP BY 1",
    "universe_prefix_lookup": "WITH n AS (SELECT DISTINCT left(p_name, 12) AS name FROM part), k AS (SELECT p_name AS known, min(p_size) AS value FROM part GROUP BY 1) SELECT name, min(value) AS value FROM n JOIN k ON starts_with(known, name) WHERE length(name) >= 6 GROUP BY 1 HAVING min(value) = max(value)",
    "universe_quality_counters": "WITH e AS (SELECT json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.zz') AS zz, event_type FROM events) SELECT 'k' AS measure, count(*) - count(k) AS missing, count(k) AS present FROM e UNION ALL SELECT 'zz', count(*) - count(zz), count(zz) FROM e UNION ALL SELECT 'event_type', count(*) - count(event_type), count(event_type) FROM e",
    "report_overlaps": _HOLD + " SELECT a.fund AS a, b.fund AS b, count(*) AS shared FROM h a JOIN h b ON a.symbol = b.symbol AND a.fund < b.fund GROUP BY 1, 2 HAVING count(*) >= 5",
    "report_concentration": _HOLD + ", r AS (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight DESC, symbol) AS rn FROM h) SELECT fund, round(sum(weight) FILTER (WHERE rn <= 3), 6) AS top_weight, sum(weight) FILTER (WHERE rn <= 3) >= 150 AS concentrated FROM r GROUP BY 1",
    "report_look_through": _HOLD + """, t AS (SELECT fund, sum(weight) AS a FROM h GROUP BY 1), p AS (SELECT fund AS ticker, max(weight) AS w FROM h GROUP BY 1 UNION ALL SELECT 'P' || p_partkey, p_size FROM part WHERE p_size = 7),
x AS (SELECT coalesce(h.symbol, p.ticker) AS s, p.w * coalesce(h.weight / t.a, 1) AS w FROM p LEFT JOIN h ON p.ticker = h.fund LEFT JOIN t ON t.fund = h.fund), f AS (SELECT coalesce(p_brand, 'other') AS field, sum(w) AS w FROM x LEFT JOIN part ON 'P' || p_partkey = x.s AND p_size > 2 GROUP BY 1) SELECT field, round(100 * w / sum(w) OVER (), 6) AS weight FROM f""",
    "report_allocation_gaps": """WITH a AS (SELECT 'N' || s_nationkey AS ticker, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS w FROM supplier GROUP BY 1), b AS (SELECT 'N' || c_nationkey AS ticker, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS w FROM customer GROUP BY 1),
g AS (SELECT ticker, coalesce(a.w, 0) - coalesce(b.w, 0) AS gap FROM a FULL JOIN b USING (ticker)) SELECT ticker, round(gap, 6) AS gap, CASE WHEN gap >= 1 THEN 'trim' WHEN gap <= -1 THEN 'add' ELSE 'hold' END AS advice FROM g""",
    "report_index_keys": f"""WITH n AS (SELECT DISTINCT array_to_string(list_filter([i, CASE WHEN p_partkey % 3 = 0 THEN i || ' Core' END, p_type, CASE WHEN p_partkey % 4 = 0 THEN 'S&P-500 U.S.' END, 'UCITS ETF USD (Acc)'], lambda x: x IS NOT NULL), ' ') AS name FROM (SELECT *, {[x.upper() for x in [*U.ISSUERS, "Nobody"]]}[p_partkey % {len(U.ISSUERS) + 1} + 1] AS i FROM part)),
f AS (SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[.,()'']', '', 'g'), '[-/+:]', ' ', 'g'), '\\s+', ' ', 'g')) AS flat FROM n),
g AS (SELECT name, {"regexp_replace(" * 3}flat{(", '^(" + "|".join(sorted(U.ISSUERS, key=len, reverse=True)) + ")( |$)', '')") * 3} AS rest FROM f),
k AS (SELECT name, list_sort(list_distinct(list_filter(string_split(rest, ' '), lambda w: w <> '' AND NOT list_contains({U.NOISE}, w)))) AS t FROM g) SELECT name, CASE WHEN len(t) >= 2 THEN array_to_string(t, ' ') END AS key FROM k""",
    "fx_rates": f"""WITH pr AS (SELECT n_nationkey AS k, round(avg(CAST(abs(s_acctbal) AS DECIMAL(18,4)))::DOUBLE / 1000, 6) AS px FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 7 <> 5 AND n_nationkey NOT IN (0, 2) GROUP BY 1)
SELECT {CCY} AS ccy, round(CASE WHEN n_nationkey = 0 THEN 1.0::DOUBLE WHEN k % 2 = 0 THEN px ELSE 1 / px END * CASE WHEN n_nationkey = 2 THEN 0.01 ELSE 1 END, 8) AS rate FROM nation LEFT JOIN pr ON k = CASE WHEN n_nationkey = 2 THEN 1 ELSE n_nationkey END""",
    "relational_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "relational_pivot": "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS \"F\", nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS \"O\", nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS \"P\" FROM orders GROUP BY 1",
    "relational_set_ops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT range FROM range(0, 3)",
    "event_windows": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,6)))::DOUBLE AS total FROM events GROUP BY 1, 2",
}
