"""Parsers of feed documents: JSON charts, statements and rates, constituent tables, registries, trade forms.

Each takes a DataFrame with a text column and gives rows; malformed parts are dropped, as a null or a filter, and corrupt
lines of the journal are counted. All are SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHART = "struct<chart: struct<result: array<struct<timestamp: array<long>, meta: struct<currency: string, longName: string, shortName: string>, indicators: struct<quote: array<struct<close: array<double>, volume: array<long>>>>, events: struct<dividends: map<string, struct<date: long, amount: double>>, splits: map<string, struct<date: long, numerator: double, denominator: double>>>>>>>"


def charts(docs: DataFrame) -> DataFrame:
    """``docs`` (ticker, json) with the parsed first result as ``r``; documents without one are dropped."""
    return docs.select("ticker", F.element_at(F.from_json("json", CHART)["chart"]["result"], 1).alias("r")).filter("r IS NOT NULL")


def chart_bars(docs: DataFrame) -> DataFrame:
    """(ticker, bar_date, close, volume): null closes are dropped, missing volumes are 0."""
    rows = charts(docs).select("ticker", F.col("r.timestamp").alias("ts"), F.col("r.indicators.quote")[0].alias("q"))
    each = rows.select("ticker", F.explode(F.arrays_zip(F.col("ts"), F.col("q.close").alias("close"), F.col("q.volume").alias("volume"))).alias("b"))
    return each.filter("b.close IS NOT NULL").select("ticker", F.to_date(F.timestamp_seconds("b.ts")).alias("bar_date"), F.col("b.close").alias("close"), F.coalesce(F.col("b.volume").cast("double"), F.lit(0.0)).alias("volume"))


def chart_events(docs: DataFrame) -> DataFrame:
    """(ticker, kind, day, value): dividends, and splits as ratios; a zero denominator is skipped."""
    rows = charts(docs)
    paid = rows.select("ticker", F.explode(F.map_values("r.events.dividends")).alias("e")).select("ticker", F.lit("dividend").alias("kind"), F.to_date(F.timestamp_seconds("e.date")).alias("day"), F.col("e.amount").alias("value"))
    cut = rows.select("ticker", F.explode(F.map_values("r.events.splits")).alias("e")).filter("e.denominator <> 0").select("ticker", F.lit("split").alias("kind"), F.to_date(F.timestamp_seconds("e.date")).alias("day"), (F.col("e.numerator") / F.col("e.denominator")).alias("value"))
    return paid.union(cut)


def merge_monthly(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """``daily`` bars after the monthly ones that are older than a ticker's first daily bar."""
    first = daily.groupBy("ticker").agg(F.min("bar_date").alias("first"))
    return monthly.join(first, "ticker").filter("bar_date < first").drop("first").unionByName(daily)


def name_of(long: Column, short: Column, ticker: Column) -> Column:
    real = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(real(long), real(short), ticker)


def statements(docs: DataFrame) -> DataFrame:
    """(ticker, filed, period_end, revenue, gross_margin, operating_margin, net_margin, eps): margins in percent, null
    where revenue is 0; the period ends on the filing day if it isn't told."""
    kind = "array<struct<filingDate: string, date: string, revenue: double, grossProfit: double, operatingIncome: double, netIncome: double, eps: double>>"
    r = docs.select("ticker", F.explode(F.from_json("json", kind)).alias("s"))
    margin = lambda c: F.round(F.col(f"s.{c}") / F.nullif("s.revenue", F.lit(0.0)) * 100, 6)
    filed = F.try_to_date("s.filingDate", "yyyy-MM-dd")
    return r.filter(filed.isNotNull()).select(
        "ticker", filed.alias("filed"), F.coalesce(F.try_to_date("s.date", "yyyy-MM-dd"), filed).alias("period_end"), F.col("s.revenue").alias("revenue"), margin("grossProfit").alias("gross_margin"), margin("operatingIncome").alias("operating_margin"), margin("netIncome").alias("net_margin"), F.col("s.eps").alias("eps"),
    )


def company_facts(docs: DataFrame, tags: list[str]) -> DataFrame:
    """(ticker, period_end, value, filed): yearly facts (350 to 380 days, annual forms) of the first tag that has the
    period; an amendment supersedes, the newest of them; else the first filing of a period stands."""
    kind = "map<string, array<struct<start: string, end: string, val: double, filed: string, form: string>>>"
    rows = docs.select("ticker", F.explode(F.from_json("json", kind)).alias("tag", "facts")).select("ticker", "tag", F.explode("facts").alias("f"))
    d = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    rows = rows.select("ticker", F.array_position(F.array(*map(F.lit, tags)), F.col("tag")).alias("priority"), d("f.start").alias("a"), d("f.end").alias("period_end"), d("f.filed").alias("filed"), F.col("f.val").alias("value"), F.col("f.form").alias("form"))
    rows = rows.filter("priority > 0 AND form IN ('10-K', '10-K/A', '20-F', '20-F/A', '40-F', '40-F/A') AND datediff(period_end, a) BETWEEN 350 AND 380").withColumn("amended", F.endswith("form", F.lit("/A")))
    order = [F.desc("amended"), F.when(F.col("amended"), -F.unix_date("filed")).otherwise(F.unix_date("filed")), F.col("priority")]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("ticker", "period_end").orderBy(*order))).filter("rn = 1").select("ticker", "period_end", "value", "filed")


def ttm_eps(facts: DataFrame, today: str) -> DataFrame:
    """(ticker, eps): the last full year rolled forward, plus this year's part less last year's, each in its newest
    filing; null if the part is over 730 days old or the sum over 100 times the year's. ``facts``: (ticker, start, end, val, filed)."""
    newest = facts.groupBy("ticker", "start", "end").agg(F.max_by("val", "filed").alias("val")).withColumn("days", F.datediff("end", "start"))
    full = newest.filter("days BETWEEN 350 AND 380").groupBy("ticker").agg(F.max(F.struct("end", "val")).alias("y"))
    part = newest.filter("days < 350").join(full, "ticker").filter("start > y.end - interval 10 days").groupBy("ticker", "y").agg(F.max(F.struct("end", "start", "val")).alias("p"))
    both = full.join(part.drop("y"), "ticker", "left")
    prior = newest.select("ticker", F.col("end").alias("e"), F.col("days").alias("d"), F.col("val").alias("v"))
    near = both.join(prior, "ticker", "left").withColumn("gap", F.datediff("p.end", "e"))
    last = near.groupBy("ticker", "y", "p").agg(F.max_by("v", F.when((F.col("gap").between(350, 380)) & (F.abs(F.col("d") - F.datediff("p.end", "p.start")) <= 10), F.col("e"))).alias("v"))
    rolled = F.when(F.col("p").isNull(), F.col("y.val")).otherwise(F.col("y.val") + F.col("p.val") - F.col("v"))
    fresh = F.datediff(F.lit(today).cast("date"), F.coalesce("p.end", "y.end")) <= 730
    return last.select("ticker", F.round(F.when(fresh & (F.abs(rolled) <= 100 * F.abs(F.col("y.val"))), rolled), 6).alias("eps"))


def trade_forms(docs: DataFrame) -> DataFrame:
    """(ticker, tx_date, buy): open-market purchases and sales of an insider form; other codes are dropped."""
    dates = F.regexp_extract_all("xml", F.lit(r"<transactionDate>\s*<value>([^<]*)</value>"), 1)
    codes = F.regexp_extract_all("xml", F.lit(r"<transactionCode>\s*([A-Z])\s*</transactionCode>"), 1)
    rows = docs.select("ticker", F.explode(F.arrays_zip(dates.alias("d"), codes.alias("c"))).alias("t"))
    return rows.filter("t.c IN ('P', 'S')").select("ticker", F.try_to_date("t.d", "yyyy-MM-dd").alias("tx_date"), (F.col("t.c") == "P").alias("buy")).filter("tx_date IS NOT NULL")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]*>", ""))


def html_table(docs: DataFrame, table_id: str, symbol: int = 0, sector: int = 2) -> DataFrame:
    """(symbol, sector): two columns of a table of a page, without its header and rows that lack a symbol."""
    body = F.regexp_extract("html", rf'(?s)id="{table_id}"(.*?)</table>', 1)
    rows = docs.select(F.explode(F.regexp_extract_all(body, F.lit("(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("tr")).select(F.regexp_extract_all("tr", F.lit("(?s)<td[^>]*>(.*?)</td>"), 1).alias("td"))
    cells = rows.filter(F.size("td") > max(symbol, sector)).select(strip_tags(F.get("td", F.lit(symbol))).alias("symbol"), F.coalesce(F.nullif(strip_tags(F.get("td", F.lit(sector))), F.lit("")), F.lit("other")).alias("sector"))
    return cells.filter("symbol <> ''")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, at, href, label): the links of each page, in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), 1), F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), 1)
    return pages.select("page_id", F.posexplode(F.arrays_zip(found[0].alias("href"), found[1].alias("label"))).alias("at", "a")).select("page_id", "at", "a.href", "a.label")


def constituents(lines: DataFrame) -> DataFrame:
    """(symbol, name, sector) of quoted CSV lines; a missing sector is ``other``."""
    row = F.from_csv("line", "symbol STRING, name STRING, sector STRING")
    return lines.select(row.alias("r")).filter("trim(r.symbol) <> ''").select(F.trim("r.symbol").alias("symbol"), F.trim("r.name").alias("name"), F.coalesce(F.nullif(F.trim("r.sector"), F.lit("")), F.lit("other")).alias("sector"))


def member_spans(lines: DataFrame) -> DataFrame:
    """(ticker, start_date, end_date) of CSV lines: bad dates and blank tickers are skipped, an empty end is open."""
    p = F.split("line", ",", -1)
    start, end = F.try_to_date(F.get(p, F.lit(1)), "yyyy-MM-dd"), F.trim(F.coalesce(F.get(p, F.lit(2)), F.lit("")))
    rows = lines.select(F.replace(F.trim(F.get(p, F.lit(0))), F.lit("."), F.lit("-")).alias("ticker"), start.alias("start_date"), F.try_to_date(F.nullif(end, F.lit("")), "yyyy-MM-dd").alias("end_date"), end.alias("told"))
    return rows.filter("ticker <> '' AND start_date IS NOT NULL AND (told = '' OR end_date IS NOT NULL)").drop("told")


def registry_isins(docs: DataFrame) -> DataFrame:
    """(isin): collective funds of a registry's XML, each once."""
    block = F.regexp_extract_all("xml", F.lit(r"(?s)<FinInstrmGnlAttrbts>(.*?)</FinInstrmGnlAttrbts>"), 1)
    rows = docs.select(F.explode(block).alias("b")).select(F.regexp_extract("b", r"<Id>\s*([A-Z0-9]{12})\s*</Id>", 1).alias("isin"), F.regexp_extract("b", r"<ClssfctnTp>\s*(\w+)\s*</ClssfctnTp>", 1).alias("kind"))
    return rows.filter("isin <> '' AND startswith(kind, 'CE')").select("isin").distinct()


def composition(docs: DataFrame) -> DataFrame:
    """(fund, symbol, weight, pe): up to ten holdings of a fund; a blank symbol is the name in capitals, a missing weight 0,
    and the price-earnings ratio is one over what is told."""
    kind = "struct<holdings: array<struct<symbol: string, holdingName: string, holdingPercent: double>>, priceToEarnings: double>"
    rows = docs.select("fund", F.from_json("json", kind).alias("j")).select("fund", F.explode(F.slice("j.holdings", 1, 10)).alias("h"), F.when(F.col("j.priceToEarnings") > 0, 1 / F.col("j.priceToEarnings")).alias("pe"))
    return rows.select("fund", F.coalesce(F.nullif(F.trim("h.symbol"), F.lit("")), F.upper("h.holdingName")).alias("symbol"), F.round(100 * F.coalesce("h.holdingPercent", F.lit(0.0)), 6).alias("weight"), F.round("pe", 6).alias("pe"))


def price_index_rates(docs: DataFrame) -> DataFrame:
    """(year, rate) of a monthly price index (json): change on the same month a year before, the latest month of a year
    wins; month 13, an average, is skipped."""
    kind = "array<struct<year: string, period: string, value: string>>"
    rows = docs.select(F.explode(F.from_json("json", kind)).alias("p")).select(F.col("p.year").cast("int").alias("year"), F.substring("p.period", 2, 2).cast("int").alias("month"), F.expr("try_cast(p.value AS double)").alias("level")).filter("month <= 12 AND level > 0")
    one = rows.groupBy("year", "month").agg(F.max("level").alias("level"))
    was = one.select((F.col("year") + 1).alias("year"), "month", F.col("level").alias("was"))
    return one.join(was, ["year", "month"]).groupBy("year").agg(F.round(100 * (F.max_by(F.col("level") / F.col("was"), "month") - 1), 6).alias("rate"))


def titles(docs: DataFrame, most: int = 3) -> DataFrame:
    """(ticker, title): the first titles, flat or nested."""
    rows = docs.select("ticker", F.posexplode(F.from_json("json", "array<struct<title: string, content: struct<title: string>>>")).alias("at", "n"))
    told = rows.select("ticker", "at", F.coalesce("n.title", "n.content.title").alias("title")).filter("title IS NOT NULL")
    return told.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy("at"))).filter(F.col("rn") <= most).select("ticker", "title")


def journal_lines(lines: DataFrame) -> DataFrame:
    """(day, rank, ticker, px) of JSON lines; ``corrupt_lines`` counts those that aren't read here."""
    row = F.from_json("line", "struct<date: string, rows: array<array<string>>>")
    rows = lines.select(row.alias("j")).filter("j.date IS NOT NULL").select(F.try_to_date("j.date", "yyyy-MM-dd").alias("day"), F.posexplode("j.rows").alias("at", "r"))
    return rows.select("day", (F.col("at") + 1).alias("rank"), F.get("r", F.lit(0)).alias("ticker"), F.expr("try_cast(get(r, 1) AS double)").alias("px"))


def corrupt_lines(lines: DataFrame) -> DataFrame:
    row = F.from_json("line", "struct<date: string>")
    return lines.agg(F.count_if(row["date"].isNull() & (F.trim("line") != "")).alias("n_corrupt"))
