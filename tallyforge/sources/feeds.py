"""Parsers of nested feed documents: company facts, instance documents, fund profiles, venue lists, registries, rates.

Each takes a DataFrame with a text column and gives rows; what is missing or malformed is null or left out. All are SQL
functions but ``zip_members``, which unpacks archives in tasks.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.universe import is_isin
from tallyforge.sources.parsers import CHART

#: Domicile prefixes outside the Union's funds (fixed values).
NON_EU = ["US", "CA", "HK", "JP", "SG", "KY", "AU", "IL", "ZA", "TW", "KR", "IN", "TH", "MY", "CN", "BM", "VG"]
#: Concept names of the two taxonomies, in order of priority (fixed values of the public taxonomies).
US_GAAP = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueServicesNet", "SalesRevenueGoodsNet"],
    "gross": ["GrossProfit"],
    "operating": ["OperatingIncomeLoss"],
    "depreciation": ["DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "DepreciationAmortizationAndAccretionNet"],
    "net": ["NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "ProfitLoss"],
    "eps": ["EarningsPerShareDiluted", "IncomeLossFromContinuingOperationsPerDilutedShare", "EarningsPerShareBasic"],
    "shares": ["WeightedAverageNumberOfDilutedSharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "assets": ["Assets"],
    "cash_flow": ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"],
    "interest": ["InterestExpense", "InterestExpenseDebt", "InterestAndDebtExpense"],
    "debt_long": ["LongTermDebtNoncurrent", "LongTermDebt"],
    "debt_short": ["LongTermDebtCurrent", "DebtCurrent"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"],
}
IFRS = {
    "revenue": ["Revenue", "RevenueFromSaleOfGoods"],
    "gross": ["GrossProfit"],
    "operating": ["ProfitLossFromOperatingActivities"],
    "depreciation": ["DepreciationAndAmortisationExpense"],
    "net": ["ProfitLoss", "ProfitLossAttributableToOwnersOfParent"],
    "eps": ["DilutedEarningsLossPerShare", "BasicEarningsLossPerShare"],
    "shares": ["AdjustedWeightedAverageShares", "WeightedAverageShares"],
    "equity": ["Equity", "EquityAttributableToOwnersOfParent"],
    "assets": ["Assets"],
    "cash_flow": ["CashFlowsFromUsedInOperatingActivities"],
    "capex": ["PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities"],
    "interest": ["InterestExpense"],
    "debt_long": ["LongtermBorrowings", "Borrowings"],
    "debt_short": ["CurrentPortionOfLongtermBorrowings", "ShorttermBorrowings"],
    "cash": ["CashAndCashEquivalents"],
}
INSTANT = ("equity", "assets", "debt_long", "debt_short", "cash")  #: concepts of a day, not of a period
ANNUAL_FORMS = ["10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"]
FEE_KEYS = ["ter", "totalExpenseRatio", "ongoingCharges", "ongoingCharge", "totalExpenseRatioInPercent"]  #: (fixed values)
REPLICATION = {"Swap-based": "Swap", "Full replication": "Full", "Optimised": "Opt", "Hybrid": "Hybr", "Sample": "Samp"}  #: (fixed values)


def day(c: Column | str) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def number(c: Column) -> Column:
    return F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")


def chosen(value: Column, table: dict[str, str]) -> Column:
    """The table's entry for ``value``, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def intraday_bars(docs: DataFrame) -> DataFrame:
    """(ticker, ts, close, volume) of charts (ticker, json) with times of day: null closes are dropped."""
    rows = docs.select("ticker", F.element_at(F.from_json("json", CHART)["chart"]["result"], 1).alias("r")).filter("r IS NOT NULL")
    each = rows.select("ticker", F.explode(F.arrays_zip(F.col("r.timestamp").alias("ts"), F.col("r.indicators.quote")[0]["close"].alias("close"), F.col("r.indicators.quote")[0]["volume"].alias("volume"))).alias("b"))
    return each.filter("b.close IS NOT NULL").select("ticker", F.timestamp_seconds("b.ts").cast("timestamp_ntz").alias("ts"), "b.close", F.coalesce(F.col("b.volume").cast("double"), F.lit(0.0)).alias("volume"))


def last_close(docs: DataFrame) -> DataFrame:
    """(ticker, close): the last close of each chart that isn't null."""
    return intraday_bars(docs).groupBy("ticker").agg(F.max_by("close", "ts").alias("close"))


def symbols_of_list(docs: DataFrame, at: int, suffix: str) -> DataFrame:
    """(symbol) of the rows of a venue's ``aaData``: letters and digits only, with the venue's suffix."""
    rows = docs.select(F.explode(F.from_json("json", "aaData array<array<string>>")["aaData"]).alias("r")).select(F.trim(F.get("r", F.lit(at))).alias("s"))
    return rows.filter(F.col("s").rlike("^[A-Za-z0-9]+$")).select(F.concat("s", F.lit(suffix)).alias("symbol"))


def isins_of_list(docs: DataFrame, field: str, at: int, name_at: int | None = None) -> DataFrame:
    """(isin) of the rows of a venue's list ``field``; where a name's place is given, of exchange-traded funds alone."""
    rows = docs.select(F.explode(F.from_json("json", f"{field} array<array<string>>")[field]).alias("r"))
    isin = F.trim(F.get("r", F.lit(at)))
    fund = F.lit(True) if name_at is None else F.coalesce(F.lower(F.get("r", F.lit(name_at))).rlike("etf|ucits"), F.lit(False))
    return rows.filter(is_isin(isin) & fund).select(isin.alias("isin"))


def registry_isins(docs: DataFrame) -> DataFrame:
    """(isin): exchange-traded collective funds of a registry's XML with a fund's name and a domicile that isn't excluded."""
    pattern = r"<FinInstrmGnlAttrbts>\s*<Id>([A-Z]{2}[0-9A-Z]{9}[0-9])</Id>\s*<FullNm>([^<]*)</FullNm>\s*(?:<ShrtNm>[^<]*</ShrtNm>\s*)?<ClssfctnTp>CE"
    found = lambda k: F.regexp_extract_all("xml", F.lit(pattern), k)
    rows = docs.select(F.explode(F.arrays_zip(found(1).alias("isin"), found(2).alias("name"))).alias("f"))
    return rows.filter(F.lower("f.name").rlike("etf|ucits") & ~F.left("f.isin", F.lit(2)).isin(*NON_EU)).select("f.isin").distinct()


def newest_link(docs: DataFrame, begins: str = "FULINS_C_") -> DataFrame:
    """(link): of the files that an index lists, in either of its forms, the one whose name is last among those that begin so."""
    kind = "struct<response: struct<docs: array<struct<file_name: string, download_link: string>>>, hits: struct<hits: array<struct<_source: struct<file_name: string, download_link: string>>>>>"
    j = F.from_json("json", kind)
    rows = docs.select(F.explode(F.coalesce(j["response"]["docs"], F.transform(j["hits"]["hits"], lambda h: h["_source"]))).alias("d"))
    return rows.filter(F.startswith("d.file_name", F.lit(begins)) & F.col("d.download_link").isNotNull()).agg(F.max_by("d.download_link", F.struct("d.file_name", "d.download_link")).alias("link"))


def zip_members(files: DataFrame, suffix: str = ".xml") -> DataFrame:
    """(path, member, text) of the members of archives (path, content) whose name ends so; a bad archive gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                    for name in archive.namelist():
                        if name.endswith(suffix):
                            text = archive.read(name).decode("utf-8", "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([name], pa.string()), pa.array([text], pa.string())], names=["path", "member", "text"])
                except zipfile.BadZipFile:
                    continue

    return files.select("path", "content").mapInArrow(run, "path string, member string, text string")


def merged_codes(fresh: DataFrame, last_good: DataFrame) -> DataFrame:
    """(isin): what was fetched now and what is kept from the last good fetch, each once."""
    return fresh.select("isin").union(last_good.select("isin")).distinct()


def facts(docs: DataFrame) -> DataFrame:
    """(ticker, concept, unit, tag_at, start, end, val, filed, amended) of company facts (ticker, json): the taxonomy is
    us-gaap where the filer has it, else ifrs-full; money is in dollars if any of revenue, net income and equity is, else in
    the first of their currencies; annual forms only, and periods of 350 to 380 days."""
    fact = "array<struct<start: string, end: string, val: double, filed: string, form: string>>"
    j = docs.select("ticker", F.from_json("json", f"struct<facts: map<string, map<string, struct<units: map<string, {fact}>>>>>")["facts"].alias("f"))
    gaap = F.try_element_at("f", F.lit("us-gaap")).isNotNull()
    rows = j.select("ticker", gaap.alias("gaap"), F.explode(F.coalesce(F.try_element_at("f", F.lit("us-gaap")), F.try_element_at("f", F.lit("ifrs-full")))).alias("tag", "t"))
    rows = rows.select("ticker", "gaap", "tag", F.explode("t.units").alias("unit", "x"))
    names = [(told, concept, at, tag) for told, table in ((True, US_GAAP), (False, IFRS)) for concept, tags in table.items() for at, tag in enumerate(tags)]
    dim = F.broadcast(docs.sparkSession.createDataFrame(names, "gaap boolean, concept string, tag_at int, tag string"))
    rows = rows.join(dim, ["gaap", "tag"])
    plain = (F.col("unit") != "shares") & ~F.contains("unit", F.lit("/"))
    w = Window.partitionBy("ticker")
    bears = plain & F.col("concept").isin("revenue", "net", "equity")
    rows = rows.withColumn("money", F.coalesce(F.max(F.when(bears & (F.col("unit") == "USD"), "USD")).over(w), F.min(F.when(bears, F.col("unit"))).over(w)))
    wanted = F.when(F.col("concept") == "shares", "shares").when(F.col("concept") == "eps", F.concat("money", F.lit("/shares"))).otherwise(F.col("money"))
    each = rows.filter(F.col("unit") == wanted).select("ticker", "concept", F.col("money").alias("unit"), "tag_at", F.explode("x").alias("x"))
    each = each.select("ticker", "concept", "unit", "tag_at", day("x.start").alias("start"), day("x.end").alias("end"), F.col("x.val").alias("val"), day("x.filed").alias("filed"), F.col("x.form").alias("form"))
    whole = F.col("concept").isin(*INSTANT) | F.datediff("end", "start").between(350, 380)
    return each.filter(F.col("form").isin(*ANNUAL_FORMS) & F.col("end").isNotNull() & F.col("val").isNotNull() & F.col("filed").isNotNull() & whole).withColumn("amended", F.endswith("form", F.lit("/A"))).drop("form")


def filed_years(docs: DataFrame) -> DataFrame:
    """(ticker, filed, period_end, revenue, margins, eps, shares, prior_eps, prior_shares, roe, roa, assets, fcf_margin,
    interest_cover, net_cash_rev, ebitda, net_debt, currency): a row for each period with a revenue. Of a concept's facts for a
    period an amendment stands, the newest of them, else the first filing; ties go to the tag of higher priority. Prior values
    are those of the period before in the same filing under the same tag."""
    rows = facts(docs)
    order = [F.desc("amended"), F.when(F.col("amended"), -F.unix_date("filed")).otherwise(F.unix_date("filed")), "tag_at"]
    same = Window.partitionBy("ticker", "concept", "tag_at", "filed").orderBy("end")
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy("ticker", "concept", "tag_at", "filed", "end").orderBy("start")))
    rows = once.withColumn("prior", F.when(F.col("nth") == 1, F.lag("val").over(same.orderBy("end", "nth"))))
    kept = rows.withColumn("rn", F.row_number().over(Window.partitionBy("ticker", "concept", "end").orderBy(*order, "nth"))).filter("rn = 1")
    at = lambda c, field="val": F.max(F.when(F.col("concept") == c, F.col(field))).alias(f"{c}_{field}")
    wide = kept.groupBy("ticker", "end", "unit").agg(*[at(c) for c in US_GAAP], at("revenue", "filed"), at("eps", "prior"), at("shares", "prior")).filter("revenue_val IS NOT NULL")
    v = lambda c: F.col(f"{c}_val")
    over = lambda a, b: a / F.nullif(b, F.lit(0.0)) * 100
    debt = F.coalesce(v("debt_long"), F.lit(0.0)) + F.coalesce(v("debt_short"), F.lit(0.0))
    return wide.select(
        "ticker", F.col("revenue_filed").alias("filed"), F.col("end").alias("period_end"), v("revenue").alias("revenue"), over(v("gross"), v("revenue")).alias("gross_margin"), over(v("operating"), v("revenue")).alias("op_margin"), over(v("net"), v("revenue")).alias("net_margin"),
        v("eps").alias("eps"), v("shares").alias("shares"), F.col("eps_prior").alias("prior_eps"), F.col("shares_prior").alias("prior_shares"), over(v("net"), v("equity")).alias("roe"), F.when(v("assets") > 0, v("net") / v("assets") * 100).alias("roa"), F.when(v("assets") > 0, v("assets")).alias("assets"),
        over(v("cash_flow") - v("capex"), v("revenue")).alias("fcf_margin"), F.when(v("interest") > 0, v("operating") / v("interest")).alias("interest_cover"), over(v("cash") - debt, v("revenue")).alias("net_cash_rev"), (v("operating") + v("depreciation")).alias("ebitda"), (debt - v("cash")).alias("net_debt"), F.col("unit").alias("currency"),
    )


def instance_eps(docs: DataFrame) -> DataFrame:
    """(ticker, period_end, eps, shares) of instance documents (ticker, xml) that tell earnings a share by share class: the class
    whose shares times earnings are within a tenth of net income, the one of most shares; else the nearest to it."""
    context = r'(?s)<(?:[\w-]+:)?context id="([^"]+)"[^>]*>(.*?)</(?:[\w-]+:)?context>'
    rows = docs.select("ticker", "xml", F.explode(F.arrays_zip(F.regexp_extract_all("xml", F.lit(context), 1).alias("id"), F.regexp_extract_all("xml", F.lit(context), 2).alias("body"))).alias("c"))
    start, end = (day(F.regexp_extract("c.body", rf"<(?:[\w-]+:)?{t}>\s*([0-9-]+)", 1)) for t in ("startDate", "endDate"))
    members = F.array_join(F.array_sort(F.regexp_extract_all("c.body", F.lit(r"<(?:[\w-]+:)?explicitMember[^>]*>\s*([^<]*?)\s*</"), 1)), "|")
    contexts = rows.select("ticker", F.col("c.id").alias("id"), start.alias("start"), end.alias("period_end"), members.alias("class")).filter(F.datediff("period_end", "start").between(350, 380))

    def told(tags: list[str], name: str) -> DataFrame:
        parts = []
        for at, tag in enumerate(tags):
            pattern = rf'<(?:[\w-]+:)?{tag}\s[^>]*contextRef="([^"]+)"[^>]*>([^<]*)</'
            found = F.arrays_zip(F.regexp_extract_all("xml", F.lit(pattern), 1).alias("id"), F.regexp_extract_all("xml", F.lit(pattern), 2).alias("v"))
            parts.append(docs.select("ticker", F.posexplode(found).alias("nth", "f")).select("ticker", F.lit(at).alias("at"), "nth", F.col("f.id").alias("id"), number(F.trim("f.v")).alias("v")).filter("v IS NOT NULL"))
        return reduce(DataFrame.union, parts).join(contexts, ["ticker", "id"]).groupBy("ticker", "period_end", "class").agg(F.min_by("v", F.struct("at", "nth")).alias(name))

    both = told(US_GAAP["eps"], "eps").join(told(US_GAAP["shares"], "shares"), ["ticker", "period_end", "class"], "left")
    net = told(US_GAAP["net"], "net").filter("class = ''").drop("class")
    gap = F.abs(F.col("shares") * F.col("eps") - F.col("net"))
    fits = F.coalesce(gap <= F.abs("net") * 0.1, F.lit(False))
    far = F.when(F.col("shares").isNull(), F.lit(float("inf"))).otherwise(F.when(F.col("net").isNull(), -F.col("shares")).otherwise(gap))
    order = [F.desc(fits), F.when(fits, -F.col("shares")).otherwise(far), "class"]
    ranked = both.join(net, ["ticker", "period_end"], "left").withColumn("rn", F.row_number().over(Window.partitionBy("ticker", "period_end").orderBy(*order)))
    return ranked.filter("rn = 1").select("ticker", "period_end", "eps", "shares")


def filer_ids(docs: DataFrame, swaps: DataFrame) -> DataFrame:
    """(ticker, cik): of the filers' list (json), and of swapped listings (home, ticker) under the home listing's number."""
    rows = docs.select(F.explode(F.map_values(F.from_json("json", "map<string, struct<cik_str: long, ticker: string>>"))).alias("r")).select("r.ticker", F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"))
    return rows.union(swaps.join(rows.withColumnRenamed("ticker", "home"), "home").select("ticker", "cik"))


def newest_ratios(docs: DataFrame, today: str, most_days: int = 10) -> DataFrame:
    """(asset, ratio) of a series' rows (json): the last row of each asset that isn't older than ``most_days`` and is positive."""
    kind = "struct<data: array<struct<asset: string, CapMVRVCur: string, time: string>>>"
    rows = docs.select(F.posexplode(F.from_json("json", kind)["data"]).alias("at", "r")).select("at", "r.asset", number(F.col("r.CapMVRVCur")).alias("v"), day(F.left("r.time", F.lit(10))).alias("d"))
    return rows.filter((F.col("d") >= F.date_sub(F.lit(today).cast("date"), most_days)) & (F.col("v") > 0) & F.col("asset").isNotNull()).groupBy("asset").agg(F.max_by("v", "at").alias("ratio"))


def fund_rows(docs: DataFrame) -> DataFrame:
    """(isin, ter, aum, share_class, replication, benchmark) of a venue's fund rows (isin, json): fees under any of several
    names, flat or one level down, as a number or with a percent sign, in percent if under five; other fields by their
    English word or the original one."""
    flat = F.transform_keys(F.from_json("json", "map<string, string>"), lambda k, v: F.lower(k))
    inner = F.map_values(F.map_filter(flat, lambda k, v: F.startswith(v, F.lit("{"))))
    num = lambda s: number(F.replace(F.trim(F.regexp_replace(F.trim(s), "%$", "")), F.lit(","), F.lit(".")))
    hit = lambda m: F.coalesce(*[num(F.try_element_at(m, F.lit(k.lower()))) for k in FEE_KEYS])
    nested = F.get(F.filter(F.transform(inner, lambda x: hit(F.transform_keys(F.from_json(x, "map<string, string>"), lambda k, v: F.lower(k)))), lambda x: x.isNotNull()), F.lit(0))
    ter = 100 * F.coalesce(hit(flat), F.when(F.size(inner) > 0, nested))
    said = lambda k: F.coalesce(F.get_json_object("json", f"$.keyData.{k}.translations.en"), F.get_json_object("json", f"$.keyData.{k}.originalValue"))
    aum = number(F.get_json_object("json", "$.overview.assetsUnderManagement"))
    return docs.select(
        "isin", F.round(F.when((ter > 0) & (ter < 5), ter), 6).alias("ter"), F.when(aum > 0, aum).alias("aum"), chosen(said("useOfProfits"), {"Accumulating": "Acc", "Distributing": "Dist"}).alias("share_class"),
        chosen(said("replicationMethod"), REPLICATION).alias("replication"), F.nullif(F.lower(F.trim(said("benchmark"))), F.lit("")).alias("benchmark"),
    )


def class_from_name(name: Column) -> Column:
    """Whether a fund's name says that it accumulates or distributes."""
    words = F.split(F.lower(name), r"[^\p{L}\p{N}]+")
    has = lambda *w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    return F.when(has("acc", "accumulating"), "Acc").when(has("dist", "distributing"), "Dist")


def fund_profile(docs: DataFrame) -> DataFrame:
    """(isin, ter, aum) of fund profile pages (isin, html): the fee in percent, and the size in millions (m) or billions (b)."""
    lead = lambda s: F.regexp_extract(F.trim(s), r"^([0-9.,]+)", 1)
    positive = lambda s: F.when(number(F.replace(lead(s), F.lit(","), F.lit(""))) > 0, number(F.replace(lead(s), F.lit(","), F.lit(""))))
    row = F.regexp_extract("html", r"(?s)etf-basics_row_fund-size(.*?)</tr>", 1)
    cell = F.trim(F.regexp_extract(row, r"(?s)<div>([^<]*)<", 1))
    amount = F.regexp_extract(cell, r"^\S+ (.*)$", 1)
    unit = F.left(F.trim(F.regexp_replace(amount, "^[0-9.,]+", "")), F.lit(1))
    return docs.select("isin", positive(F.regexp_extract("html", r'(?s)tl_etf-basics_value_ter">([^<]*)<', 1)).alias("ter"), (positive(amount) * F.when(unit == "b", 1e9).when(unit == "m", 1e6)).alias("aum"))


SUMMARY = "$.quoteSummary.result[0]"


def raw(path: str) -> Column:
    """A number of a quote summary, plain or under ``raw``."""
    return F.coalesce(number(F.get_json_object("json", f"{SUMMARY}.{path}")), number(F.get_json_object("json", f"{SUMMARY}.{path}.raw")))


def fund_facts(docs: DataFrame) -> DataFrame:
    """(fund, ter, aum, stock, bond, pe, category) of quote summaries (fund, json); the ratio is told turned over."""
    ter, aum = raw("fundProfile.feesExpensesInvestment.annualReportExpenseRatio"), F.coalesce(raw("summaryDetail.totalAssets"), raw("defaultKeyStatistics.totalAssets"))
    stock, pe = raw("topHoldings.stockPosition"), raw("topHoldings.equityHoldings.priceToEarnings")
    category = F.coalesce(F.get_json_object("json", f"{SUMMARY}.fundProfile.categoryName"), F.get_json_object("json", f"{SUMMARY}.fundProfile.category"))
    return docs.select(
        "fund", F.round(F.when(ter > 0, ter * 100), 6).alias("ter"), F.when(aum > 0, aum).alias("aum"), stock.alias("stock"), F.when(stock.isNotNull(), F.coalesce(raw("topHoldings.bondPosition"), F.lit(0.0))).alias("bond"),
        F.round(F.when(pe > 0, 1 / pe), 6).alias("pe"), F.nullif(F.trim(category), F.lit("")).alias("category"),
    )


def composition(docs: DataFrame) -> DataFrame:
    """(fund, at, symbol, weight): the first ten holdings of quote summaries (fund, json), in order; an empty symbol is
    the name, both in capitals, and a missing weight is 0."""
    kind = "array<struct<symbol: string, holdingName: string, holdingPercent: struct<raw: double>>>"
    rows = docs.select("fund", F.posexplode(F.slice(F.from_json(F.get_json_object("json", f"{SUMMARY}.topHoldings.holdings"), kind), 1, 10)).alias("at", "h"))
    return rows.select("fund", "at", F.upper(F.coalesce(F.nullif("h.symbol", F.lit("")), "h.holdingName")).alias("symbol"), F.coalesce("h.holdingPercent.raw", F.lit(0.0)).alias("weight")).filter("symbol IS NOT NULL")


def pretty_sector(key: Column) -> Column:
    """A sector's key in words: each with a capital, underscores as spaces."""
    words = F.transform(F.split(key, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))
    return F.when(key == "realestate", "Real Estate").otherwise(F.array_join(words, " "))


def fund_sectors(docs: DataFrame) -> DataFrame:
    """(fund, sector, weight) of quote summaries (fund, json), those above 0."""
    rows = docs.select("fund", F.explode(F.from_json(F.get_json_object("json", f"{SUMMARY}.topHoldings.sectorWeightings"), "array<map<string, string>>")).alias("m")).select("fund", F.explode("m").alias("k", "v"))
    return rows.select("fund", pretty_sector(F.col("k")).alias("sector"), F.coalesce(number(F.col("v")), number(F.get_json_object("v", "$.raw"))).alias("weight")).filter("weight > 0")


def cube_rates(docs: DataFrame) -> DataFrame:
    """(series, year, rate) of a statistical cube (series, json) whose values are keyed by the place of their month: the last
    month of a year that has a value wins."""
    kind = "struct<dimension: struct<time: struct<category: struct<index: map<string, int>>>>, value: map<string, double>>"
    rows = docs.select("series", F.from_json("json", kind).alias("j")).select("series", "j.value", F.explode("j.dimension.time.category.index").alias("month", "at"))
    told = rows.select("series", F.left("month", F.lit(4)).try_cast("int").alias("year"), "at", F.try_element_at("value", F.col("at").cast("string")).alias("rate")).filter("year IS NOT NULL AND rate IS NOT NULL")
    return told.groupBy("series", "year").agg(F.max_by("rate", "at").alias("rate"))


def dated_rates(docs: DataFrame) -> DataFrame:
    """(series, year, rate) of a national series (series, json): dates in a list or by place, values in a list; the last
    date of a year that has a value wins."""
    index = F.get_json_object("json", "$.dimension.reference_date.category.index")
    by_place = F.transform(F.array_sort(F.transform(F.map_entries(F.from_json(index, "map<string, int>")), lambda e: F.struct(e["value"].alias("at"), e["key"].alias("d")))), lambda e: e["d"])
    dates = F.when(F.startswith(index, F.lit("[")), F.from_json(index, "array<string>")).otherwise(by_place)
    rows = docs.select("series", F.posexplode(F.arrays_zip(dates.alias("d"), F.from_json(F.get_json_object("json", "$.value"), "array<double>").alias("v"))).alias("at", "p"))
    told = rows.select("series", F.left("p.d", F.lit(4)).try_cast("int").alias("year"), "at", F.col("p.v").alias("rate")).filter("year IS NOT NULL AND rate IS NOT NULL")
    return told.groupBy("series", "year").agg(F.max_by("rate", "at").alias("rate"))


def reference_rate(docs: DataFrame) -> DataFrame:
    """(page_id, rate): the first percentage with decimals of a page (page_id, html), null if it has none."""
    return docs.select("page_id", number(F.nullif(F.regexp_extract("html", r"(-?\d+\.\d+)\s*%", 1), F.lit(""))).alias("rate"))


def euro_rates(charts: DataFrame) -> DataFrame:
    """(ccy, bar_date, rate) to the euro of bars (base, quote, bar_date, close): the direct pair's, or where a currency has
    none, one over the inverted pair's; closes that aren't positive are left out."""
    rows = charts.filter("close > 0")
    direct = rows.filter("quote = 'EUR'").select(F.col("base").alias("ccy"), "bar_date", F.col("close").alias("rate"))
    inverse = rows.filter("base = 'EUR'").select(F.col("quote").alias("ccy"), "bar_date", (1 / F.col("close")).alias("rate"))
    return direct.unionByName(inverse.join(direct.select("ccy").distinct(), "ccy", "left_anti"))


def cross_rates(rates: DataFrame, asked: DataFrame) -> DataFrame:
    """(from, to, bar_date, factor) for each asked pair: the rate itself to the euro, one over it from the euro, else the
    quotient on common dates; none from a currency to itself."""
    a = asked.filter("`from` <> `to`")
    r = lambda c: rates.select(F.col("ccy").alias(c), "bar_date", F.col("rate").alias(f"r_{c}"))
    to_euro = a.filter("`to` = 'EUR'").join(r("from"), "from").select("from", "to", "bar_date", F.col("r_from").alias("factor"))
    from_euro = a.filter("`from` = 'EUR'").join(r("to"), "to").select("from", "to", "bar_date", (1 / F.col("r_to")).alias("factor"))
    both = a.filter("`from` <> 'EUR' AND `to` <> 'EUR'").join(r("from"), "from").join(r("to"), ["to", "bar_date"]).select("from", "to", "bar_date", (F.col("r_from") / F.col("r_to")).alias("factor"))
    return to_euro.unionByName(from_euro).unionByName(both)


def lazy_charts(docs: DataFrame) -> DataFrame:
    """(ticker, chart): the first result of each chart document (ticker, json) as a VARIANT. Nothing of it is read before a field is asked for,
    and a table of these stays as it is when the feed adds fields; documents that don't parse are dropped."""
    return docs.select("ticker", F.try_variant_get(F.try_parse_json("json"), "$.chart.result[0]", "variant").alias("chart")).filter("chart IS NOT NULL")


def chart_field(charts: DataFrame, path: str, kind: str) -> DataFrame:
    """(ticker, value): one field of each chart as ``kind``; null where it is missing or of another kind."""
    return charts.select("ticker", F.try_variant_get("chart", path, kind).alias("value"))
