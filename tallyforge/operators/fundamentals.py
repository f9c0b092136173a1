"""Fundamentals: what was filed by a date, growth chains, yearly rollups and valuation.

Filings are bitemporal: they hold for a period and are known from the day they are filed; as-of lookups go by the latter.
The as-of join is a union of both sides with the last filing carried forward, so it is one shuffle by ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(asked: DataFrame, filings: DataFrame, back_days: int = 0) -> DataFrame:
    """``asked`` (ticker, cutoff, ...) with ``f``: the filing that was newest by filing day, then period end, at
    ``cutoff`` less ``back_days``. No filing that was made later is seen."""
    keys = asked.select("ticker", "cutoff").distinct()
    row = F.struct(*[F.col(c) for c in filings.columns if c != "ticker"])
    events = filings.select("ticker", F.col("filed").alias("day"), F.lit(0).alias("side"), "period_end", row.alias("f"), F.lit(None).cast("date").alias("cutoff"))
    questions = keys.select("ticker", F.date_sub("cutoff", back_days).alias("day"), F.lit(1).alias("side"), F.lit(None).cast("date").alias("period_end"), F.lit(None).cast(events.schema["f"].dataType).alias("f"), "cutoff")
    w = Window.partitionBy("ticker").orderBy("day", "side", "period_end").rowsBetween(Window.unboundedPreceding, 0)
    found = events.unionByName(questions).withColumn("f", F.last("f", ignorenulls=True).over(w)).filter("side = 1").select("ticker", "cutoff", "f")
    return asked.join(found, ["ticker", "cutoff"], "left")


def yoy(now: Column, then: Column) -> Column:
    return F.when(then != 0, (now / then - 1) * 100)


def cagr(ratio: Column, years: int) -> Column:
    """Yearly percent of growth by ``ratio`` over ``years``."""
    return (F.pow(F.greatest(ratio, F.lit(1e-9)), 1.0 / years) - 1) * 100


def split_safe_yoy(now: Column, then: Column, shares: Column, was: Column) -> Column:
    """Growth in a value by the share, null where the shares moved by over 40 percent, which is a split."""
    split = F.coalesce((was > 0) & (F.abs(shares / F.nullif(was, F.lit(0.0)) - 1) * 100 > 40), F.lit(False))
    return F.when((then != 0) & ~split, (now / F.nullif(then, F.lit(0.0)) - 1) * 100)


def share_cut(shares: Column, prior: Column, was: Column) -> Column:
    """Percent by which the shares fell: on the year before as the same filing tells it, else on an older filing's, if by 40 at most."""
    step = F.when(was > 0, (shares / F.nullif(was, F.lit(0.0)) - 1) * 100)
    return F.when(prior.isNotNull(), -yoy(shares, F.nullif(prior, F.lit(0.0)))).otherwise(F.when(F.abs(step) <= 40, -step))


def return_on_capital(revenue: Column, op_margin: Column, net_margin: Column, roe: Column, roa: Column, net_debt: Column) -> Column:
    """Operating income over invested capital (equity by the return on it, and net debt); where that isn't known or above 0, over
    assets by the return on these, if above 0."""
    ebit, net = op_margin / 100 * revenue, net_margin / 100 * revenue
    capital = net / (F.nullif(roe, F.lit(0.0)) / 100) + net_debt
    assets = net / (F.nullif(roa, F.lit(0.0)) / 100)
    return ebit / F.when(capital > 0, capital).otherwise(F.when(assets > 0, assets)) * 100


def factors(asked: DataFrame, filings: DataFrame, years: int = 2) -> DataFrame:
    """Factors at each cutoff from three as-of lookups (now, ``years`` and one year before) and from the filings known then:
    growth in revenue, assets (turned round) and earnings by the share, trend and stability of margins, buyback, returns, the gap
    between earnings and free cash flow, and levels as filed. Growth in earnings chains each filing's own prior value over
    ``years`` filings; without these it compares the ends, if no step over 40 percent in shares lies between."""
    cut = as_of(as_of(as_of(asked.select("ticker", "cutoff"), filings).withColumnRenamed("f", "now"), filings, years * 365).withColumnRenamed("f", "then"), filings, 365).withColumnRenamed("f", "ago")
    known = asked.select("ticker", "cutoff").join(filings.select("ticker", "filed", "period_end", "net_margin", "eps", "prior_eps", "shares"), "ticker").filter("filed <= cutoff")
    w = Window.partitionBy("ticker", "cutoff")
    known = known.withColumn("m", F.row_number().over(w.orderBy(F.col("net_margin").isNull(), F.desc("period_end"))))
    near, late = F.col("period_end") > F.date_sub("cutoff", (years + 1) * 365), F.col("period_end") >= F.date_sub("cutoff", years * 365)
    known = known.withColumns({"k": F.row_number().over(w.orderBy(~near, F.desc("period_end"))), "was": F.lag(F.when(late & near, F.col("shares"))).over(w.orderBy("period_end"))})
    step = F.when(near & (F.col("k") <= years) & (F.col("eps") > 0) & (F.col("prior_eps") > 0), F.log(F.col("eps") / F.col("prior_eps")))
    jump = near & late & (F.col("was") > 0) & (F.abs(F.col("shares") / F.nullif("was", F.lit(0.0)) - 1) > 0.4)
    told = known.groupBy("ticker", "cutoff").agg(
        F.when(F.count(F.when(F.col("m") <= years + 1, F.col("net_margin"))) >= 3, -F.stddev_samp(F.when(F.col("m") <= years + 1, F.col("net_margin")))).alias("margin_stability"),
        F.when(F.count(step) == years, F.exp(F.sum(step))).alias("chain"), F.coalesce(F.max(jump), F.lit(False)).alias("jump"),
    )
    now, then, ago = (lambda c: F.col(f"now.{c}")), (lambda c: F.col(f"then.{c}")), (lambda c: F.col(f"ago.{c}"))
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0.0)))
    rev, year = cagr(ratio(now("revenue"), then("revenue")), years), (ratio(now("revenue"), ago("revenue")) - 1) * 100
    ends = F.when((now("eps") > 0) & (then("eps") > 0) & ~F.coalesce("jump", F.lit(False)), cagr(ratio(now("eps"), then("eps")), years))
    gap = F.when(now("shares") > 0, -((now("eps") - now("fcf_margin") / 100 * now("revenue") / F.nullif(now("shares"), F.lit(0.0))) / F.greatest(F.abs(now("eps")), F.lit(0.5))))
    out = {
        "rev_cagr": rev, "rev_1y": year, "rev_accel": year - rev, "asset_growth": -cagr(ratio(now("assets"), then("assets")), years), "margin_trend": now("op_margin") - ago("op_margin"),
        "eps_growth": F.when(F.col("chain").isNotNull(), cagr(F.col("chain"), years)).otherwise(ends), "eps_yoy": F.when(now("prior_eps").isNotNull(), yoy(now("eps"), F.nullif(now("prior_eps"), F.lit(0.0)))).otherwise(split_safe_yoy(now("eps"), ago("eps"), now("shares"), ago("shares"))),
        "buyback": share_cut(now("shares"), now("prior_shares"), ago("shares")), "margin_stability": F.col("margin_stability"), "accrual_gap": gap, "gross_margin": now("gross_margin"), "op_margin": now("op_margin"), "net_margin": now("net_margin"), "roe": now("roe"),
        "quality": quality_return(now("roe"), now("roa"), now("net_margin")), "roic": return_on_capital(now("revenue"), now("op_margin"), now("net_margin"), now("roe"), now("roa"), now("net_debt")), "fcf_margin": now("fcf_margin"), "interest_cover": now("interest_cover"), "net_debt": now("net_debt"),
    }
    return cut.join(told, ["ticker", "cutoff"], "left").select("ticker", "cutoff", now("period_end").alias("period_end"), *[F.round(c, 6).alias(n) for n, c in out.items()])


def factor_of(name: str, rows: DataFrame) -> Column:
    """The factor of that name; an unknown one is null."""
    return F.col(name) if name in rows.columns else F.lit(None).cast("double")


def annual_rollup(filings: DataFrame) -> DataFrame:
    """(ticker, year, revenue, margins, eps, shares, prior_eps, prior_shares, quarters, yoy): sums and revenue-weighted margins by
    the period's year, prior values of its newest filing, and growth in revenue over the year before if both are whole (one row
    or four and more)."""
    money = lambda c: F.sum(F.round(c, 4).cast("decimal(30,4)")).cast("double")

    def weighed(c: str) -> Column:
        both = F.col(c).isNotNull() & F.col("revenue").isNotNull()
        return F.try_divide(F.sum(F.when(both, F.col(c) * F.col("revenue"))), F.sum(F.when(both, F.col("revenue")))).alias(c)

    years = filings.groupBy("ticker", F.year("period_end").alias("year")).agg(
        money(F.col("revenue")).alias("revenue"), weighed("gross_margin"), weighed("op_margin"), weighed("net_margin"), F.sum("eps").alias("eps"), F.avg("shares").alias("shares"),
        F.max_by("prior_eps", "period_end").alias("prior_eps"), F.max_by("prior_shares", "period_end").alias("prior_shares"), F.count("*").alias("quarters"),
    )
    whole = years.filter("quarters = 1 OR quarters >= 4")
    w = Window.partitionBy("ticker").orderBy("year")
    grown = whole.withColumn("yoy", yoy(F.col("revenue"), F.lag("revenue").over(w))).select("ticker", "year", "yoy")
    six = ("gross_margin", "op_margin", "net_margin", "eps", "prior_eps")
    return years.join(grown, ["ticker", "year"], "left").select("ticker", "year", F.round("revenue", 2).alias("revenue"), *[F.round(c, 6).alias(c) for c in six], F.round("shares", 4).alias("shares"), F.round("prior_shares", 4).alias("prior_shares"), "quarters", F.round("yoy", 6).alias("yoy"))


def income_snapshot(annual: DataFrame) -> DataFrame:
    """(ticker, year, rev_yoy, eps_yoy, net_margin, buyback): of each ticker's newest whole year, against the year before it in
    the table, whole or not."""
    w = Window.partitionBy("ticker").orderBy("year")
    was = {f"was_{c}": F.lag(c).over(w) for c in ("revenue", "eps", "shares")}
    rows = annual.withColumns(was).filter("quarters = 1 OR quarters >= 4").withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("year")))).filter("rn = 1")
    eps = F.when(F.col("prior_eps").isNotNull(), yoy(F.col("eps"), F.nullif("prior_eps", F.lit(0.0)))).otherwise(split_safe_yoy(F.col("eps"), F.col("was_eps"), F.col("shares"), F.col("was_shares")))
    return rows.select("ticker", "year", F.round(F.when(F.col("was_revenue") > 0, yoy(F.col("revenue"), F.col("was_revenue"))), 6).alias("rev_yoy"), F.round(eps, 6).alias("eps_yoy"), "net_margin", F.round(share_cut(F.col("shares"), F.col("prior_shares"), F.col("was_shares")), 6).alias("buyback"))


def annual_brief(annual: DataFrame, years: int = 5) -> DataFrame:
    """(ticker, n, chain, rev_cagr, first_margin, last_margin): the newest ``years`` whole years of a ticker, oldest first, as a
    chain of revenues in millions, with the growth a year from the first to the last; from two years on."""
    w = Window.partitionBy("ticker").orderBy(F.desc("year"))
    rows = annual.filter("quarters = 1 OR quarters >= 4").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= years)
    one = rows.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("year", "revenue", "net_margin"))).alias("y")).filter(F.size("y") >= 2)
    first, last, n = F.get("y", F.lit(0)), F.element_at("y", -1), F.size("y")
    grown = F.when((first["revenue"] > 0) & (last["revenue"] > 0), (F.pow(last["revenue"] / first["revenue"], 1.0 / (n - 1)) - 1) * 100)
    chain = F.array_join(F.transform("y", lambda x: F.format_string("%.2fM", x["revenue"] / 1e6)), " > ")
    return one.select("ticker", n.cast("long").alias("n"), chain.alias("chain"), F.round(grown, 6).alias("rev_cagr"), first["net_margin"].alias("first_margin"), last["net_margin"].alias("last_margin"))


def needs_fx(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (F.lower(a) != F.lower(b))


def converted(price: Column, from_ccy: Column, to_ccy: Column, from_rate: Column, to_rate: Column) -> Column:
    """A price in another currency by both rates to the euro; as it is between the same, null if a rate isn't known."""
    return F.when(~needs_fx(from_ccy, to_ccy), price).otherwise(F.when((from_rate > 0) & (to_rate > 0), price * from_rate / to_rate))


def rates_as_of(asked: DataFrame, rates: DataFrame) -> DataFrame:
    """``asked`` (ccy, cutoff, ...) with ``rate``: the last of ``rates`` (ccy, bar_date, rate) on or before the cutoff."""
    told = rates.select("ccy", F.col("bar_date").alias("day"), F.lit(0).alias("side"), "rate", F.lit(None).cast("date").alias("cutoff"))
    asks = asked.select("ccy", "cutoff").distinct().select("ccy", F.col("cutoff").alias("day"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("rate"), "cutoff")
    w = Window.partitionBy("ccy").orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = told.unionByName(asks).withColumn("rate", F.last("rate", ignorenulls=True).over(w)).filter("side = 1").select("ccy", "cutoff", "rate")
    return asked.join(found, ["ccy", "cutoff"], "left")


def routed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Yearly rows of the first source, and of the second for tickers that the first lacks altogether, with their source."""
    rest = second.join(first.select("ticker").distinct(), "ticker", "left_anti")
    return first.withColumn("source", F.lit("first")).unionByName(rest.withColumn("source", F.lit("second")))


def patched(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """``rows`` with earnings and shares of instances (ticker, period_end, eps, shares) by period, and the instance before as the
    prior year, for those tickers alone that report no earnings in any row."""
    w = Window.partitionBy("ticker")
    inst = instances.withColumns({"p_eps": F.lag("eps").over(w.orderBy("period_end")), "p_shares": F.lag("shares").over(w.orderBy("period_end"))}).select("ticker", "period_end", F.col("eps").alias("i_eps"), F.col("shares").alias("i_shares"), "p_eps", "p_shares")
    none = F.max(F.col("eps").isNotNull()).over(w) == F.lit(False)
    both = rows.withColumn("none", none).join(inst, ["ticker", "period_end"], "left")
    use = F.col("none") & F.col("i_eps").isNotNull()
    put = lambda old, new: F.when(use, F.col(new)).otherwise(F.col(old)).alias(old)
    prior = lambda old, new: F.when(use & F.col("p_eps").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    mine = {"eps": put("eps", "i_eps"), "shares": put("shares", "i_shares"), "prior_eps": prior("prior_eps", "p_eps"), "prior_shares": prior("prior_shares", "p_shares")}
    return both.select(*[mine.get(c, F.col(c)) for c in rows.columns])


def enriched(quotes: DataFrame, latest: DataFrame) -> DataFrame:
    """``quotes`` (ticker, price, class, ...) with earnings_yield and peg_yield from the latest factors (ticker, eps, eps_growth); coins get none."""
    rows = quotes.join(latest, "ticker", "left")
    v = valuation(F.col("price"), F.col("eps"), F.col("eps_growth"), *[F.lit(None).cast("double")] * 3)
    return rows.select(*quotes.columns, *[F.round(F.when(F.col("class") != 0, v[c]), 6).alias(c) for c in ("earnings_yield", "peg_yield")])


def insider_net(asked: DataFrame, trades: DataFrame, window: int = 180) -> DataFrame:
    """(ticker, cutoff, net): buys less sales in the ``window`` days before each cutoff; null without any."""
    near = asked.join(trades, "ticker").filter((F.col("tx_date") >= F.date_sub("cutoff", window)) & (F.col("tx_date") < F.col("cutoff")))
    sums = near.groupBy("ticker", "cutoff").agg(F.sum(F.when(F.col("buy"), 1).otherwise(-1)).cast("double").alias("net"))
    return asked.select("ticker", "cutoff").join(sums, ["ticker", "cutoff"], "left")


def valuation(price: Column, eps: Column, growth: Column, ebitda: Column, shares: Column, net_debt: Column) -> dict[str, Column]:
    """Earnings yield, EBITDA yield on enterprise value, and growth-scaled earnings yield; null where a leg is missing."""
    ev = shares * price + F.coalesce(net_debt, F.lit(0.0))
    earning = F.when(price > 0, eps / price * 100)
    return {
        "earnings_yield": earning,
        "ebitda_yield": F.when((ebitda > 0) & (shares > 0) & (price > 0) & (ev > 0), ebitda / ev * 100),
        "peg_yield": F.when((earning > 0) & (growth > 0), earning * growth),
    }


def quality_return(roe: Column, roa: Column, margin: Column, most: float = 20.0) -> Column:
    """The return on equity if its sign is the margin's and it is under ``most`` times a return on assets above 0; else the latter."""
    credible = F.coalesce((roe >= 0) == (margin >= 0), F.lit(True)) & ~F.coalesce((roa > 0) & (roe / F.nullif(roa, F.lit(0.0)) >= most), F.lit(False))
    return F.when(roe.isNotNull() & credible, roe).otherwise(roa)
