"""Paper portfolio and watch list between runs: holdings, value, benchmark, alerts on facts, exits, owned names, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holdings(lots: DataFrame) -> DataFrame:
    """(ticker, qty, cost) of lots (ticker, qty, cost)."""
    return lots.groupBy("ticker").agg(F.sum("qty").alias("qty"), F.sum("cost").alias("cost"))


def digest(lots: DataFrame, now: DataFrame, levels: DataFrame, level_now: float, fee: float = 1.0) -> DataFrame:
    """(cost, value, n_priced, n, bench_value): what lots (day, ticker, qty, cost) are worth at prices now (ticker, px), priced names
    alone; and the same money less a fee a lot in the benchmark at its level (day, level) of each day, null unless every name has a
    price and every day a level."""
    held = holdings(lots).join(now, "ticker", "left")
    mine = held.agg(F.sum("cost").alias("cost"), F.sum(F.when(F.col("px") > 0, F.col("qty") * F.col("px"))).alias("value"), F.count_if(F.col("px") > 0).alias("n_priced"), F.count("*").alias("n"))
    units = lots.join(levels, "day", "left").agg(F.count_if(F.col("level").isNull()).alias("gaps"), F.sum((F.col("cost") - fee) / F.col("level")).alias("units"))
    both = mine.withColumn("one", F.lit(1)).join(units.withColumn("one", F.lit(1)), "one")
    whole = (F.col("n_priced") == F.col("n")) & (F.col("gaps") == 0)
    return both.select(F.round("cost", 4).alias("cost"), F.round("value", 4).alias("value"), "n_priced", "n", F.round(F.when(whole, F.col("units") * level_now), 4).alias("bench_value"))


def fact_alerts(before: DataFrame, now: DataFrame, ter_step: float = 0.05, aum_share: float = 0.5) -> DataFrame:
    """(isin, alert): a fee that rose by ``ter_step`` points or more, a size at ``aum_share`` or less of what it was, another class or
    replication; of funds that both runs know."""
    b = before.select("isin", *[F.col(c).alias(f"was_{c}") for c in ("ter", "aum", "share_class", "replication")])
    rows = now.join(b, "isin")
    tests = {"fee": F.round(F.col("ter") - F.col("was_ter"), 6) >= ter_step, "size": F.col("aum") <= aum_share * F.col("was_aum"), "class": F.col("share_class") != F.col("was_share_class"), "replication": F.col("replication") != F.col("was_replication")}
    told = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests.items()]))
    return rows.select("isin", F.explode(told).alias("alert"))


def exit_review(before: DataFrame, now: DataFrame) -> DataFrame:
    """(ticker, failed): names that passed before (ticker, failed: tags) and fail now."""
    passed = before.filter(F.size("failed") == 0).select("ticker")
    return now.filter(F.size("failed") > 0).join(passed, "ticker", "left_semi").select("ticker", F.array_join("failed", "+").alias("failed"))


def resolve_owned(owned: DataFrame, quotes: DataFrame) -> DataFrame:
    """(owned, ticker, how): a holding (owned, isin, base) by its code, the listing in euros first; else by its base symbol, if
    one quote alone has it. ``quotes`` is (ticker, isin, base, currency)."""
    coded = quotes.filter("isin IS NOT NULL").groupBy("isin").agg(F.min_by("ticker", F.struct((F.col("currency") != "EUR").alias("far"), "ticker")).alias("t1"))
    lone = quotes.groupBy("base").agg(F.count("*").alias("n"), F.min("ticker").alias("t2")).filter("n = 1").drop("n")
    rows = owned.join(coded, "isin", "left").join(lone, "base", "left")
    return rows.select("owned", F.coalesce("t1", "t2").alias("ticker"), F.when(F.col("t1").isNotNull(), "code").when(F.col("t2").isNotNull(), "base").alias("how"))


def order_quantity(part: Column, price: Column, step: float = 0.0001) -> Column:
    """Shares that a slice of money buys, rounded down to the broker's step; null without a price."""
    return F.when(price > 0, F.round(F.floor(part / price / step) * step, 6))


def valuation_state(premium: Column, band: float = 10.0) -> Column:
    """By percent over the usual ratio."""
    return F.when(premium <= -band, "CHEAP").when(premium >= band, "RICH").otherwise("NEUTRAL")


def fund_flows(journal: DataFrame) -> DataFrame:
    """(ticker, flow): growth in a fund's size over growth in its price, from its first to its last day with both (day, ticker, aum,
    px), in percent: what came in or went out."""
    rows = journal.filter("aum > 0 AND px > 0").groupBy("ticker").agg(F.min_by(F.struct("aum", "px"), "day").alias("a"), F.max_by(F.struct("aum", "px"), "day").alias("b"), F.countDistinct("day").alias("n"))
    return rows.filter("n > 1").select("ticker", F.round(100 * ((F.col("b.aum") / F.col("a.aum")) / (F.col("b.px") / F.col("a.px")) - 1), 6).alias("flow"))
