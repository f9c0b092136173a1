"""Reference data between runs: symbol lookups with remembered misses, last good copies, swapped listings, filled facts, coverage.

All are joins by symbol, code or venue; ages are in days from ``today``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remembered_misses(old: DataFrame, answers: DataFrame, today: str) -> DataFrame:
    """(isin, missed_on): misses with the day of the newest. Only an answer that says there is nothing (``empty``) is one; a
    lookup that failed says nothing, and a hit forgets."""
    fresh = answers.filter("status = 'empty'").select("isin", F.lit(today).cast("date").alias("missed_on"))
    kept = old.join(answers.filter("status = 'found'").select("isin"), "isin", "left_anti")
    return kept.unionByName(fresh).groupBy("isin").agg(F.max("missed_on").alias("missed_on"))


def resolve_symbols(asked: DataFrame, known: DataFrame, misses: DataFrame, today: str, days: int = 30) -> DataFrame:
    """(isin, symbol, state): the known symbol; ``blocked`` while a miss is under ``days`` old; else ``ask``."""
    rows = asked.select("isin").distinct().join(known.filter("trim(symbol) <> ''").select("isin", "symbol"), "isin", "left").join(misses, "isin", "left")
    fresh = F.datediff(F.lit(today).cast("date"), "missed_on") < days
    return rows.select("isin", "symbol", F.when(F.col("symbol").isNotNull(), "known").when(fresh, "blocked").otherwise("ask").alias("state"))


def last_good(fresh: DataFrame, kept: DataFrame, by: str = "venue") -> DataFrame:
    """The fresh rows, and the kept ones of venues of which there are none, as in an outage."""
    return fresh.unionByName(kept.join(fresh.select(by).distinct(), by, "left_anti"))


def swapped_listings(universe: DataFrame, mapping: DataFrame, charts: DataFrame, years: int = 5, least_bars: int = 60) -> DataFrame:
    """(symbol, listing): the mapped listing where its chart proves it: in euros, ``years`` long and of ``least_bars`` bars; else the
    symbol. ``charts`` is (ticker, currency, first_date, last_date, n)."""
    good = charts.filter((F.col("currency") == "EUR") & (F.months_between("last_date", "first_date") >= 12 * years) & (F.col("n") >= least_bars)).select(F.col("ticker").alias("listing"))
    proven = mapping.filter("listing <> ''").join(good, "listing", "left_semi").select("symbol", "listing")
    return universe.select("symbol").join(proven, "symbol", "left").select("symbol", F.coalesce("listing", "symbol").alias("listing"))


def swap_tally(swaps: DataFrame, mapping: DataFrame, pins: DataFrame) -> DataFrame:
    """(swapped, unproven, unmapped, shadowed): how many symbols were swapped, had a listing that wasn't good enough, had none, and
    how many pinned symbols a swap hides."""
    rows = swaps.join(mapping.filter("listing <> ''").select("symbol", F.lit(True).alias("mapped")), "symbol", "left").join(pins.select("symbol", F.lit(True).alias("pin")), "symbol", "left")
    moved, mapped = F.col("symbol") != F.col("listing"), F.coalesce("mapped", F.lit(False))
    return rows.agg(F.count_if(moved).alias("swapped"), F.count_if(~moved & mapped).alias("unproven"), F.count_if(~moved & ~mapped).alias("unmapped"), F.count_if(moved & F.coalesce("pin", F.lit(False))).alias("shadowed"))


def home_of(swaps: DataFrame) -> DataFrame:
    """(listing, symbol): swapped listings with the symbol that they stand for; the first by name if several do."""
    return swaps.filter("symbol <> listing").groupBy("listing").agg(F.min("symbol").alias("symbol"))


def filled(main: DataFrame, *others: DataFrame, fields: tuple[str, ...] = ("ter", "aum")) -> DataFrame:
    """``main`` (isin, fields), whose holes are filled from the others in their order. What it says itself stands."""
    rows = main
    for n, other in enumerate(others):
        rows = rows.join(other.select("isin", *[F.col(f).alias(f"{f}_{n}") for f in fields]), "isin", "left")
    return rows.select("isin", *[F.coalesce(f, *[F.col(f"{f}_{n}") for n in range(len(others))]).alias(f) for f in fields])


def cache_use(cached_on: Column, today: str, serve_days: int = 3, refetch_days: int = 1) -> tuple[Column, Column]:
    """Whether an entry may be served, and whether it should be fetched again; what isn't cached is fetched."""
    age = F.datediff(F.lit(today).cast("date"), cached_on)
    return F.coalesce(age <= serve_days, F.lit(False)), F.coalesce(age >= refetch_days, F.lit(True))


def to_refetch(entries: DataFrame, today: str, budget: int = 400) -> DataFrame:
    """(isin): entries (isin, cached_on) to fetch again, oldest first, ``budget`` of them a run."""
    return entries.filter(cache_use(F.col("cached_on"), today)[1]).orderBy(F.asc_nulls_first("cached_on"), "isin").limit(budget).select("isin")


def coverage(members: DataFrame, served: DataFrame) -> DataFrame:
    """(members, served, unserved): how many of those who ever were members have a chart."""
    rows = members.select("ticker").distinct().join(served.select("ticker", F.lit(True).alias("there")).distinct(), "ticker", "left")
    return rows.agg(F.count("*").alias("members"), F.count("there").alias("served"), F.count_if(F.col("there").isNull()).alias("unserved"))


def is_dead(kind: Column, name: Column) -> Column:
    """Whether a symbol has been handed on: a fund whose name is a number."""
    return (kind == "MUTUALFUND") & name.rlike("^[0-9]+$")


def with_losers(universe: DataFrame, losers: list[str]) -> DataFrame:
    """(ticker): the universe and a fixed list of names that went under, each once."""
    return universe.select("ticker").union(universe.sparkSession.createDataFrame([(x,) for x in losers], "ticker string")).distinct()


def fresh_listings(quotes: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Quotes whose last bar is at most ``days`` old or unknown."""
    return quotes.filter(F.col("last_date").isNull() | (F.datediff(F.lit(today).cast("date"), "last_date") <= days))


def class_census(quotes: DataFrame) -> DataFrame:
    """(class, total, scored)."""
    return quotes.groupBy("class").agg(F.count("*").alias("total"), F.count("score").alias("scored"))


def twin_groups(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """(members, n): rows that agree in all ``keys``, as names joined in order; groups of two or more."""
    return quotes.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("ticker")), " ").alias("members"), F.countDistinct("ticker").alias("n")).filter("n > 1").select("members", "n")


def borrowed(funds: DataFrame, field: str, spread: float = 0.01) -> DataFrame:
    """(fund, value, own): the fund's own ``field``, or where it has none, that of the funds with its index key, if they agree
    within ``spread``."""
    told = funds.filter(F.col(field).isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.min(field).alias("lo"), F.max(field).alias("hi"), F.avg(field).alias("mean"))
    good = told.filter(F.col("hi") - F.col("lo") <= spread * F.abs("hi")).select("key", "mean")
    return funds.join(good, "key", "left").select("fund", F.round(F.coalesce(field, "mean"), 6).alias("value"), F.col(field).isNotNull().alias("own"))


def ordered_tiers(name: Column, tiers: DataFrame) -> Column:
    """The tier of the first keyword of a small table (keyword, tier, place) that the name has."""
    rows = tiers.orderBy("place").collect()
    return reduce(lambda rest, r: F.when(F.contains(F.lower(name), F.lit(r["keyword"])), r["tier"]).otherwise(rest), reversed(rows), F.lit("other"))


def headline_rows(titles: DataFrame) -> DataFrame:
    """(title, tickers): equal titles once, with all the tickers that they came for."""
    return titles.groupBy("title").agg(F.array_join(F.array_sort(F.collect_set("ticker")), " ").alias("tickers"))


def premium(pe: DataFrame, legs: DataFrame, home: str) -> DataFrame:
    """(fund, premium, leg, excess): a fund's price-earnings ratio over the home fund's, in percent, and its return less the
    home fund's over the longest leg (fund, leg, years, ret) that both have."""
    base = F.broadcast(pe.filter(F.col("fund") == home).select(F.col("pe").alias("base"), F.lit(1).alias("one")))
    own = legs.join(legs.filter(F.col("fund") == home).select("leg", F.col("ret").alias("home_ret")), "leg")
    longest = own.groupBy("fund").agg(F.max_by(F.struct("leg", (F.col("ret") - F.col("home_ret")).alias("excess")), "years").alias("m"))
    rows = pe.filter(F.col("fund") != home).withColumn("one", F.lit(1)).join(base, "one").join(longest, "fund", "left")
    return rows.select("fund", F.round(100 * (F.try_divide("pe", F.col("base")) - 1), 6).alias("premium"), "m.leg", F.round("m.excess", 6).alias("excess"))


def worst(rows: DataFrame, by: str, measure: str, n: int = 3) -> DataFrame:
    """(by, place, ticker, measure): the ``n`` lowest of each group, for the footers of a report."""
    w = Window.partitionBy(by).orderBy(measure, "ticker")
    return rows.filter(F.col(measure).isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(by, "place", "ticker", measure)
