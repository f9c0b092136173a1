"""Universe construction and reference data: first-wins unions, normalisation, tiered lookups, counters, look-through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ranks import running

#: Venue suffixes that stay in a symbol (fixed values).
SYMBOL_VENUES = ["L", "DE", "PA", "AS", "MI", "MC", "SW", "ST", "CO", "OL", "HE", "LS"]
#: Country and trading currency by venue suffix (fixed values).
VENUES = {
    "DE": ("Germany", "EUR"), "L": ("UK", "GBP"), "PA": ("France", "EUR"), "AS": ("Netherlands", "EUR"), "MI": ("Italy", "EUR"), "MC": ("Spain", "EUR"), "SW": ("Switzerland", "CHF"), "VI": ("Austria", "EUR"),
    "LS": ("Portugal", "EUR"), "BR": ("Belgium", "EUR"), "HE": ("Finland", "EUR"), "ST": ("Sweden", "SEK"), "OL": ("Norway", "NOK"), "CO": ("Denmark", "DKK"), "IR": ("Ireland", "EUR"), "TO": ("Canada", "CAD"),
    "HK": ("Hong Kong", "HKD"), "T": ("Japan", "JPY"), "AX": ("Australia", "AUD"), "SA": ("Brazil", "BRL"), "NS": ("India", "INR"), "SS": ("China", "CNY"), "SZ": ("China", "CNY"), "KS": ("South Korea", "KRW"),
}
#: Member states of the Union, as spelled above (fixed values).
EU_MARKETS = ["Germany", "France", "Netherlands", "Italy", "Spain", "Austria", "Portugal", "Belgium", "Finland", "Sweden", "Denmark", "Ireland"]
#: Fund issuers that begin a fund's name, and words that say nothing of its index (fixed values).
ISSUERS = [
    "amundi index solutions", "legal & general", "credit suisse", "goldman sachs", "state street", "first trust", "bnp paribas easy", "bnp paribas", "jp morgan", "global x", "21shares", "abrdn",
    "amundi", "comstage", "coinshares", "deka", "dws", "fidelity", "franklin", "han etf", "hsbc", "invesco", "ishares", "jpmorgan", "l&g", "lyxor", "ossiam", "pimco", "rize", "spdr", "swisscanto",
    "tabula", "ubs", "vaneck", "vanguard", "vontobel", "wisdomtree", "xtrackers",
]
NOISE = [
    "ucits", "etf", "etfs", "etc", "etp", "fund", "index", "indices", "solutions", "core", "prime", "source", "pea", "eqqq", "acc", "accumulating", "dist", "distributing", "inc", "1c", "1d", "1acc",
    "2c", "eur", "usd", "gbp", "chf", "&",
]


def is_isin(code: Column) -> Column:
    return F.coalesce(code.rlike("^[A-Z]{2}[0-9A-Za-z]{9}[0-9]$"), F.lit(False))


def suffix_of(symbol: Column) -> Column:
    """What follows the last dot, null without one."""
    return F.when(symbol.contains("."), F.element_at(F.split(symbol, r"\."), -1))


def normal_symbol(symbol: Column) -> Column:
    """Share-class dots become hyphens; a symbol with a venue's suffix stays."""
    return F.when(F.coalesce(suffix_of(symbol).isin(*SYMBOL_VENUES), F.lit(False)), symbol).otherwise(F.replace(symbol, F.lit("."), F.lit("-")))


def in_venues(suffix: Column, field: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, told in VENUES.items() for x in (k, told[field])]), suffix)


def is_coin(symbol: Column) -> Column:
    """Whether a symbol is quoted in a currency, as a coin is."""
    return symbol.rlike("-(USD|EUR)$")


def market_of(symbol: Column) -> Column:
    """Country of the listing; an unknown suffix stands for itself, none is the USA, or for a coin its class."""
    suffix = F.upper(suffix_of(symbol))
    return F.when(suffix.isNotNull(), F.coalesce(in_venues(suffix, 0), suffix)).when(is_coin(symbol), "Crypto").otherwise("USA")


def listing_currency(symbol: Column) -> Column:
    """Currency that the listing trades in: dollars without a suffix, null if the suffix is unknown."""
    return F.when(suffix_of(symbol).isNull(), "USD").otherwise(in_venues(suffix_of(symbol), 1))


def asset_class(symbol: Column, is_fund: Column) -> Column:
    """0 for coins, 1 for exchange-traded funds, 2 for stocks."""
    return F.when(is_coin(symbol), 0).when(is_fund, 1).otherwise(2)


def union_first_wins(ponds: list[DataFrame], caps: list[int | None]) -> DataFrame:
    """(symbol, sector, pond): the ponds' symbols, each pond cut to its cap by its order (symbol), the first pond's row kept."""
    parts = []
    for k, (pond, cap) in enumerate(zip(ponds, caps, strict=True)):
        part = pond.select("symbol", "sector").distinct()
        parts.append((part.orderBy("symbol", "sector").limit(cap) if cap else part).withColumn("pond", F.lit(k)))
    w = Window.partitionBy("symbol").orderBy("pond", "sector")
    return reduce(DataFrame.unionByName, parts).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def sector_matches(sector: Column, keywords: list[str]) -> Column:
    """Whether any keyword is in the sector, whatever the case; none means all."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(sector), F.lit(k.strip().lower())) for k in keywords]) if keywords else F.lit(True)


def merge_lists(main: DataFrame, others: DataFrame, cap: int) -> DataFrame:
    """(isin, speculative): the ``cap`` largest of ``main`` (isin, size), and those of ``others`` that aren't in any of it."""
    head = main.orderBy(F.desc("size"), "isin").limit(cap).select("isin", F.lit(False).alias("speculative"))
    return head.unionByName(others.select("isin").distinct().join(main.select("isin"), "isin", "left_anti").withColumn("speculative", F.lit(True)))


def prefix_lookup(names: DataFrame, known: DataFrame, least: int = 10) -> DataFrame:
    """(name, value): the value of all known names (known, value) that begin with a name of ``least`` characters or more,
    if they agree. Names meet by their first ``least`` characters, so no pair is made that differs there."""
    a = names.filter(F.length("name") >= least).withColumn("head", F.left("name", F.lit(least)))
    b = known.withColumn("head", F.left("known", F.lit(least)))
    hits = a.join(b, "head").filter(F.startswith("known", "name")).groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return hits.filter("lo = hi").select("name", F.col("lo").alias("value"))


def tiered(asked: DataFrame, exact: DataFrame, stem: DataFrame, prefix: DataFrame) -> DataFrame:
    """(symbol, value, tier): by symbol, else by the symbol's stem on another venue, else by a unique name prefix."""
    rows = asked.withColumn("stem", F.element_at(F.split("symbol", r"\."), 1))
    rows = rows.join(exact.select("symbol", F.col("value").alias("v1")), "symbol", "left").join(stem.groupBy("stem").agg(F.min("value").alias("v2")), "stem", "left")
    rows = rows.join(prefix_lookup(asked.select("name").distinct(), prefix).withColumnRenamed("value", "v3"), "name", "left")
    tier = F.when(F.col("v1").isNotNull(), 1).when(F.col("v2").isNotNull(), 2).when(F.col("v3").isNotNull(), 3)
    return rows.select("symbol", F.coalesce("v1", "v2", "v3").alias("value"), tier.alias("tier"))


def pit_pool(universe: DataFrame, today: DataFrame, ever: DataFrame) -> DataFrame:
    """(ticker): the universe without today's members, and everyone who ever was one."""
    return universe.select("ticker").join(today.select("ticker"), "ticker", "left_anti").union(ever.select("ticker")).distinct()


def quality_counters(rows: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, missing, present): for each column the rows without and with a value."""
    long = rows.select(*[F.col(m).isNull().alias(m) for m in measures]).unpivot([], measures, "measure", "gone")
    return long.groupBy("measure").agg(F.count_if("gone").alias("missing"), F.count_if(~F.col("gone")).alias("present"))


COMMON = 1000  #: units that hold a symbol; one with more is left to the last step where a unit has rarer ones
PAIRS = 1 << 21  #: pairs that a task counts, about
CHUNK = 1 << 16  #: numbers in a holder list


def _shared(h: DataFrame, least: int) -> DataFrame:
    """(a, b, shared): pairs of units of ``h`` (unit, symbol), distinct and without nulls, that share ``least`` symbols or more, a below b.

    Units are numbered, each of a unit's symbols brings it the numbers of the later units that hold it, and what it was brought is counted in
    one task. Of a unit's ``least`` - 1 most common symbols, those with over COMMON holders don't bring it units for which they are such ones
    too: a pair has a shared symbol beside these, and they are added in the end."""
    units = running(h.select("unit").distinct().withColumn("_all", F.lit(1)), ["_all"], [F.col("unit")]).select("unit", F.col("upto").cast("int").alias("k"))
    uses = h.groupBy("symbol").agg(F.count("*").alias("uses"))
    held = h.join(units, "unit").select("k", "symbol")
    skewed = not uses.filter(F.col("uses") > COMMON).isEmpty()
    if skewed:
        w = Window.partitionBy("k")
        ranked = held.join(uses, "symbol").withColumns({"rn": F.row_number().over(w.orderBy("uses", "symbol")), "n": F.count("*").over(w)})
        held = ranked.select("k", "symbol", ((F.col("uses") > COMMON) & (F.col("rn") > F.col("n") - least + 1)).alias("common"))
    else:
        held = held.withColumn("common", F.lit(False))
    lists = held.groupBy("symbol", "common", F.floor(F.col("k") / CHUNK).alias("chunk")).agg(F.collect_list("k").alias("others")).withColumnRenamed("common", "theirs")
    later = F.filter("others", lambda x: x > F.col("k"))
    met = held.join(lists, "symbol").filter("NOT (common AND theirs)").select("k", later.alias("others")).filter(F.size("others") > 0)
    expected = uses.agg(F.sum(F.col("uses") * F.col("uses") / 2)).first()[0] or 0
    parts = max(int(h.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(min(expected / PAIRS, 20_000)))
    counts = met.repartition(parts, "k").select("k", F.explode("others").alias("o")).groupBy("k", "o").agg(F.count("*").alias("shared"))
    if skewed:
        most = held.filter("common").groupBy("k").agg(F.collect_list("symbol").alias("most"))
        both = counts.join(most.withColumnRenamed("most", "x"), "k", "left").join(most.select(F.col("k").alias("o"), F.col("most").alias("y")), "o", "left")
        counts = both.select("k", "o", (F.col("shared") + F.coalesce(F.size(F.array_intersect("x", "y")), F.lit(0))).alias("shared"))
    told = counts.filter(F.col("shared") >= least)
    return told.join(units.select(F.col("unit").alias("a"), "k"), "k").join(units.select(F.col("unit").alias("b"), F.col("k").alias("o")), "o").select("a", "b", F.col("shared").cast("long").alias("shared"))


def overlaps(holdings: DataFrame, least: int = 5) -> DataFrame:
    """(a, b, shared): pairs of funds that share ``least`` holdings or more."""
    return _shared(holdings.select(F.col("fund").alias("unit"), "symbol").distinct().dropna(), least)


def overlap_groups(holdings: DataFrame, least: int = 5) -> DataFrame:
    """(report, members, common): in each report, funds of ``least`` holdings or more in order of name; each joins the first
    group with all of whose members it shares ``least``, else begins one. A report's pairs of funds that share so many are folded in one task, as
    each step depends on those before; funds that share so many with none are in no group of two."""
    import pandas as pd

    h = holdings.select("report", "fund", "symbol").distinct()
    pairs = _shared(h.dropna().select(F.struct("report", "fund").alias("unit"), F.struct("report", "symbol").alias("symbol")), least).select("a.report", F.col("a.fund").alias("a"), F.col("b.fund").alias("b"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        groups: list[list[str]] = []
        place: dict[str, int] = {}
        for fund in sorted(near):
            g = next((g for g in sorted({place[x] for x in near[fund] if x in place}) if near[fund].issuperset(groups[g])), len(groups))
            if g == len(groups):
                groups.append([])
            groups[g].append(fund)
            place[fund] = g
        rows = [(pdf["report"].iloc[0], k, len(g), " ".join(g), fund) for k, g in enumerate(groups) if len(g) > 1 for fund in g]
        return pd.DataFrame(rows, columns=["report", "place", "size", "members", "fund"])

    groups = pairs.groupBy("report").applyInPandas(fold, "report long, place long, size long, members string, fund string")
    held = groups.join(h, ["report", "fund"]).groupBy("report", "place", "size", "members", "symbol").agg(F.count("*").alias("holders"))
    return held.groupBy("report", "place", "members").agg(F.count_if(F.col("holders") == F.col("size")).alias("common")).select("report", "members", "common")


def concentration(holdings: DataFrame, top: int = 3, most: float = 40.0) -> DataFrame:
    """(fund, top_weight, concentrated): the weight of a fund's ``top`` holdings."""
    w = Window.partitionBy("fund").orderBy(F.desc("weight"), "symbol")
    one = holdings.withColumn("rn", F.row_number().over(w)).groupBy("fund").agg(F.sum(F.when(F.col("rn") <= top, F.col("weight"))).alias("t"))
    return one.select("fund", F.round("t", 6).alias("top_weight"), (F.col("t") >= most).alias("concentrated"))


def look_through(positions: DataFrame, holdings: DataFrame, field: DataFrame) -> DataFrame:
    """(field, weight): positions (ticker, weight) with funds replaced by what they hold, weights scaled to 100, by field."""
    total = holdings.groupBy("fund").agg(F.sum("weight").alias("all"))
    inner = holdings.join(total, "fund").select(F.col("fund").alias("ticker"), "symbol", (F.col("weight") / F.col("all")).alias("part"))
    flat = positions.join(inner, "ticker", "left").select(F.coalesce("symbol", "ticker").alias("symbol"), (F.col("weight") * F.coalesce("part", F.lit(1.0))).alias("weight"))
    told = flat.join(field, "symbol", "left").groupBy(F.coalesce("field", F.lit("other")).alias("field")).agg(F.sum("weight").alias("w"))
    every = told.agg(F.sum("w").alias("all")).withColumn("one", F.lit(1))
    return told.withColumn("one", F.lit(1)).join(F.broadcast(every), "one").select("field", F.round(100 * F.col("w") / F.col("all"), 6).alias("weight"))


def allocation_gaps(actual: DataFrame, wanted: DataFrame, band: float = 5.0) -> DataFrame:
    """(ticker, gap, advice): actual less wanted weight; inside the band, its edges not included, nothing is to be done."""
    both = actual.withColumnRenamed("weight", "a").join(wanted.withColumnRenamed("weight", "w"), "ticker", "full")
    gap = F.coalesce("a", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))
    return both.select("ticker", F.round(gap, 6).alias("gap"), F.when(gap >= band, "trim").when(gap <= -band, "add").otherwise("hold").alias("advice"))


def index_key(name: Column, issuers: int = 3) -> Column:
    """The words of a fund's name that identify its index, in order of the alphabet, each once; null under two. Up to
    ``issuers`` issuers are taken off its beginning, the longest that fits each time."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"[.,()']", ""), "[-/+:]", " "), r"\s+", " "))
    brands = "|".join(sorted(ISSUERS, key=len, reverse=True))
    for _ in range(issuers):
        flat = F.regexp_replace(flat, f"^(?:{brands})(?: |$)", "")
    words = F.array_sort(F.array_distinct(F.array_except(F.filter(F.split(flat, " "), lambda w: w != ""), F.array(*map(F.lit, NOISE)))))
    return F.when(F.size(words) >= 2, F.array_join(words, " "))


def fx_rates(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ccy, rate): the rate to the euro by the direct pair, else one over the inverted pair; pence are hundredths."""
    scale = F.when(F.col("ccy").isin("GBp", "GBX"), 0.01).otherwise(1.0)
    rows = asked.withColumn("unit", F.when(F.col("ccy").isin("GBp", "GBX"), "GBP").otherwise(F.col("ccy")))
    direct, inverse = pairs.filter("quote = 'EUR'").select(F.col("base").alias("unit"), F.col("px").alias("d")), pairs.filter("base = 'EUR'").select(F.col("quote").alias("unit"), F.col("px").alias("i"))
    rows = rows.join(direct, "unit", "left").join(inverse, "unit", "left")
    return rows.select("ccy", F.round(F.when(F.col("unit") == "EUR", 1.0).otherwise(F.coalesce("d", F.try_divide(F.lit(1.0), F.col("i")))) * scale, 8).alias("rate"))
