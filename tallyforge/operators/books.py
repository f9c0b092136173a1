"""Reports on ranked books over the walk-forward samples: holds, deciles, rank slices, entry regimes, trims, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.decorrelate import greedy
from tallyforge.operators.series import by_date
from tallyforge.operators.stats import edges, pick, placed
from tallyforge.operators.walk import samples
from tallyforge.sources.folders import written


def hold_sweep(bars: DataFrame, spans: DataFrame, sectors: DataFrame, holds: tuple[int, ...] = (1, 2, 3, 5, 8, 10)) -> DataFrame:
    """(years, n, edge): the halves' edge for each holding time; each hold has its own samples and peers."""
    slim = lambda df, y: df.select(F.lit(y).alias("years"), "score", "relative", F.concat_ws(":", "ticker", F.col("cutoff").cast("string")).alias("id"))
    rows = reduce(DataFrame.unionByName, [written(slim(samples(bars, spans, sectors, years=y), y)) for y in holds])  # one hold's shuffle files at a time
    return edges(rows, "years", key="id").select("years", "n", "edge")


def book_multiples(rows: DataFrame, top: int) -> DataFrame:
    """(bucket, multiple, start): the equal-weight book of a bucket's ``top`` by score."""
    ranked = placed(rows, "bucket", [F.desc("score"), "ticker", "cutoff"]).filter(F.col("rn") <= top)
    return ranked.groupBy("bucket").agg(F.avg(1 + F.col("realized") / 100).alias("multiple"), F.min("cutoff").alias("start"))


def deciles(rows: DataFrame, top: int = 10) -> DataFrame:
    """(n, d10, d50, d90, p_loss): nearest-rank deciles of the books' multiples, and the share of books that lost."""
    ranked = placed(book_multiples(rows, top).withColumn("one", F.lit(1)), "one", ["multiple", "bucket"])
    at = lambda p: F.round(pick("multiple", F.floor(p / 100.0 * (F.col("n") - 1) + 0.5)), 6)
    return ranked.agg(F.count("*").alias("n"), at(10.0).alias("d10"), at(50.0).alias("d50"), at(90.0).alias("d90"), F.round(F.avg((F.col("multiple") < 1).cast("double")), 6).alias("p_loss"))


def rank_slices(rows: DataFrame) -> DataFrame:
    """(slice, n, mean): realised return of disjoint slices of rank: 1, 2-5, 6-10, 11-20, 21-50."""
    rn = F.col("rn")
    name = F.when(rn == 1, "01").when(rn <= 5, "02-05").when(rn <= 10, "06-10").when(rn <= 20, "11-20").when(rn <= 50, "21-50")
    told = placed(rows, "bucket", [F.desc("score"), "ticker", "cutoff"]).withColumn("slice", name).filter("slice IS NOT NULL")
    return told.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("realized"), 6).alias("mean"))


def entry_states(rows: DataFrame, benchmark: DataFrame, top: int = 10) -> DataFrame:
    """(state, n, mean): books by the market's fall from its running high at their first day: over -5, to -15, below."""
    w = Window.partitionBy(F.lit(1)).orderBy("bar_date")  # one row a day of one series
    fall = benchmark.withColumn("dd", 100 * (F.col("close") / F.max("close").over(w) - 1)).select(F.col("bar_date").alias("start"), "dd")
    told = book_multiples(rows, top).join(fall, "start").withColumn("state", F.when(F.col("dd") > -5, "high").when(F.col("dd") > -15, "dip").otherwise("bear"))
    return told.groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg("multiple"), 6).alias("mean"))


def drop_bottom(rows: DataFrame, factor: str, percent: float) -> DataFrame:
    """``rows`` without those under the bucket's floor of ``factor``: the value at place trunc(percent/100*n). Rows
    without the factor stay."""
    known = placed(rows.filter(F.col(factor).isNotNull()), "bucket", [factor])
    floor = known.groupBy("bucket").agg(pick(factor, F.least(F.floor(percent / 100.0 * F.col("n")), F.col("n") - 1)).alias("floor"))
    return rows.join(floor, "bucket", "left").filter(F.col(factor).isNull() | F.col("floor").isNull() | (F.col(factor) >= F.col("floor"))).drop("floor")


def trimmed_books(rows: DataFrame, factor: str, percents: tuple[float, ...], top: int = 10) -> DataFrame:
    """(percent, buckets, mean): books after each trim; names from below refill them."""
    each = [book_multiples(drop_bottom(rows, factor, p), top).withColumn("percent", F.lit(p)) for p in percents]
    return reduce(DataFrame.unionByName, each).groupBy("percent").agg(F.count("*").alias("buckets"), F.round(F.avg("multiple"), 6).alias("mean"))


def union_books(rows: DataFrame, other: Column, top: int = 5) -> DataFrame:
    """(bucket, names, mean): two styles' books as one, each ticker once a bucket."""
    one = placed(rows, "bucket", [F.desc("score"), "ticker", "cutoff"]).filter(F.col("rn") <= top).drop("rn", "n")
    two = placed(rows.withColumn("_o", other), "bucket", [F.desc("_o"), "ticker", "cutoff"]).filter(F.col("rn") <= top).drop("rn", "n", "_o")
    both = one.unionByName(two).withColumn("k", F.row_number().over(Window.partitionBy("bucket", "ticker").orderBy("cutoff"))).filter("k = 1")
    return both.groupBy("bucket").agg(F.count("*").alias("names"), F.round(F.avg("realized"), 6).alias("mean"))


def base_rate(rows: DataFrame, bar: float = 20.0) -> DataFrame:
    """(qualifying, sustained, everyone): rows over ``bar`` a year so far, the percent of them that went on to make it a
    year of two, and the percent of all that did."""
    kept = F.col("realized") >= ((1 + bar / 100) ** 2 - 1) * 100
    over = F.col("cagr_life") >= bar
    return rows.agg(F.count_if(over).alias("qualifying"), F.round(100 * F.avg(F.when(over, kept.cast("double"))), 6).alias("sustained"), F.round(100 * F.avg(kept.cast("double")), 6).alias("everyone"))


def _carried(days: DataFrame, series: DataFrame, later: bool) -> DataFrame:
    """(day, px): the first price on or after each day, or the last on or before it; ``series`` (day, px) has a row a date."""
    rows = series.select("day", "px", F.lit(0).alias("side")).union(days.select("day", F.lit(None).cast("double"), F.lit(1)).distinct())
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("day") if later else F.asc("day"), "side")  # a row a date on either side
    return rows.withColumn("px", F.last("px", ignorenulls=True).over(w)).filter("side = 1").select("day", "px")


def benchmark_at(days: DataFrame, benchmark: DataFrame, years: int = 2) -> DataFrame:
    """(cutoff, forward, trailing, drawdown), in percent: what the benchmark does from the first bar on or after each day to the first
    ``years`` later, what it did from ``years`` before as of both ends, and how far below its high it is; null where an end is missing."""
    day = F.unix_date("cutoff")
    series = benchmark.filter("close > 0").select(F.unix_date("bar_date").alias("day"), F.col("close").cast("double").alias("px"))
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    fall = series.select("day", (100 * (F.col("px") / F.max("px").over(w) - 1)).alias("px"))
    asks = days.select("cutoff").distinct()

    def at(shift: int, rows: DataFrame, later: bool, name: str) -> DataFrame:
        return _carried(asks.select((day + shift).alias("day")), rows, later).select((F.col("day") - shift).alias("d"), F.col("px").alias(name))

    told = asks.withColumn("d", day)
    for part in (at(0, series, True, "a"), at(365 * years, series, True, "b"), at(-365 * years, series, False, "p"), at(0, series, False, "q"), at(0, fall, False, "dd")):
        told = told.join(part, "d", "left")
    change = lambda x, y: F.round(100 * (F.col(y) / F.col(x) - 1), 6)
    return told.select("cutoff", change("a", "b").alias("forward"), change("p", "q").alias("trailing"), F.round("dd", 6).alias("drawdown"))


def against_index(rows: DataFrame, benchmark: DataFrame, years: int = 2, top: int = 10) -> DataFrame:
    """(n, p_below_index, p_loss, best_in_top): share of books that end below the benchmark, and below what they began with; and in
    how many buckets the first in rank beat the mean of those that follow it in the book."""
    book = book_multiples(rows, top)
    both = book.join(benchmark_at(book.select(F.col("start").alias("cutoff")), benchmark, years).select(F.col("cutoff").alias("start"), (1 + F.col("forward") / 100).alias("index")), "start")
    ranked = placed(rows, "bucket", [F.desc("score"), "ticker", "cutoff"]).filter(F.col("rn") <= top)
    first = ranked.groupBy("bucket").agg(F.max(F.when(F.col("rn") == 1, F.col("realized"))).alias("first"), F.avg(F.when(F.col("rn") > 1, F.col("realized"))).alias("others"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return both.join(first, "bucket").agg(F.count("*").alias("n"), share(F.col("multiple") < F.col("index")).alias("p_below_index"), share(F.col("multiple") < 1).alias("p_loss"), F.count_if(F.col("first") > F.col("others")).alias("best_in_top"))


def trails(bars: DataFrame, n: int = 36) -> DataFrame:
    """(ticker, cutoff, trail): the returns of the last ``n`` bars up to each one, newest first; those from or to a price that isn't positive are left out."""
    prev, close = F.lag("close").over(by_date()), F.col("close")
    rows = bars.withColumn("good", F.when((prev > 0) & (close > 0), (close / prev - 1) * 100))
    return rows.select("ticker", F.col("bar_date").alias("cutoff"), F.reverse(F.collect_list("good").over(by_date().rowsBetween(1 - n, 0))).alias("trail"))


def asked_trails(rows: DataFrame, trail: DataFrame) -> DataFrame:
    """The trails at the cutoffs of ``rows``: a ticker's trails are where its bars are, and those that nobody asks for aren't shuffled."""
    cuts = rows.groupBy("ticker").agg(F.collect_set("cutoff").alias("_cuts"))
    return trail.join(cuts, "ticker").filter(F.array_contains("_cuts", F.col("cutoff"))).drop("_cuts")


def decorrelated(rows: DataFrame, trail: DataFrame, caps: list[float], top: int = 10) -> DataFrame:
    """(bucket, cap, rn, id): each half-year's book under each cap on the correlation of its names; see ``greedy``."""
    rows = written(rows.select("ticker", "cutoff", "bucket", "score"))
    ranked = rows.join(asked_trails(rows, trail), ["ticker", "cutoff"]).select("bucket", F.concat_ws(":", "ticker", F.col("cutoff").cast("string")).alias("id"), "score", "trail")
    return greedy(ranked, caps, top)


def capped_books(rows: DataFrame, trail: DataFrame, benchmark: DataFrame, caps: list[float], years: int = 2, top: int = 10) -> DataFrame:
    """(cap, buckets, book, index, excess, win_pct, worst, early, late): the books that each cap leaves, refilled from below, against the
    benchmark, in percent a year; early and late are the excess of both halves of the buckets."""
    rows = written(rows.select("ticker", "cutoff", "bucket", "score", "realized"))
    kept = decorrelated(rows, trail, caps, top)
    named = rows.select("bucket", F.concat_ws(":", "ticker", F.col("cutoff").cast("string")).alias("id"), "realized", "cutoff")
    book = kept.join(named, ["bucket", "id"]).groupBy("cap", "bucket").agg(F.avg(1 + F.col("realized") / 100).alias("multiple"), F.min("cutoff").alias("start"))
    index = benchmark_at(book.select(F.col("start").alias("cutoff")), benchmark, years).select(F.col("cutoff").alias("start"), (1 + F.col("forward") / 100).alias("to"))
    yearly = lambda m: (F.pow(F.greatest(m, F.lit(0.0)), 1.0 / years) - 1) * 100
    both = book.join(index, "start").select("cap", "bucket", yearly(F.col("multiple")).alias("book"), yearly(F.col("to")).alias("index")).filter("index IS NOT NULL")
    w = Window.partitionBy("cap")  # a row a half-year
    both = both.withColumns({"rn": F.row_number().over(w.orderBy("bucket")), "m": F.count("*").over(w), "excess": F.col("book") - F.col("index")})
    early = F.col("rn") <= F.floor(F.col("m") / 2)
    mean = lambda c: F.round(F.avg(c), 4)
    return both.groupBy("cap").agg(
        F.count("*").alias("buckets"), mean("book").alias("book"), mean("index").alias("index"), mean("excess").alias("excess"), mean((F.col("excess") > 0).cast("double") * 100).alias("win_pct"), F.round(F.min("book"), 4).alias("worst"),
        mean(F.when(early, F.col("excess"))).alias("early"), mean(F.when(~early, F.col("excess"))).alias("late"),
    )
