"""Run-to-run operators over the daily journal (day, rank, ticker, px): grading, leaders, trends, books, paper savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days(journal: DataFrame) -> DataFrame:
    """(day, k, n): the days of the journal, numbered; a table of one row a day."""
    each = journal.select("day").distinct()
    w = Window.partitionBy(F.lit(1))
    return each.withColumns({"k": F.row_number().over(w.orderBy("day")), "n": F.count("*").over(w)})


def append_once(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the snapshots of ``new`` for days that it lacks: a second run on a day keeps the first snapshot."""
    return old.unionByName(new.join(old.select("day").distinct(), "day", "left_anti"))


def restate(journal: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices over the product of the split ratios that took effect after their day."""
    later = journal.join(splits, (journal["ticker"] == splits["s_ticker"]) & (F.col("eff_date") > F.col("day")), "left")
    return later.groupBy("day", "rank", journal["ticker"]).agg(F.max("px").alias("px"), F.coalesce(F.product("ratio"), F.lit(1.0)).alias("factor")).select("day", "rank", "ticker", F.round(F.col("px") / F.col("factor"), 6).alias("px"))


def grade(journal: DataFrame, now: DataFrame, index: DataFrame, top: int = 10) -> DataFrame:
    """(day, n, ret, excess): equal-weight return of a past day's ``top`` to the prices ``now`` (ticker, px_now), and that
    less the index's (day, level, level_now); names without a price are left out and n says how many remain."""
    held = journal.filter((F.col("rank") <= top) & (F.col("px") > 0)).join(now, "ticker").join(index, "day")
    one = held.groupBy("day").agg(F.count("*").alias("n"), F.avg(F.col("px_now") / F.col("px") - 1).alias("r"), F.max(F.col("level_now") / F.col("level") - 1).alias("i"))
    return one.select("day", "n", F.round(100 * F.col("r"), 6).alias("ret"), F.round(100 * (F.col("r") - F.col("i")), 6).alias("excess"))


def summary(grades: DataFrame) -> DataFrame:
    return grades.agg(F.count("*").alias("n"), F.count_if(F.col("excess") > 0).alias("wins"), F.round(F.sum("excess"), 4).alias("sum_excess"))


def leaders(journal: DataFrame, share: float = 0.8) -> DataFrame:
    """(ticker, n): tickers that are in at least ``share`` of the days."""
    total = F.broadcast(days(journal).agg(F.count("*").alias("total")).withColumn("one", F.lit(1)))
    seen = journal.groupBy("ticker").agg(F.countDistinct("day").alias("n")).withColumn("one", F.lit(1)).join(total, "one")
    return seen.filter(F.col("n") >= share * F.col("total")).select("ticker", "n")


def rank_trend(journal: DataFrame, band: float = 1.0, least: int = 3) -> DataFrame:
    """(ticker, n, mean_rank, early, late, trend): mean rank of the first half of a ticker's days (rounded down) and the
    rest; it moves when these differ by more than ``band``."""
    w = Window.partitionBy("ticker")
    rows = journal.withColumns({"k": F.row_number().over(w.orderBy("day")), "n": F.count("*").over(w)}).filter(F.col("n") >= least)
    first = F.col("k") <= F.floor(F.col("n") / 2)
    one = rows.groupBy("ticker", "n").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg(F.when(first, F.col("rank"))), 6).alias("early"), F.round(F.avg(F.when(~first, F.col("rank"))), 6).alias("late"))
    return one.withColumn("trend", F.when(F.col("late") < F.col("early") - band, "up").when(F.col("late") > F.col("early") + band, "down").otherwise("flat"))


def stability(journal: DataFrame, top: int = 10) -> DataFrame:
    """(stability): mean overlap of consecutive days' books over the smaller of the two."""
    books = journal.filter(F.col("rank") <= top).groupBy("day").agg(F.collect_set("ticker").alias("held"))
    rows = books.withColumn("was", F.lag("held").over(Window.partitionBy(F.lit(1)).orderBy("day"))).filter("was IS NOT NULL")
    return rows.agg(F.round(F.avg(F.size(F.array_intersect("held", "was")) / F.least(F.size("held"), F.size("was"))), 6).alias("stability"))


def membership_diff(journal: DataFrame) -> DataFrame:
    """(day, ticker, change): + for names that the day before lacked, - for names that left; silent on the first day."""
    named = journal.select("day", "ticker").join(days(journal).select("day", "k", "n"), "day")
    now = named.select("k", "ticker").withColumn("here", F.lit(True))
    was = named.filter("k < n").select((F.col("k") + 1).alias("k"), "ticker").withColumn("there", F.lit(True))
    both = now.join(was, ["k", "ticker"], "full").filter("k > 1 AND (here IS NULL OR there IS NULL)")
    return both.join(days(journal).select("k", "day"), "k").select("day", "ticker", F.when(F.col("here").isNull(), "-").otherwise("+").alias("change"))


def paper_savings(journal: DataFrame, base: float = 100.0, fee: float = 1.0, top: int = 5, period: str = "month") -> DataFrame:
    """(ticker, lots, qty, cost): the budget of each ``period`` (month or week), split evenly over its first snapshot's ``top``
    that have a price, less a fee a lot; a period without any passes its budget on."""
    first = journal.groupBy(F.date_trunc(period, "day").cast("date").alias("period")).agg(F.min("day").alias("day"))
    picks = journal.filter((F.col("rank") <= top) & (F.col("px") > 0)).join(first, "day")
    counts = picks.groupBy("period").agg(F.count("*").alias("names"))
    every = first.agg(F.explode(F.sequence(F.min("period"), F.max("period"), F.expr(f"interval 1 {period}"))).alias("period"))
    w = Window.partitionBy(F.lit(1)).orderBy("period")
    told = every.join(counts, "period", "left").withColumn("k", F.row_number().over(w))
    told = told.withColumn("last", F.max(F.when(F.col("names") > 0, F.col("k"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    budget = told.filter("names > 0").withColumn("alloc", base * (F.col("k") - F.coalesce("last", F.lit(0))) / F.col("names"))
    lots = picks.join(budget.select("period", "alloc"), "period").filter(F.col("alloc") > fee)
    return lots.groupBy("ticker").agg(F.count("*").alias("lots"), F.round(F.sum((F.col("alloc") - fee) / F.col("px")), 6).alias("qty"), F.round(F.sum("alloc"), 4).alias("cost"))


def dip_alerts(journal: DataFrame, fall: float = 0.3) -> DataFrame:
    """(ticker, day): days on which a ticker enters a dip, ``fall`` or more below its running high; none while it lasts."""
    w = Window.partitionBy("ticker").orderBy("day")
    rows = journal.withColumn("high", F.max("px").over(w)).withColumn("dip", F.col("px") <= (1 - fall) * F.col("high"))
    return rows.withColumn("was", F.lag("dip").over(w)).filter("dip AND NOT coalesce(was, false)").select("ticker", "day")


def market_state(drawdown: Column) -> Column:
    """By percent below the high: near it, in a pullback (5 and more), in a bear market (15 and more). Missing is near."""
    return F.when(drawdown <= -15, "BEAR").when(drawdown <= -5, "PULLBACK").otherwise("NEAR-HIGH")


def state_flips(levels: DataFrame) -> DataFrame:
    """(day, was, state): days on which the market's state changes; ``levels`` has a row a day (day, level)."""
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    rows = levels.withColumn("state", market_state(100 * (F.col("level") / F.max("level").over(w) - 1))).withColumn("was", F.lag("state").over(w))
    return rows.filter("was IS NOT NULL AND was <> state").select("day", "was", "state")


def deploy_multiplier(state: Column) -> Column:
    return F.when(state == "BEAR", 2.0).when(state == "PULLBACK", 1.5).otherwise(1.0)


def savings_gain(years: Column, ladder: list[tuple[int, float]], base: float) -> Column:
    """Percent gained over ``years`` years at ``base`` and the ladder's premium (from year, percent) of each year."""
    premium = lambda y: F.aggregate(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(p).alias("p")) for f, p in ladder]), F.lit(0.0), lambda s, x: F.when(x["f"] <= y, x["p"]).otherwise(s))
    return (F.aggregate(F.sequence(F.lit(1), years), F.lit(1.0), lambda s, y: s * (1 + (base + premium(y)) / 100)) - 1) * 100
