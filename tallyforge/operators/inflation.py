"""Inflation: yearly rates, what they compound to over the last years, and real returns.

A series of rates has a row a year, so its index, the running product of its rates from the newest year back, is a table of
as many rows, which is looked up by the number of years that a return covers. A return of more years than there are rates
stays nominal; one year is allowed to be missing, since a series of levels loses its first year when it becomes rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.series import HORIZONS, growth_part, horizon_changes, measured, real_pct

GRACE_MONTHS = 3  #: from this month on a series that is alive has the current year (fixed value)


def yearly_rates(levels: DataFrame) -> DataFrame:
    """(year, rate): percent change of each year's level (year, level) over that of the year before, where there is one."""
    w = Window.partitionBy(F.lit(1)).orderBy("year")  # a row a year
    rows = levels.withColumns({"was": F.lag("level").over(w), "before": F.lag("year").over(w)})
    return rows.filter("year - before = 1 AND was <> 0").select("year", F.round((F.col("level") / F.col("was") - 1) * 100, 6).alias("rate"))


def merged(live: DataFrame, archive: DataFrame) -> DataFrame:
    """(year, rate): the live series' rates, and the archive's for years that it lacks; nothing if the live series is empty, since an
    archive mustn't hide that a feed is dead."""
    both = live.withColumnRenamed("rate", "new").join(archive.withColumnRenamed("rate", "old"), "year", "full")
    alive = live.agg((F.count("*") > 0).alias("alive")).withColumn("one", F.lit(1))
    return both.withColumn("one", F.lit(1)).join(F.broadcast(alive), "one").filter("alive").select("year", F.coalesce("new", "old").alias("rate"))


def stale_since(series: DataFrame, today: Column) -> DataFrame:
    """(latest, stale): the series' newest year, and whether the current one should be there by now."""
    return series.agg(F.max("year").alias("latest")).select("latest", ((F.month(today) >= GRACE_MONTHS) & (F.col("latest") < F.year(today))).alias("stale"))


def deflators(series: DataFrame) -> DataFrame:
    """(years, inflation): percent that the last so many years' rates compound to; for one year more than there are rates, all of them."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("year"))  # a row a year
    index = (F.exp(F.sum(F.log(1 + F.col("rate") / 100)).over(w)) - 1) * 100
    rows = series.select(F.row_number().over(w).alias("years"), index.alias("inflation"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    more = F.when(F.col("years") == F.col("n"), F.array(F.col("years"), F.col("years") + 1)).otherwise(F.array("years"))
    return rows.select(F.explode(more).alias("years"), "inflation")


def real_horizons(bars: DataFrame, series: DataFrame, cadence: int = 78) -> DataFrame:
    """(ticker, horizon, change, real): horizons of a year or more less the inflation of their years."""
    days = F.create_map(*[F.lit(x) for pair in HORIZONS.items() for x in pair])
    rows = horizon_changes(bars, cadence).withColumn("years", F.when(days[F.col("horizon")] >= 365, F.floor(days[F.col("horizon")] / 365).cast("int")))
    told = rows.join(F.broadcast(deflators(series)), "years", "left")  # a row a year
    return told.select("ticker", "horizon", "change", F.round(F.coalesce(real_pct(F.col("change"), F.col("inflation")), F.col("change")), 6).alias("real"))


def real_life(bars: DataFrame, dividends: DataFrame, series: DataFrame, cadence: int = 78) -> DataFrame:
    """(ticker, age_years, life_return, real): the return of a whole life less the inflation of its rounded years."""
    lived = measured(bars, [growth_part()], dividends, cadence).select("ticker", "age_years", "life_return", F.floor(F.col("age_years") + 0.5).cast("int").alias("years"))
    told = lived.join(F.broadcast(deflators(series)), "years", "left")
    return told.select("ticker", "age_years", "life_return", F.round(F.coalesce(real_pct(F.col("life_return"), F.col("inflation")), F.col("life_return")), 6).alias("real"))


def summary(series: DataFrame, short: int = 10, long: int = 30) -> DataFrame:
    """(latest, rate, mean_short, mean_long, compounded): of a series of years: the newest rate, the means of the last ``short`` and ``long``, and what
    the last ``short`` compound to, if there are so many but one."""
    w = Window.partitionBy(F.lit(1))
    rows = series.withColumns({"back": F.row_number().over(w.orderBy(F.desc("year"))), "n": F.count("*").over(w)})
    part = lambda k: F.avg(F.when(F.col("back") <= k, F.col("rate")))
    grown = F.when(F.max("n") + 1 >= short, (F.exp(F.sum(F.when(F.col("back") <= short, F.log(1 + F.col("rate") / 100)))) - 1) * 100)
    return rows.agg(F.max("year").alias("latest"), F.round(F.max_by("rate", "year"), 6).alias("rate"), F.round(part(short), 6).alias("mean_short"), F.round(part(long), 6).alias("mean_long"), F.round(grown, 6).alias("compounded"))
