"""A table function with a partitioned table argument: a series' own cutoffs from its dates."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf


@udtf(returnType="ticker string, cutoff date, i int, cadence int")
class Cutoffs:
    """Takes one series' (ticker, bar_date) rows in order of date. The walk's cadence is the series' own, so its dates are kept until the
    last one, which are no more than its trading days."""

    def __init__(self):
        self.ticker, self.dates = None, []

    def eval(self, row):
        self.ticker = row["ticker"]
        self.dates.append(row["bar_date"])

    def terminate(self) -> Iterator[tuple[str, date, int, int]]:
        n = len(self.dates)
        span = (self.dates[-1] - self.dates[0]).days
        a_year = (n - 1) * 365.25 / span if span else 0.0
        cadence, history, step = (max(1, int(a_year * k + 0.5)) for k in (1.0, 3.0, 0.5))
        for i in range(history, n, step):
            yield self.ticker, self.dates[i], i, cadence


def cutoffs(bars: DataFrame) -> DataFrame:
    """(ticker, cutoff, i, cadence): each series' walk, by the table function."""
    spark = bars.sparkSession
    spark.udtf.register("series_cutoffs", Cutoffs)
    return spark.sql("SELECT * FROM series_cutoffs(TABLE(SELECT ticker, bar_date FROM {bars}) PARTITION BY ticker ORDER BY bar_date)", bars=bars)
