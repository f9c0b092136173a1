"""Queries of inflation and real returns, and their SQL. Price levels are the mean order and the mean line of each year."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import inflation as I
from tallyforge.operators.series import HORIZONS
from tallyforge.plans.series_queries import SQL as SERIES
from tallyforge.sources import tables as T

TODAY = "2001-11-01"


def _live(s, d):
    level = F.round(F.avg(F.col("o_totalprice").cast("decimal(18,4)")).cast("double"), 6)
    return I.yearly_rates(T.table(s, d, "orders").filter("o_orderdate >= '1997-01-01'").groupBy(F.year("o_orderdate").alias("year")).agg(level.alias("level")))


def _archive(s, d):
    level = F.round(F.avg(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double"), 6)
    return I.yearly_rates(T.table(s, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(level.alias("level")))


def _series(s, d):
    return I.merged(_live(s, d), _archive(s, d))


QUERIES = {
    "inflation_merge": _series,
    "inflation_stale": lambda s, d: I.stale_since(_series(s, d), F.lit(TODAY).cast("date")),
    "inflation_index": lambda s, d: I.deflators(_series(s, d)).select("years", F.round("inflation", 6).alias("inflation")),
    "inflation_stats": lambda s, d: I.summary(_series(s, d), 3, 10),
    "horizon_real": lambda s, d: I.real_horizons(T.bars(s, d), _series(s, d)),
    "life_return_real": lambda s, d: I.real_life(T.bars(s, d), T.dividends(s, d), _series(s, d)),
}


def _rates(name: str, source: str) -> str:
    return f"{name} AS (SELECT year, round((level / lag(level) OVER (ORDER BY year) - 1) * 100, 6) AS rate FROM ({source})), {name}r AS (SELECT * FROM {name} WHERE rate IS NOT NULL)"


_SERIES = (
    _rates("live", "SELECT year(o_orderdate)::INT AS year, round(avg(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE, 6) AS level FROM orders WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1")
    + ", "
    + _rates("arch", "SELECT year(l_shipdate)::INT AS year, round(avg(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE, 6) AS level FROM lineitem GROUP BY 1")
    + ", rates AS (SELECT year, coalesce(liver.rate, archr.rate) AS rate FROM liver FULL JOIN archr USING (year) WHERE EXISTS (SELECT 1 FROM liver))"
)
_INDEX = (
    _SERIES
    + """, ix AS (SELECT row_number() OVER (ORDER BY year DESC) AS years, (exp(sum(ln(1 + rate / 100)) OVER (ORDER BY year DESC)) - 1) * 100 AS inflation, count(*) OVER () AS n FROM rates),
dfl AS (SELECT years, inflation FROM ix UNION ALL SELECT n + 1, inflation FROM ix WHERE years = n)"""
)
_DAYS = ", ".join(f"('{h}', {d})" for h, d in HORIZONS.items())
_REAL = "round(coalesce(((1 + {x} / 100) / (1 + inflation / 100) - 1) * 100, {x}), 6) AS real"

SQL = {
    "inflation_merge": f"WITH {_SERIES} SELECT year, rate FROM rates",
    "inflation_stale": f"WITH {_SERIES} SELECT max(year) AS latest, month(DATE '{TODAY}') >= 3 AND max(year) < year(DATE '{TODAY}') AS stale FROM rates",
    "inflation_index": f"WITH {_INDEX} SELECT years::INT AS years, round(inflation, 6) AS inflation FROM dfl",
    "inflation_stats": f"""WITH {_SERIES}, r AS (SELECT *, row_number() OVER (ORDER BY year DESC) AS b FROM rates)
SELECT max(year) AS latest, round(arg_max(rate, year), 6) AS rate, round(avg(rate) FILTER (WHERE b <= 3), 6) AS mean_short, round(avg(rate) FILTER (WHERE b <= 10), 6) AS mean_long,
  round(CASE WHEN count(*) + 1 >= 3 THEN (product(1 + rate / 100) FILTER (WHERE b <= 3) - 1) * 100 END, 6) AS compounded FROM r""",
    "horizon_real": f"""WITH {_INDEX}, hz(horizon, days) AS (VALUES {_DAYS}), c AS ({SERIES["horizon_changes"]})
SELECT ticker, horizon, change, {_REAL.format(x="change")} FROM c JOIN hz USING (horizon) LEFT JOIN dfl ON days >= 365 AND years = days // 365""",
    "life_return_real": f"""WITH {_INDEX}, c AS ({SERIES["series_growth"]})
SELECT ticker, age_years, life_return, {_REAL.format(x="life_return")} FROM c LEFT JOIN dfl ON years = floor(age_years + 0.5)""",
}
