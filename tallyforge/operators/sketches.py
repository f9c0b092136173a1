"""Approximate aggregates that merge: sketches of days, put together to weeks without going back to the rows.

Distinct users by HyperLogLog, quantiles by KLL. A day's sketch has a fixed size, so a table of sketches by day is what later
reports read, however many events a day has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 12  #: the sketch of users has 2 ** LG slots: a relative error of about 1.04 / 2 ** (LG / 2)
RANK_ERROR = 0.0265  #: of a quantile's place, for the default size, at 99 % confidence


def daily(events: DataFrame) -> DataFrame:
    """(day, users, amounts): the sketches of each day of (ts, user_id, value)."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", F.lit(LG)).alias("users"), F.expr("kll_sketch_agg_double(value)").alias("amounts"))


def merged(days: DataFrame, into: Column) -> DataFrame:
    """(period, users, median, p90): what the days' sketches say of each period."""
    both = days.groupBy(into.alias("period")).agg(F.hll_union_agg("users").alias("users"), F.expr("kll_merge_agg_double(amounts)").alias("amounts"))
    at = lambda q: F.expr(f"kll_sketch_get_quantile_double(amounts, CAST({q} AS DOUBLE))")
    return both.select("period", F.hll_sketch_estimate("users").alias("users"), at(0.5).alias("median"), at(0.9).alias("p90"))


def checked(events: DataFrame, into: Column, told: DataFrame) -> DataFrame:
    """(period, n, users, users_near, median_near, p90_near): the exact counts, and whether the sketches' answers lie within their bounds. A
    quantile is near if its place among the values is."""
    rows = events.select(into.alias("period"), "user_id", "value").join(told.withColumnRenamed("users", "guess"), "period")
    off = lambda q, name: F.abs(F.avg((F.col("value") <= F.col(name)).cast("double")) - q) <= RANK_ERROR + 1 / F.count("*")
    users = F.countDistinct("user_id")
    return rows.groupBy("period").agg(F.count("*").alias("n"), users.alias("users"), (F.abs(F.max("guess") - users) <= F.greatest(F.lit(1.0), 4 * 1.04 / 2 ** (LG / 2) * users)).alias("users_near"), off(0.5, "median").alias("median_near"), off(0.9, "p90").alias("p90_near"))
