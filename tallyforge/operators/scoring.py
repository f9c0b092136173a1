"""Gates and score: explainable refusals as an array of tags, and a weighted score of what passes all gates.

A missing value passes its gate. The score is a sum of capped legs times damping factors; the curve of the
overextension brake between its ends is linear, which is our choice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ranks import average_ranks, running


@dataclass(frozen=True)
class Knobs:
    min_age: float = 4.0
    min_range: float = 5.0
    min_cagr: float = -35.0
    max_drawdown: float = 99.5
    max_above_ma: float = 150.0
    max_volatility: float = 600.0
    min_turnover: float = 1000.0
    cagr_cap: float = 30.0
    sharpe_weight: float = 2.0
    sharpe_cap: float = 3.0
    calmar_weight: float = 2.0
    calmar_cap: float = 3.0
    smooth_weight: float = 5.0
    trend_weight: float = 1.0
    proximity: float = 1.0
    brake_floor: float = 0.5
    liquidity_weight: float = 0.1


def gates(k: Knobs) -> dict[str, Column]:
    """By tag, when a row fails."""
    return {
        "young": F.col("age_years") < k.min_age,
        "range": F.col("pct_rank") < k.min_range,
        "cagr": F.col("life_cagr") < k.min_cagr,
        "maxdd": F.col("max_drawdown") > k.max_drawdown,
        "stretch": F.col("above_ma") > k.max_above_ma,
        "vol": F.col("volatility") > k.max_volatility,
        "turnover": F.col("avg_turnover") < k.min_turnover,
    }


def failed(k: Knobs) -> Column:
    """Tags of the gates that a row fails, in order; empty if it clears them all."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(tag)) for tag, bad in gates(k).items()]))


def score(k: Knobs) -> Column:
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    legs = (
        k.trend_weight * F.least(F.col("life_cagr"), F.lit(k.cagr_cap))
        + k.sharpe_weight * F.least(ratio(F.col("life_cagr"), F.col("volatility")), F.lit(k.sharpe_cap))
        + k.calmar_weight * F.least(ratio(F.col("life_cagr"), F.col("max_drawdown")), F.lit(k.calmar_cap))
        + k.smooth_weight * F.coalesce("trend_r2", F.lit(0.0))
    )
    near = F.greatest(F.lit(0.0), 1 + k.proximity * (F.col("pct_rank") / 100 - 1))
    brake = 1 - (1 - k.brake_floor) * F.least(F.col("above_ma") / k.max_above_ma, F.lit(1.0))
    trust = F.when(F.col("age_years") >= 10, 1.0).otherwise(0.5)
    return legs * near * F.sqrt(trust * brake) + k.liquidity_weight * F.log(F.greatest(F.col("avg_turnover"), F.lit(1.0)) / 1e9)


def screen(quotes: DataFrame, k: Knobs = Knobs(), top: int = 10, by: str = "market") -> DataFrame:
    """The ``top`` rows by score of each ``by``, of those that clear all gates."""
    told = quotes.withColumn("failed", failed(k)).filter(F.size("failed") == 0).withColumn("score", F.round(score(k), 6))
    w = Window.partitionBy(by).orderBy(F.desc("score"), "ticker")
    return told.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select(by, "place", "ticker", "score")


def funnel(quotes: DataFrame, k: Knobs, by: str) -> DataFrame:
    """(by, gate, n_failed, n_sole): rows that fail each gate, and those that fail it alone."""
    told = quotes.withColumn("failed", failed(k))
    return told.select(by, F.explode("failed").alias("gate"), (F.size("failed") == 1).alias("sole")).groupBy(by, "gate").agg(F.count("*").alias("n_failed"), F.count_if("sole").alias("n_sole"))


def gate_combinations(quotes: DataFrame, k: Knobs) -> DataFrame:
    """(gates, n): how often each set of two or more gates fails together."""
    told = quotes.withColumn("failed", failed(k)).filter(F.size("failed") >= 2)
    return told.groupBy(F.array_join(F.array_sort("failed"), "+").alias("gates")).agg(F.count("*").alias("n"))


def sizes(rows: DataFrame, budgets: DataFrame, name_cap: float, passes: int = 5, sector_cap: float | None = None, sector_class: str | None = None) -> DataFrame:
    """(ticker, weight): score over volatility within class budgets, scaled to the classes present; what a name has over
    ``name_cap`` goes to the others of its class, ``passes`` times, and what is left stays unallocated. With a ``sector_cap``, after each
    pass the sectors of ``sector_class`` that are over it are scaled down to it and take no more, so that what they give
    up goes to names elsewhere in the class, which the next pass caps in turn. At the end both caps hold."""
    own, sector = Window.partitionBy("class"), Window.partitionBy("class", "sector")
    rows = rows.join(F.broadcast(budgets), "class").filter("score > 0 AND volatility > 0").withColumn("raw", F.col("score") / F.col("volatility"))
    present = rows.select("class", "budget").distinct().agg(F.sum("budget").alias("all")).withColumn("one", F.lit(1))
    rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(present), "one").withColumn("room", F.col("budget") / F.col("all"))
    rows = rows.withColumns({"weight": F.lit(0.0), "full": F.lit(False)})
    for _ in range(passes):
        free = (F.col("weight") < name_cap) & ~F.col("full")
        rows = rows.withColumns({"left": F.col("room") - F.sum("weight").over(own), "base": F.sum(F.when(free, F.col("raw"))).over(own)})
        rows = rows.withColumn("weight", F.when(free, F.least(F.lit(name_cap), F.col("weight") + F.coalesce(F.try_divide(F.col("left") * F.col("raw"), F.col("base")), F.lit(0.0)))).otherwise(F.col("weight")))
        if sector_cap:
            rows = rows.withColumn("sum", F.sum("weight").over(sector)).withColumn("over", (F.col("class") == sector_class) & (F.col("sum") > sector_cap))
            rows = rows.withColumns({"weight": F.when(F.col("over"), F.col("weight") * sector_cap / F.col("sum")).otherwise(F.col("weight")), "full": F.col("full") | F.col("over")})
    return rows.select("ticker", "class", F.round("weight", 6).alias("weight"))


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile, by rational functions of the middle and of both tails (Acklam's; relative error under 1.2e-9)."""
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def horner(x: Column, terms: tuple) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    low = 0.02425
    middle = (p - 0.5) * horner((p - 0.5) * (p - 0.5), a) / horner((p - 0.5) * (p - 0.5), b)
    tail = lambda q: horner(F.sqrt(-2 * F.log(q)), c) / horner(F.sqrt(-2 * F.log(q)), d)
    return F.when((p <= 0) | (p >= 1), F.lit(None)).when(p < low, tail(p)).when(p > 1 - low, -tail(1 - p)).otherwise(middle)


def neutral_scores(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(ticker, by, rank, z): each name's place among those of its group, as a normal quantile of (rank - 1/2) / n; equal values share
    the mean of their ranks. Groups may be larger than a task (``average_ranks``)."""
    told = average_ranks(rows.filter(F.col(value).isNotNull()), [by], value, "rank").join(rows.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n")), by)
    return told.select("ticker", by, "rank", F.round(inverse_normal((F.col("rank") - 0.5) / F.col("n")), 6).alias("z"))


def robustness(quotes: DataFrame, arms: DataFrame) -> DataFrame:
    """(ticker, median_rank, iqr): a ticker's rank over arms (arm, a, b, c) that perturb three weights."""
    each = quotes.withColumn("one", F.lit(1)).join(F.broadcast(arms.withColumn("one", F.lit(1))), "one").drop("one")  # a few arms
    told = each.withColumn("s", F.round(F.col("a") * F.col("life_cagr") + F.col("b") * F.col("pct_rank") - F.col("c") * F.col("max_drawdown"), 6)).select("ticker", "arm", "s")
    ranked = running(told, ["arm"], [F.desc("s"), F.col("ticker")]).withColumnRenamed("upto", "rank")
    p = lambda q: F.percentile("rank", F.lit(q))
    return ranked.groupBy("ticker").agg(p(0.5).alias("median_rank"), (p(0.75) - p(0.25)).alias("iqr"))
