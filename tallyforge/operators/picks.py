"""All gates, the growth and on-sale scores with their legs, damps and brakes, and what is done to a ranking afterwards.

A quote has the series measures, horizon returns (``ret_1m`` and so on), factors and its class (0 coin, 1 fund, 2 stock). A
missing value passes its gate, but a quote without any leg of five years or more fails ``history``. Defaults are the
shipped values where evidence gives them; others are off or neutral.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.decorrelate import greedy

LEGS = {"20y": 20, "8y": 8, "5y": 5}  #: the longest that a quote has counts
NO_LIMIT = 1e18


@dataclass(frozen=True)
class Limits:
    young: float = 4.0
    range: float = 80.0
    cagr: float = 19.0
    cagr_life: float = 0.0
    floor_1y: float = 0.0
    floor_5y: float = 0.0
    floor_8y: float = 0.0
    drop_1m: float = 30.0
    maxdd: float = 84.0
    stretch: float = 150.0
    vol_coin: float = NO_LIMIT
    vol: float = NO_LIMIT
    daily: float = NO_LIMIT
    aum: float = 0.0
    peg: float = 0.0  #: least growth-scaled earnings yield
    margin: float = -NO_LIMIT
    swing: float = NO_LIMIT
    dilution: float = NO_LIMIT
    cover: float = -NO_LIMIT
    fcf: float = -NO_LIMIT
    cash: float = -NO_LIMIT
    mvrv: float = NO_LIMIT
    turnover: float = 0.0


@dataclass(frozen=True)
class Weights:
    trend: float = 0.15
    trend_cap: float = 30.0
    accel: float = 0.5
    accel_beta: float = 1.0
    accel_cap: float = 50.0
    sharpe: float = 2.0
    calmar: float = 2.0
    ratio_cap: float = 3.0
    quality: float = 0.15
    quality_cap: float = 40.0
    dividend: float = 0.5
    dividend_cap: float = 6.0
    keep_eu: float = 0.76
    keep_other: float = 0.72
    fund: float = 0.07
    fund_cap: float = 300.0
    roic: float = 0.25
    roic_cap: float = 40.0
    roic_neutral: float = 17.3
    smooth: float = 5.0
    underwater: float = 0.1
    proximity: float = 1.0
    value: float = 0.0
    ref_pe: float = 20.0
    trust_short: float = 0.5
    brake_floor: float = 0.5
    brake_cap: float = 150.0
    liquidity: float = 0.1


def long_leg(field: str) -> Column:
    """Of the longest leg that a quote has: its ``years``, or its yearly growth (``cagr``)."""
    out = F.lit(None).cast("double")
    for name, years in reversed(LEGS.items()):
        ret = F.col(f"ret_{name}")
        out = F.when(ret.isNotNull(), F.lit(float(years)) if field == "years" else (F.pow(F.greatest(1 + ret / 100, F.lit(1e-9)), 1.0 / years) - 1) * 100).otherwise(out)
    return out


def gates(k: Limits) -> dict[str, Column]:
    """By tag, when a quote fails, in the order of the evidence for them."""
    c, coin, fund, stock = F.col, F.col("class") == 0, F.col("class") == 1, F.col("class") == 2
    return {
        "young": c("age_years") < k.young, "range": c("pct_rank") < k.range, "cagr": long_leg("cagr") < k.cagr, "cagr-life": F.coalesce("capped_cagr", "life_cagr") < k.cagr_life, "1Y+": c("ret_1y") <= k.floor_1y, "5Y+": c("ret_5y") <= k.floor_5y,
        "8Y+": c("ret_8y") <= k.floor_8y, "1M": c("ret_1m") < -k.drop_1m, "history": long_leg("years").isNull(), "maxdd": c("max_drawdown") > k.maxdd, "stretch": c("above_ma") > k.stretch, "uptrend": c("life_return") <= 0,
        "vol-coin": coin & (c("volatility") > k.vol_coin), "vol": ~coin & (c("volatility") > k.vol), "daily": ~coin & (c("max_daily") > k.daily), "aum": fund & (c("aum") < k.aum), "peg": stock & ((c("peg_yield") < k.peg) | (c("eps") <= 0)), "no-eps": stock & c("eps_never"),
        "margin": stock & (c("net_margin") < k.margin), "swing": stock & (-c("margin_stability") > k.swing), "dilution": stock & (-c("buyback") > k.dilution), "cover": stock & (c("interest_cover") < k.cover), "fcf": stock & (c("fcf_margin") < k.fcf), "cash": stock & (c("net_cash_rev") < k.cash),
        "mvrv": coin & (c("mvrv") > k.mvrv), "turnover": c("avg_turnover") < k.turnover,
    }


def failed(k: Limits) -> Column:
    """Tags of the gates that a quote fails, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(tag)) for tag, bad in gates(k).items()]))


def refusal(name: Column) -> Column:
    """Why a quote isn't looked at, whatever its measures: leveraged, a stablecoin, or a physical commodity; null if it is."""
    low = F.lower(name)
    return F.when(low.rlike(r"leveraged|\b[23]x\b|ultrashort|inverse"), "leveraged").when(low.rlike(r"usd coin|tether|\bdai\b|stablecoin"), "stablecoin").when(low.rlike(r"physical (gold|silver|platinum|palladium)"), "commodity")


def near_misses(quotes: DataFrame, k: Limits, notch: Limits, top: int = 15) -> DataFrame:
    """(gate, place, ticker): quotes that fail one gate alone and pass it at the ``notch``, the highest range first."""
    told = quotes.withColumns({"failed": failed(k), "gross": failed(notch)}).filter((F.size("failed") == 1) & (F.size("gross") == 0)).withColumn("gate", F.get("failed", F.lit(0)))
    w = Window.partitionBy("gate").orderBy(F.desc("pct_rank"), "ticker")
    return told.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("gate", "place", "ticker")


def clamp(value: Column, cap: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, F.lit(cap)))


def multipliers(w: Weights) -> Column:
    """Proximity to the high, value, and the geometric mean of trust in the leg and the brake above the average."""
    near = F.greatest(F.lit(0.0), 1 + w.proximity * (F.col("pct_rank") / 100 - 1))
    value = 1 + w.value * (F.coalesce(F.greatest(F.lit(0.5), F.least(w.ref_pe * F.col("earnings_yield") / 100, F.lit(1.5))), F.lit(1.0)) - 1)
    trust = F.when(long_leg("years") >= 10, 1.0).otherwise(w.trust_short)
    brake = 1 - (1 - w.brake_floor) * F.least(F.col("above_ma") / w.brake_cap, F.lit(1.0))
    return near * value * F.sqrt(trust * brake)


def damps(ter: Column, yearly_yield: Column, accumulates: Column, tax: float = 0.28, years: int = 20) -> Column:
    """What fees, and the tax inside a fund that accumulates, leave after ``years``."""
    fee = F.coalesce(F.pow(1 - ter / 100, float(years)), F.lit(1.0))
    drag = F.when(F.coalesce(accumulates, F.lit(False)), F.coalesce(F.pow(1 - yearly_yield / 100 * tax, float(years)), F.lit(1.0))).otherwise(1.0)
    return fee * drag


def growth_score(w: Weights) -> Column:
    cagr = long_leg("cagr")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    base = (
        w.trend * F.least(cagr, F.lit(w.trend_cap))
        + w.accel * F.coalesce(clamp(F.col("ret_1y") - w.accel_beta * cagr, w.accel_cap), F.lit(0.0))
        + w.sharpe * F.least(ratio(cagr, F.col("volatility")), F.lit(w.ratio_cap))
        + w.calmar * F.least(ratio(cagr, F.col("max_drawdown")), F.lit(w.ratio_cap))
        + w.quality * clamp(F.coalesce("quality", F.lit(0.0)), w.quality_cap)
        + w.dividend * F.least(F.coalesce("yield_1y", F.lit(0.0)), F.lit(w.dividend_cap)) * F.when(F.col("eu_payer"), w.keep_eu).otherwise(w.keep_other)
        + w.fund * clamp(F.coalesce("peg_yield", F.lit(0.0)), w.fund_cap)
        + w.roic * clamp(F.coalesce("roic", F.lit(w.roic_neutral)), w.roic_cap)
        + w.smooth * F.coalesce("trend_r2", F.lit(0.0))
        - w.underwater * F.coalesce("underwater_years", F.lit(0.0))
    )
    return base * multipliers(w) + w.liquidity * F.log(F.greatest(F.col("avg_turnover"), F.lit(1.0)) / 1e9)


def on_sale_score(w: Weights, cheap: float = 10.0, long_reward: float = 0.5) -> Column:
    """The foil of the backtest: how far below its own history a quote that still grows trades."""
    cagr = long_leg("cagr")
    discount, health = (100 - F.col("pct_rank")) / 100, F.when(cagr > 0, 1.0).otherwise(0.5)
    momentum = F.when(F.col("ret_1m") >= 0, 1.0).otherwise(0.8)
    base = 100 * discount * health * momentum + long_reward * clamp(cagr, w.trend_cap) + cheap * clamp(F.coalesce(F.col("earnings_yield") / 100, F.lit(0.0)), 1.0) + w.dividend * F.least(F.coalesce("yield_1y", F.lit(0.0)), F.lit(w.dividend_cap))
    decline = 1 - F.least(F.col("from_high") / 200, F.lit(0.5))
    trust = F.when(long_leg("years") >= 10, 1.0).otherwise(w.trust_short)
    return base * F.sqrt(decline * trust)


def coin_factor(nupl: Column, ret: Column, btc_ret: Column, euphoria: float = 0.75, floor: float = 0.5, boost: float = 1.2, tilt: float = 0.3) -> Column:
    """The market's mood (linear from ``euphoria`` to ``floor`` at 1, a boost below 0) times the coin's tilt against bitcoin over a
    year: ``tilt`` for each hundred points, between a half and two."""
    mood = F.when(nupl < 0, boost).when(nupl > euphoria, 1 - (1 - floor) * (nupl - euphoria) / (1 - euphoria)).otherwise(1.0)
    return mood * F.greatest(F.lit(0.5), F.least(1 + tilt * F.coalesce((ret - btc_ret) / 100, F.lit(0.0)), F.lit(2.0)))


def refilled(ranked: DataFrame, by: str, top: int, per_sector: int) -> DataFrame:
    """(by, place, ticker, score): the ``top`` of each group with at most ``per_sector`` of a sector and one of each twin (base); the
    next in rank move up into what these leave. Pinned rows stay whatever the limits."""
    order = [F.desc("score"), "ticker"]
    twins = ranked.withColumn("t", F.row_number().over(Window.partitionBy(by, "base").orderBy(F.desc("pinned"), *order))).filter("t = 1 OR pinned")
    few = twins.withColumn("s", F.row_number().over(Window.partitionBy(by, "sector").orderBy(*order))).filter((F.col("s") <= per_sector) | F.col("pinned"))
    return few.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= top).select(by, "place", "ticker", "score")


def without_copies(rows: DataFrame, trails: DataFrame, by: str, cap: float = 0.6, keep: int = 10) -> DataFrame:
    """(by, place, rn, ticker): of each group's names (ticker, by, score) the best ``keep`` of which none moves with a better one at ``cap`` or more, by
    their ``trails`` (ticker, trail, newest first). Names that give way are replaced from below; a name without a trail can't be judged and stays."""
    ranked = rows.join(trails, "ticker", "left").select(F.col(by).alias("bucket"), F.col("ticker").alias("id"), "score", F.coalesce("trail", F.array().cast("array<double>")).alias("trail"))
    kept = greedy(ranked, [cap], keep)
    return kept.select(F.col("bucket").alias(by), F.row_number().over(Window.partitionBy("bucket").orderBy("rn")).alias("place"), "rn", F.col("id").alias("ticker"))  # keep rows a group
