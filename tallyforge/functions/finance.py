"""Small formulas of the backtest and the reports, as column expressions. A missing leg gives null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND_TRIP_BPS = 20.0


def annual(cumulative: Column, years: float) -> Column:
    """Yearly percent of a cumulative one; a total loss is -100."""
    return (F.pow(F.greatest(1 + cumulative / 100, F.lit(0.0)), 1.0 / years) - 1) * 100


def annual_edge(top: Column, bottom: Column, years: float) -> Column:
    return annual(top, years) - annual(bottom, years)


def effective_windows(n: Column, years: int) -> Column:
    """Windows that don't overlap: two half-years a year."""
    return n / (2.0 * max(years, 1))


def cost_points(turnover: Column, years: int) -> Column:
    """Trading cost over the hold: turnover at each rebalance, two a year, at the round-trip rate."""
    return turnover * max(2 * years, 1) * ROUND_TRIP_BPS / 100


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def gap_verdict(mean_a: Column, mean_b: Column, median_a: Column, median_b: Column) -> Column:
    """Which cohort did better; both its mean and its median must be higher."""
    return F.when((mean_a > mean_b) & (median_a > median_b), "first").when((mean_a < mean_b) & (median_a < median_b), "second").otherwise("unclear")


def tax_rate(base: float, years: Column, rungs: list[tuple[float, float]]) -> Column:
    """The rate after the largest exclusion among the rungs (least years, share excluded) that the hold reaches."""
    out = F.greatest(*[F.when(years >= y, share).otherwise(0.0) for y, share in rungs], F.lit(0.0))
    return base * (1 - out)


def after_tax(yearly: Column, years: int, rate_hold: Column, rate_short: Column) -> tuple[Column, Column]:
    """Multiples after tax of never selling until the end, and of selling every year; losses aren't taxed."""
    gain = F.pow(1 + yearly / 100, float(years)) - 1
    held = 1 + gain - F.greatest(gain, F.lit(0.0)) * rate_hold
    each = 1 + yearly / 100 - F.greatest(yearly / 100, F.lit(0.0)) * rate_short
    return held, F.pow(each, float(years))


def profit_zone(nupl: Column) -> Column:
    """Bands of net unrealised profit and loss (fixed values)."""
    return F.when(nupl < 0, "Capitulation").when(nupl < 0.25, "Hope/Fear").when(nupl < 0.5, "Optimism/Anxiety").when(nupl < 0.75, "Belief/Denial").otherwise("Euphoria/Greed")


def implied_growth(price: Column, earnings: Column, discount: float, years: int, terminal_pe: float) -> Column:
    """Yearly growth of earnings over ``years`` that makes today's price their discounted value at a terminal multiple."""
    return F.when((price > 0) & (earnings > 0), (F.pow(price * (1 + discount) ** years / (earnings * terminal_pe), 1.0 / years) - 1) * 100)


def composite(factors: list[Column], least: int = 2) -> Column:
    """Mean of the factors that are there, of which ``least`` must be."""
    present = F.array_compact(F.array(*factors))
    return F.when(F.size(present) >= least, F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present))


def fund_category(name: Column, tiers: list[tuple[str, str]], veto: list[str]) -> Column:
    """The tier of the first keyword that the name has, in order; ``narrow`` if a veto word is there."""
    low = F.lower(name)
    out = F.lit("other")
    for word, tier in reversed(tiers):
        out = F.when(low.contains(word), tier).otherwise(out)
    for word in veto:
        out = F.when(low.contains(word), "narrow").otherwise(out)
    return out


def hold_miss(ter: Column, replication: Column, share_class: Column, aum: Column, max_ter: float = 0.3, min_aum: float = 1e8) -> Column:
    """The first leg that a fund fails as a core holding, null if none; what isn't known passes."""
    return F.when(ter > max_ter, "ter").when(replication == "swap", "replication").when(share_class == "dist", "share class").when(aum < min_aum, "size")
