"""Quotes as of a cutoff: every measure of a series from the bars up to that day and no later one.

A series is cut where it jumps (a redenomination, a glued-on record), as far as the cutoff can see: the bars since the last
jump are the slice that its quote is made of. ``quotes`` shuffles bars by ticker once. Measures of the whole slice are
running windows; those of the last bars are one grouping in which each bar goes to the few cutoffs that look back to it;
horizons are differences of running sums as of a day. How many closes of the slice lie below a price is asked of
``count_below``: places are dealt to dyadic blocks, a slice is a few of them, and in each block a price's place among
the closes is known from one sort. So that is n log n rows, where comparing each cutoff to its bars is n times cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.series import DIVIDEND_HORIZONS, ENDPOINT_DAYS, HORIZONS, anchor_half, cagr
from tallyforge.sources.folders import checkpointed

LONG_MA_DAYS = 1000  #: trading days of the long average (fixed value)
ROLLING_STEP = 5  #: bars between the starts of rolling windows (fixed value)
UNKNOWN_TURNOVER = 1e15  #: stands for a turnover that can't be known as of a day, so that no gate on it closes (fixed value)


def count_below(points: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q, below): of the ``points`` (keys, j, value) with j up to ``upto``, those with a value under the question's;
    ``questions`` are rows (keys, q, upto, value). Places j are numbered from 0 without gaps. At level b a place is in block j >> b; the
    places up to L - 1 are one block for each bit of L."""
    levels = lambda n: F.sequence(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))
    block = lambda n, b: F.call_function("shiftright", n, b)
    ends = Window.partitionBy(*keys)
    own = points.withColumn("m", F.max("j").over(ends) + 1).select(*keys, F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value"), F.explode(levels(F.col("m"))).alias("level"))
    placed = own.withColumn("block", block(F.col("j"), F.col("level"))).filter("block % 2 = 0").select(*keys, "level", "block", "value", F.lit(1).alias("side"), F.lit(None).cast("long").alias("q"))
    upto = F.col("upto").cast("long") + 1
    asked = questions.select(*keys, F.col("q").cast("long").alias("q"), upto.alias("upto"), F.col("value").cast("double").alias("value"), F.explode(levels(upto)).alias("level"))
    asked = asked.withColumn("block", block(F.col("upto"), F.col("level")) - 1).filter("block % 2 = 0").select(*keys, "level", "block", "value", F.lit(0).alias("side"), "q")
    sorted_ = Window.partitionBy(*keys, "level", "block").orderBy("value", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.unionByName(asked).withColumn("before", F.sum("side").over(sorted_)).filter("side = 0")
    return met.groupBy(*keys, "q").agg(F.sum("before").alias("below"))


def walked(bars: DataFrame, max_weekly: float | None, cadence: int | None, history: int | None, step: int | None) -> DataFrame:
    """``bars`` with i and n (place in the series, bars of it), seg and j (jumps so far, place since the last one), and the walk's
    cadence (bars a year), history (before the first cutoff) and step. Where these aren't given they are the series' own: its bars a
    year, three years and half a year of them."""
    w, all_ = Window.partitionBy("ticker").orderBy("bar_date"), Window.partitionBy("ticker")
    prev, days = F.lag("close").over(w), F.greatest(F.datediff("bar_date", F.lag("bar_date").over(w)), F.lit(7))
    rate = F.pow(F.col("close") / prev, 7 / days)
    jump = F.when((prev > 0) & (F.col("close") > 0) & ((rate > max_weekly) | (rate < 1 / max_weekly)), 1).otherwise(0) if max_weekly else F.lit(0)
    rows = bars.select("ticker", "bar_date", F.col("close").cast("double").alias("close")).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(all_), "jump": jump})
    rows = rows.withColumns({"seg": F.sum("jump").over(w), "span": F.datediff(F.max("bar_date").over(all_), F.min("bar_date").over(all_))})
    a_year = F.try_divide((F.col("n") - 1) * F.lit(365.25), F.col("span"))
    own = lambda given, k: F.lit(given) if given else F.coalesce(F.greatest(F.floor(a_year * k + 0.5), F.lit(1)), F.lit(1)).cast("int")
    part = Window.partitionBy("ticker", "seg").orderBy("bar_date")
    return rows.withColumns({"j": F.row_number().over(part) - 1, "cadence": own(cadence, 1.0), "history": own(history, 3.0), "step": own(step, 0.5)}).drop("jump", "span")


def _with_pasts(rows: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """``rows`` with past<y>: the close ``y`` years of bars before, as far as the slice goes. Each bar is sent to its own place
    and to the places that look back to it; these meet by a grouping within the ticker's rows."""
    now = [c for c in rows.columns if c not in ("ticker", "seg", "j")]
    sent = F.array(F.struct(F.col("j").alias("j"), F.lit(0).alias("back")), *[F.struct((F.col("j") + y * F.col("cadence")).cast("int").alias("j"), F.lit(y).alias("back")) for y in years])
    each = rows.select("ticker", "seg", F.struct(*now).alias("row"), F.explode(sent).alias("to"))
    at = lambda y, c: F.max(F.when(F.col("to.back") == y, F.col(c)))
    met = each.groupBy("ticker", "seg", F.col("to.j").alias("j")).agg(at(0, "row").alias("row"), *[at(y, "row.close").alias(f"past{y}") for y in years])
    return met.filter("row IS NOT NULL").select("ticker", "seg", "j", "row.*", *[f"past{y}" for y in years])


def quotes(
    bars: DataFrame, dividends: DataFrame, max_weekly: float | None = 3.0, cadence: int | None = None, history: int | None = None, step: int | None = None, cap_years: float = 5.0, rolling: tuple[int, ...] = (1, 2),
) -> DataFrame:
    """One row for each cutoff of each ticker: (ticker, cutoff, i, cadence, price, age_years, chg_<horizon>, div_<horizon>, from_high, pct_rank, vol,
    downside, max_daily, below_ma, above_ma, trend_r2, trend_cagr, life_cagr, capped_cagr, tr_cagr, max_drawdown, roll<y>_pos, worst<y>, underwater_years,
    turnover). A cutoff is every ``step``-th bar from ``history`` on. Changes are percent; volatilities are those of a bar, scaled to
    a trading day. Rolling windows are ``rolling`` years of bars; time under water is counted in bars, a year of which is the cadence."""
    own = walked(bars, max_weekly, cadence, history, step)
    rows = _with_pasts(own, rolling)
    part = Window.partitionBy("ticker", "seg").orderBy("bar_date")
    past = part.rowsBetween(Window.unboundedPreceding, 0)
    positive = F.col("close") > 0
    c, cad = F.col("close"), F.col("cadence")
    rows = rows.withColumns({
        "day": F.unix_date("bar_date"), "prev": F.lag("close").over(part), "peak": F.max("close").over(past), "d0": F.min("bar_date").over(past), "c0": F.first("close").over(past),
        "total": F.sum("close").over(past), "x": F.when(positive, F.count(F.when(positive, 1)).over(past) - 1), "peak_x": F.max(F.when(positive, c)).over(past),
    })
    pair = {y: (c > 0) & (F.col(f"past{y}") > 0) & ((F.col("j") - y * cad) % ROLLING_STEP == 0) for y in rolling}
    rows = rows.withColumns({
        "ret": F.try_divide(c - F.col("prev"), F.col("prev")) * 100, "dd": (F.col("peak") - c) / F.nullif(F.col("peak"), F.lit(0.0)) * 100, "top_x": F.max(F.when(positive & (c >= F.col("peak_x")), F.col("x"))).over(past),
        **{f"up{y}": F.when(pair[y], (c > F.col(f"past{y}")).cast("int")) for y in rolling}, **{f"made{y}": F.when(pair[y], 100 * (c / F.col(f"past{y}") - 1)) for y in rolling},
    })
    by_day = Window.partitionBy("ticker", "seg").orderBy("day")
    asof = lambda value, days: F.last(value).over(by_day.rangeBetween(Window.unboundedPreceding, -days))
    sums = F.struct("total", "j")
    reached = {}
    for h, d in HORIZONS.items():
        half = anchor_half(d)
        reached[f"at_{h}"] = asof("close", d)
        if half:
            reached[f"hi_{h}"], reached[f"lo_{h}"] = asof(sums, d - half), asof(sums, d + half + 1)
    y = F.when(positive, F.log("close"))
    reached |= {
        "max_dd": F.max("dd").over(past), "r2": F.regr_r2(y, F.col("x")).over(past), "slope": F.regr_slope(y, F.col("x")).over(past), "m": F.count("x").over(past), "under": F.max(F.col("x") - F.col("top_x")).over(past),
        **{f"n{k}": F.count(f"up{k}").over(past) for k in rolling}, **{f"u{k}": F.sum(f"up{k}").over(past) for k in rolling}, **{f"w{k}": F.min(f"made{k}").over(past) for k in rolling},
    }
    # the first bar on or after a day is the one after the last before it
    rows = rows.withColumns(reached).withColumn("next_close", F.lead("close").over(part)).withColumn("next_date", F.lead("bar_date").over(part))
    rows = rows.withColumn("capped", F.last(F.struct(F.col("next_close").alias("close"), F.col("next_date").alias("bar_date"))).over(by_day.rangeBetween(Window.unboundedPreceding, -int(cap_years * 365.25) - 1)))
    return _at_cutoffs(rows, own, dividends, rolling)


def _at_cutoffs(rows: DataFrame, own: DataFrame, dividends: DataFrame, rolling: tuple[int, ...]) -> DataFrame:
    """The quotes from running ``rows``: each bar goes to the cutoffs whose last bars it is among, and to its own. ``own`` are the bars by
    slice and place, of which the closes below each endpoint are counted. Cutoffs are few and asked for three times, so they are kept."""
    cad, i = F.col("cadence"), F.col("i")
    late, ma = F.greatest(F.lit(1), F.floor(ENDPOINT_DAYS * cad / 252)), F.floor(LONG_MA_DAYS * cad / 252)
    widest = F.greatest(late, ma, cad)
    first = F.greatest(F.lit(0), F.ceil((i - F.col("history")) / F.col("step")))
    last = F.least(F.floor((F.col("n") - 1 - F.col("history")) / F.col("step")), F.floor((i + widest - 1 - F.col("history")) / F.col("step")))
    sent = rows.withColumns({"late": late, "ma": ma}).filter((first <= last) & (F.col("n") > F.col("history"))).withColumn("k", F.explode(F.sequence(first, last)))
    gap = F.col("history") + F.col("k") * F.col("step") - i
    here = lambda name: F.max(F.when(gap == 0, F.col(name))).alias(name)
    within = lambda bars, value: F.when(gap < bars, F.col(value))
    kept = ["bar_date", "i", "j", "cadence", "late", "ma", "close", "d0", "c0", "peak", "m", "r2", "slope", "max_dd", "under", "capped"]
    kept += [n for h in HORIZONS for n in (f"at_{h}", f"hi_{h}", f"lo_{h}") if n in rows.columns] + [f"{p}{k}" for k in rolling for p in "nuw"]
    ret = within(cad, "ret")
    told = sent.groupBy("ticker", "seg", "k").agg(
        *[here(n) for n in kept], F.count(ret).alias("rets"), F.stddev_pop(ret).alias("sd"), F.avg(F.when(ret.isNotNull(), F.pow(F.least(ret, F.lit(0.0)), 2))).alias("sq"), F.max(within(F.greatest(F.lit(1), F.floor(cad / 12)), "ret")).alias("max_daily"),
        F.avg(within(F.col("late"), "close")).alias("endpoint"), F.avg(within(F.col("ma"), "close")).alias("mean"),
    ).filter("i IS NOT NULL")
    cut = checkpointed(told)
    below = count_below(own.select("ticker", "seg", "j", F.col("close").alias("value")), cut.select("ticker", "seg", F.col("k").alias("q"), F.col("j").alias("upto"), F.col("endpoint").alias("value")), ["ticker", "seg"])
    cut = cut.join(below.withColumnRenamed("q", "k"), ["ticker", "seg", "k"])
    paid = _paid(cut.select("ticker", "k", "bar_date", "d0"), dividends)
    cut = cut.join(paid, ["ticker", "k"], "left")
    age = F.datediff("bar_date", "d0") / 365.25
    n, close, end = F.col("j") + 1, F.col("close"), F.col("endpoint")
    life = lambda of, to, since: F.when((of > 0) & (F.datediff("bar_date", since) / 365.25 >= 0.5), cagr((to / of - 1) * 100, F.datediff("bar_date", since) / 365.25))
    scale = F.sqrt(F.col("cadence") / 252.0)
    enough = lambda v: F.when(F.col("rets") >= 2, v * scale)
    from_ma = lambda v: F.when((n >= F.col("ma")) & (F.col("ma") > 0) & (F.col("mean") > 0), F.greatest(F.lit(0.0), v / F.col("mean") * 100)).otherwise(0.0)
    wealth = close + F.coalesce("paid_all", F.lit(0.0))
    made = {
        "price": close, "age_years": age, **{f"chg_{h.lower()}": _change(h, d, close, end) for h, d in HORIZONS.items()}, **{f"div_{h.lower()}": F.when(F.col("d0") <= F.date_sub("bar_date", d), F.coalesce(f"paid_{h}", F.lit(0.0))) for h, d in DIVIDEND_HORIZONS.items()},
        "from_high": F.greatest(F.lit(0.0), (F.col("peak") - end) / F.col("peak") * 100), "pct_rank": F.when(n >= 2, F.col("below") / (n - 1) * 100).otherwise(0.0), "vol": enough(F.col("sd")), "downside": enough(F.sqrt("sq")), "max_daily": F.col("max_daily"),
        "below_ma": from_ma(F.col("mean") - close), "above_ma": from_ma(close - F.col("mean")), "trend_r2": F.when(F.col("m") >= 2, F.coalesce("r2", F.lit(1.0))).otherwise(0.0), "trend_cagr": F.when(F.col("m") >= 2, (F.exp(F.col("slope") * F.col("cadence")) - 1) * 100),
        "life_cagr": life(F.col("c0"), close, F.col("d0")), "capped_cagr": F.when(age >= 5, F.when(F.col("capped").isNotNull(), life(F.col("capped.close"), close, F.col("capped.bar_date"))).otherwise(life(F.col("c0"), close, F.col("d0")))), "tr_cagr": life(F.col("c0"), wealth, F.col("d0")),
        "max_drawdown": F.greatest(F.lit(0.0), F.col("max_dd")), **{f"roll{k}_pos": F.try_divide(100.0 * F.col(f"u{k}"), F.col(f"n{k}")) for k in rolling}, **{f"worst{k}": F.col(f"w{k}") for k in rolling},
        "underwater_years": F.when(F.col("m") >= 2, F.col("under") / F.col("cadence")), "turnover": F.lit(UNKNOWN_TURNOVER),
    }
    return cut.select("ticker", F.col("bar_date").alias("cutoff"), "i", "cadence", *[F.round(v, 6).alias(k) for k, v in made.items()])


def _change(horizon: str, days: int, close: Column, endpoint: Column) -> Column:
    """Percent from the horizon's anchor, the mean around it or else the close as of it, to the end, which for long horizons is smoothed."""
    asof = F.col(f"at_{horizon}")
    if anchor_half(days):
        hi, lo = F.col(f"hi_{horizon}"), F.col(f"lo_{horizon}")
        bars = hi["j"] - F.coalesce(lo["j"], F.lit(-1))
        asof = F.coalesce(F.when(bars > 0, (hi["total"] - F.coalesce(lo["total"], F.lit(0.0))) / bars), asof)
    now = endpoint if days >= 365 else close
    return F.when(F.datediff("bar_date", "d0") >= days - 31, F.try_divide(now - asof, asof) * 100)


def _paid(cutoffs: DataFrame, dividends: DataFrame) -> DataFrame:
    """(ticker, k, paid_all, paid_<horizon>): a ticker's dividends up to each cutoff, all of them and those of the last days."""
    both = cutoffs.join(dividends.select("ticker", "ex_date", F.col("amount").cast("double").alias("amount")), "ticker").filter("ex_date <= bar_date")
    sums = {f"paid_{h}": F.sum(F.when(F.col("ex_date") > F.date_sub("bar_date", d), F.col("amount"))) for h, d in DIVIDEND_HORIZONS.items()}
    return both.groupBy("ticker", "k").agg(F.sum("amount").alias("paid_all"), *[v.alias(k) for k, v in sums.items()])
