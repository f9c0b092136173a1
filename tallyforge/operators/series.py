"""Measures of one ordered price series a ticker: growth, trend, drawdown, risk, horizons, income.

``positioned`` puts each bar's place into its row with windows over (ticker, bar_date); every measure is then an
aggregate by ticker, so a query is one shuffle by ticker however many measures it has. Missing data give null, as do
guards: too few bars, prices that aren't positive, zero denominators.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Return horizons in days (fixed values).
HORIZONS = {"1D": 1, "1W": 7, "1M": 30, "3M": 91, "6M": 182, "1Y": 365, "2Y": 730, "5Y": 1825, "8Y": 2920, "10Y": 3650, "20Y": 7300}
DIVIDEND_HORIZONS = {"1Y": 365, "5Y": 1825, "10Y": 3650, "20Y": 7300}


def by_date():
    """A ticker's bars in the order of their dates."""
    return Window.partitionBy("ticker").orderBy("bar_date")


def whole():
    """All bars of a ticker."""
    return Window.partitionBy("ticker")


def cagr(cumulative: Column, years: Column) -> Column:
    """Yearly growth, in percent, that compounds to ``cumulative`` percent."""
    return F.when(years <= 0, cumulative).otherwise((F.pow(F.greatest(1 + cumulative / 100, F.lit(1e-9)), 1 / years) - 1) * 100)


def real_pct(nominal: Column, inflation: Column) -> Column:
    return ((1 + nominal / 100) / (1 + inflation / 100) - 1) * 100


def anchor_half(days: int) -> int:
    """Days to either side of a horizon's anchor over which its price is averaged."""
    return next((h for least, h in ((1825, 365), (182, 90), (30, 30), (7, 7)) if days >= least), 0)


ENDPOINT_DAYS = 17  #: trading days whose mean close is the price that long measures end at


def span_to_bars(days: int, cadence: int) -> int:
    """Trading days as bars, of which there are ``cadence`` a year; one at least."""
    return max(1, days * cadence // 252)


def positioned(bars: DataFrame) -> DataFrame:
    """``bars`` with i (0 first), n, prev, peak (running high), first_date, last_date, last_close and ret (percent)."""
    rows = bars.withColumns({"i": F.row_number().over(by_date()) - 1, "prev": F.lag("close").over(by_date()), "peak": F.max("close").over(by_date())})
    rows = rows.withColumns({"n": F.count("*").over(whole()), "first_date": F.min("bar_date").over(whole()), "last_date": F.max("bar_date").over(whole()), "last_close": F.max_by("close", "bar_date").over(whole())})
    return rows.withColumn("ret", F.try_divide(F.col("close") - F.col("prev"), F.col("prev")) * 100)


def tail(value: Column, bars: int) -> Column:
    """``value`` in the last ``bars`` rows of a ticker, else null."""
    return F.when(F.col("i") >= F.col("n") - bars, value)


def life(first: Column, last: Column, start: Column, end: Column) -> Column:
    """Yearly growth from first to last close; null under half a year or from a price that isn't positive."""
    age = F.datediff(end, start) / 365.25
    return F.when((first > 0) & (age >= 0.5), cagr((last / first - 1) * 100, age))


def prepared(bars: DataFrame, cadence: int, window: int) -> DataFrame:
    """``positioned`` bars with what the measures need besides: the smoothed endpoint, the place among positive closes (x), the close
    ``window`` bars ahead, and the last place at the high."""
    rows = positioned(bars)
    late = span_to_bars(ENDPOINT_DAYS, cadence)
    return rows.withColumns({
        "endpoint": F.avg(tail(F.col("close"), late)).over(whole()), "x": F.when(F.col("close") > 0, F.count(F.when(F.col("close") > 0, 1)).over(by_date()) - 1), "ahead": F.lead("close", window).over(by_date()),
        "top_i": F.max(F.when((F.col("close") > 0) & (F.col("close") >= F.col("peak")), F.col("i"))).over(by_date()),
    })


Part = tuple[dict[str, Column], dict[str, Column]]  # aggregates over a ticker's prepared bars, and measures of these


def growth_part(cap_years: float = 5.0) -> Part:
    """age_years, life_cagr, tr_life_cagr (with ``paid`` dividends), capped_cagr (last ``cap_years``), life_return (smoothed end)."""
    late = F.col("bar_date") >= F.date_sub("last_date", math.trunc(cap_years * 365.25))
    made = {
        "g_first": F.min_by("close", "bar_date"), "g_last": F.max("last_close"), "g_d0": F.min("bar_date"), "g_d1": F.max("bar_date"),
        "g_cap": F.min_by("close", F.when(late, F.col("bar_date"))), "g_cap_d0": F.min(F.when(late, F.col("bar_date"))), "g_end": F.max("endpoint"),
    }
    first, last, d0, d1 = (F.col(f"g_{c}") for c in ("first", "last", "d0", "d1"))
    age = F.datediff(d1, d0) / 365.25
    return made, {
        "age_years": age, "life_cagr": life(first, last, d0, d1), "tr_life_cagr": life(first, last + F.coalesce("paid", F.lit(0.0)), d0, d1), "capped_cagr": F.when(age >= 5, life(F.col("g_cap"), last, F.col("g_cap_d0"), d1)),
        "life_return": F.when((first > 0) & (age >= 0.5), (F.col("g_end") - first) / first * 100),
    }


def trend_part(cadence: int = 78, ma: int = 60, tol: float = 0.02) -> Part:
    """Log-trend fit and yearly slope, distance of the last close from the long average, and of the smoothed endpoint its
    place among all closes and its distance from the high."""
    y = F.when(F.col("close") > 0, F.log("close"))
    made = {
        "t_n": F.count("*"), "t_m": F.count("x"), "t_r2": F.regr_r2(y, F.col("x")), "t_slope": F.regr_slope(y, F.col("x")), "t_ma": F.avg(tail(F.col("close"), ma)), "t_last": F.max("last_close"), "t_hi": F.max("close"), "t_lo": F.min("close"),
        "t_below": F.count_if(F.col("close") < F.col("endpoint")), "t_end": F.max("endpoint"),
    }
    n, m, last, hi = (F.col(f"t_{c}") for c in ("n", "m", "last", "hi"))
    gap = lambda x: F.when((n >= ma) & (F.col("t_ma") > 0), F.greatest(F.lit(0.0), x / F.col("t_ma") * 100)).otherwise(0.0)
    return made, {
        "trend_r2": F.when(m >= 2, F.coalesce("t_r2", F.lit(1.0))).otherwise(0.0), "trend_cagr": F.round(F.when(m >= 2, (F.exp(F.col("t_slope") * cadence) - 1) * 100), 4), "below_ma": gap(F.col("t_ma") - last), "above_ma": gap(last - F.col("t_ma")),
        "pct_rank": F.when(n >= 2, F.col("t_below") / (n - 1) * 100).otherwise(0.0), "from_high": F.greatest(F.lit(0.0), (hi - F.col("t_end")) / hi * 100), "at_high": last >= hi * (1 - tol), "at_low": last <= F.col("t_lo") * (1 + tol),
    }


def drawdown_part(step: int = 5) -> Part:
    """Deepest fall from a running high, longest time under it (years of 252 bars), and rolling returns over the bars ahead."""
    pair = (F.col("i") % step == 0) & (F.col("close") > 0) & (F.col("ahead") > 0)
    made = {
        "d_dd": F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("close")) / F.col("peak") * 100)), "d_under": F.max(F.col("i") - F.col("top_i")), "d_n": F.count("*"),
        "d_pairs": F.count_if(pair), "d_up": F.count_if(pair & (F.col("ahead") > F.col("close"))), "d_worst": F.min(F.when(pair, 100 * (F.col("ahead") / F.col("close") - 1))),
    }
    return made, {"max_drawdown": F.greatest(F.lit(0.0), "d_dd"), "underwater_years": F.when(F.col("d_n") >= 2, F.col("d_under") / 252.0), "rolling_positive": F.try_divide(100.0 * F.col("d_up"), F.col("d_pairs")), "worst_rolling": F.col("d_worst")}


def risk_part(n: int = 250, cadence: int = 78) -> Part:
    """Volatility (population), its daily equivalent, largest bar, downside deviation, mean turnover and volume."""
    ret = tail(F.col("ret"), n)
    value = tail(F.when(F.col("close") * F.col("volume") > 0, F.col("close") * F.col("volume")), n)
    made = {
        "r_m": F.count(ret), "r_vol": F.stddev_pop(ret), "r_most": F.max(ret), "r_down": F.avg(F.when(ret.isNotNull(), F.pow(F.least(ret, F.lit(0.0)), 2))), "r_turnover": F.avg(value), "r_volume": F.avg(tail(F.when(F.col("volume") > 0, F.col("volume")), n)),
    }
    enough = lambda c: F.when(F.col("r_m") >= 2, c)
    return made, {
        "volatility": enough(F.col("r_vol")), "daily_volatility": enough(F.col("r_vol") * F.sqrt(F.lit(cadence / 252.0))), "max_daily": F.col("r_most"), "downside": enough(F.sqrt("r_down")), "avg_turnover": F.round("r_turnover", 4), "avg_volume": F.col("r_volume"),
    }


def measured(bars: DataFrame, parts: list[Part], dividends: DataFrame | None = None, cadence: int = 78, window: int = 78) -> DataFrame:
    """(ticker, the parts' measures): one pass of windows and one grouping, however many parts; numbers rounded to six places."""
    made = {n: c for p in parts for n, c in p[0].items()}
    one = prepared(bars, cadence, window).groupBy("ticker").agg(*[c.alias(n) for n, c in made.items()])
    if dividends is not None:
        one = one.join(dividends.groupBy("ticker").agg(F.sum("amount").cast("double").alias("paid")), "ticker", "left")
    whole_numbers = ("at_high", "at_low")
    return one.select("ticker", *[(c if n in whole_numbers else F.round(c, 6)).alias(n) for p in parts for n, c in p[1].items()])


def growth(bars: DataFrame, dividends: DataFrame, cap_years: float = 5.0, cadence: int = 78) -> DataFrame:
    return measured(bars, [growth_part(cap_years)], dividends, cadence)


def trend(bars: DataFrame, cadence: int = 78, ma: int = 60, tol: float = 0.02) -> DataFrame:
    return measured(bars, [trend_part(cadence, ma, tol)], cadence=cadence)


def drawdown(bars: DataFrame, window: int = 78, step: int = 5) -> DataFrame:
    return measured(bars, [drawdown_part(step)], window=window)


def risk(bars: DataFrame, n: int = 250, cadence: int = 78) -> DataFrame:
    return measured(bars, [risk_part(n, cadence)], cadence=cadence)


def calendar_returns(bars: DataFrame) -> DataFrame:
    """(ticker, year, ret): change of a year's last close over that of the year before; not for the series' last year."""
    years = bars.filter("close > 0").groupBy("ticker", F.year("bar_date").alias("year")).agg(F.max_by("close", "bar_date").alias("close"))
    ends = bars.groupBy("ticker").agg(F.year(F.max("bar_date")).alias("end"))
    w = Window.partitionBy("ticker").orderBy("year")
    rows = years.withColumns({"was": F.lag("close").over(w), "before": F.lag("year").over(w)}).join(ends, "ticker")
    return rows.filter("year - before = 1 AND year <> end").select("ticker", "year", F.round(100 * (F.col("close") / F.col("was") - 1), 6).alias("ret"))


def monthly_tail(bars: DataFrame, k: int = 36) -> DataFrame:
    """(ticker, month, ret): the last ``k`` month-on-month changes of positive month-end closes."""
    months = bars.filter("close > 0").groupBy("ticker", F.trunc("bar_date", "month").alias("month")).agg(F.max_by("close", "bar_date").alias("close"))
    w = Window.partitionBy("ticker")
    rows = months.withColumns({"was": F.lag("close").over(w.orderBy("month")), "back": F.row_number().over(w.orderBy(F.desc("month")))})
    return rows.filter(F.col("was").isNotNull() & (F.col("back") <= k)).select("ticker", "month", F.round((F.col("close") / F.col("was") - 1) * 100, 6).alias("ret"))


def horizon_changes(bars: DataFrame, cadence: int = 78) -> DataFrame:
    """(ticker, horizon, change): from each anchor, averaged over its half-width or else as of it, to the end; long ones
    end at the smoothed close. Null where the series starts over 31 days after the anchor."""
    rows = positioned(bars)
    made = {}
    for h, d in HORIZONS.items():
        half, target = anchor_half(d), F.date_sub("last_date", d)
        near = F.col("bar_date").between(F.date_sub(target, half), F.date_add(target, half))
        made[f"mean_{h}"] = F.avg(F.when(near, F.col("close"))) if half else F.lit(None).cast("double")
        made[f"asof_{h}"] = F.max_by("close", F.when(F.col("bar_date") <= target, F.col("bar_date")))
    ends = [F.max("last_date").alias("d1"), F.min("first_date").alias("d0"), F.max("last_close").alias("raw"), F.avg(tail(F.col("close"), span_to_bars(ENDPOINT_DAYS, cadence))).alias("smooth")]
    one = rows.groupBy("ticker").agg(*ends, *[c.alias(k) for k, c in made.items()])

    def change(h: str, d: int) -> Column:
        past = F.coalesce(F.col(f"mean_{h}"), F.col(f"asof_{h}"))
        now = F.col("smooth" if d >= 365 else "raw")
        return F.struct(F.lit(h).alias("horizon"), F.round(F.when(F.datediff("d1", "d0") >= d - 31, F.try_divide(now - past, past) * 100), 6).alias("change"))

    return one.select("ticker", F.inline(F.array(*[change(h, d) for h, d in HORIZONS.items()])))


def income(bars: DataFrame, dividends: DataFrame, splits: DataFrame, since: str = "1999-01-01") -> DataFrame:
    """Dividends and yields by horizon, null where the series is too short, and the split factor after ``since``."""
    ends = bars.groupBy("ticker").agg(F.min("bar_date").alias("d0"), F.max("bar_date").alias("d1"), F.max_by("close", "bar_date").alias("px"))
    paid = ends.join(dividends, "ticker", "left")
    sums = {h: F.sum(F.when((F.col("ex_date") > F.date_sub("d1", d)) & (F.col("ex_date") <= F.col("d1")), F.col("amount"))).alias(f"s{h}") for h, d in DIVIDEND_HORIZONS.items()}
    one = paid.groupBy("ticker", "d0", "d1", "px").agg(*sums.values())
    ratio = splits.filter((F.col("eff_date") > F.lit(since).cast("date")) & (F.col("ratio") > 0)).groupBy("ticker").agg(F.product("ratio").alias("factor"))
    total = {h: F.when(F.col("d0") <= F.date_sub("d1", d), F.coalesce(F.col(f"s{h}").cast("double"), F.lit(0.0))) for h, d in DIVIDEND_HORIZONS.items()}
    cols = [F.round(total[h], 4).alias(f"div_{h.lower()}") for h in total] + [F.round(F.when(F.col("px") > 0, total[h] / (d / 365.0) / F.col("px") * 100), 8).alias(f"yield_{h.lower()}") for h, d in DIVIDEND_HORIZONS.items()]
    return one.join(ratio, "ticker", "left").select("ticker", *cols, F.coalesce("factor", F.lit(1.0)).alias("split_factor"))


def streak(bars: DataFrame) -> DataFrame:
    """(ticker, direction, days, duration): the run of moves in the last move's direction at the end of the series."""
    rows = positioned(bars).withColumn("sign", F.signum(F.col("close") - F.col("prev")))
    rows = rows.withColumn("final", F.max_by("sign", "bar_date").over(whole()))
    one = rows.groupBy("ticker").agg(F.max("final").alias("final"), F.max("bar_date").alias("d1"), F.max(F.when(F.col("sign").isNull() | (F.col("sign") != F.col("final")), F.col("bar_date"))).alias("turn"))
    days = F.when(F.coalesce("final", F.lit(0)) == 0, 0).otherwise(F.datediff("d1", "turn"))
    out = one.select("ticker", F.coalesce("final", F.lit(0)).cast("int").alias("direction"), days.alias("days"))
    return out.withColumn("duration", duration(F.col("days").cast("long") * 86400))


def duration(seconds: Column) -> Column:
    """The largest unit that fits, rounded down: 3M, 2w, 5d."""
    out = F.lit("0s")
    for unit, size in (("s", 1), ("m", 60), ("h", 3600), ("d", 86400), ("w", 604800), ("M", 2592000), ("Y", 31536000)):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))).otherwise(out)
    return out


def splice_start(bars: DataFrame, max_weekly: float = 3.0) -> DataFrame:
    """(ticker, start): where the series begins after its last jump of over ``max_weekly`` times a week, up or down."""
    rows = positioned(bars).withColumn("days", F.greatest(F.datediff("bar_date", F.lag("bar_date").over(by_date())), F.lit(7)))
    rate = F.pow(F.col("close") / F.col("prev"), 7 / F.col("days"))
    jump = (F.col("prev") > 0) & (F.col("close") > 0) & ((rate > max_weekly) | (rate < 1 / max_weekly))
    return rows.groupBy("ticker").agg(F.coalesce(F.max(F.when(jump, F.col("bar_date"))), F.min("bar_date")).alias("start"))


def splice_proxy(bars: DataFrame, proxy: DataFrame) -> DataFrame:
    """``bars`` (ticker, bar_date, close) after the proxy's older bars, which are scaled to meet their first close. The proxy has a
    row a date, so it is small and goes to all tasks."""
    first = bars.groupBy("ticker").agg(F.min("bar_date").alias("d0"), F.min_by("close", "bar_date").alias("c0"))
    told = proxy.select(F.col("bar_date").alias("d0"), F.col("close").cast("double").alias("p0"), F.lit(0).alias("side"))
    asked = first.select("d0", F.lit(None).cast("double").alias("p0"), F.lit(1).alias("side")).distinct()
    w = Window.partitionBy(F.lit(1)).orderBy("d0", "side")  # a row a date on either side
    at = told.union(asked).withColumn("p0", F.last("p0", ignorenulls=True).over(w)).filter("side = 1").select("d0", "p0")
    scaled = first.join(F.broadcast(at), "d0").filter("c0 > 0 AND p0 > 0")
    older = scaled.join(F.broadcast(proxy.select("bar_date", "close")), F.col("bar_date") < F.col("d0"))
    return older.select("ticker", "bar_date", (F.col("close") * F.col("c0") / F.col("p0")).alias("close")).unionByName(bars.select("ticker", "bar_date", "close"))


def trailing(bars: DataFrame, n: int = 36) -> DataFrame:
    """(ticker, bar_date, n_trail, mean_trail): the up to ``n`` one-bar returns that end at the bar before."""
    back = by_date().rowsBetween(-n, -1)
    rows = positioned(bars).withColumn("good", F.when((F.col("prev") > 0) & (F.col("close") > 0), F.col("ret")))
    return rows.select("ticker", "bar_date", F.count("good").over(back).alias("n_trail"), F.round(F.avg("good").over(back), 6).alias("mean_trail"))


def intraday(bars: DataFrame, steps: tuple[int, ...] = (1, 6, 12)) -> DataFrame:
    """Change of the last close over that of ``steps`` bars before."""
    rows = positioned(bars)
    past = lambda k: F.max(F.when(F.col("i") == F.col("n") - 1 - k, F.col("close")))
    one = rows.groupBy("ticker").agg(F.max("last_close").alias("last"), *[past(k).alias(f"p{k}") for k in steps])
    return one.select("ticker", *[F.round(F.try_divide(F.col("last") - F.col(f"p{k}"), F.col(f"p{k}")) * 100, 6).alias(f"chg_{k}") for k in steps])
