"""Point-in-time walk-forward: cutoffs, what was known then, what came after, and how ranked books did.

Quotes at a cutoff are running windows over the ticker's bars, evaluated once and filtered to the cutoffs; forward
prices are a range window; peers are compared within half-year and class. No step looks at rows of the future but the
forward one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.asof import count_below
from tallyforge.operators.ranks import average_ranks, lanes, running
from tallyforge.operators.series import ENDPOINT_DAYS, by_date, cagr, span_to_bars
from tallyforge.sources.folders import checkpointed


def half_year(day: Column) -> Column:
    return (F.year(day) * 2 + F.floor((F.month(day) - 1) / 6)).cast("int")


def samples(bars: DataFrame, spans: DataFrame, sectors: DataFrame, years: int = 2, history: int = 156, step: int = 20, peers: int = 8) -> DataFrame:
    """One row a ticker and cutoff: cutoff, bucket, market, class, realized and relative forward return, and the quote as of then:
    cagr_life, max_dd, vol, range_pct (share of the closes so far that lie below the smoothed end), r2, score.

    Cutoffs are every ``step`` bars from ``history`` on, where a bar ``years`` ahead exists and the ticker is a member then
    (tickers without spans always are). Relative is realized less the mean of the half-year and asset class, within the
    market where that has ``peers`` rows or more."""
    w = by_date()
    ahead = Window.partitionBy("ticker").orderBy(F.desc("day"), "side").rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    year = w.rowsBetween(-77, 0)
    late = span_to_bars(ENDPOINT_DAYS, 78)
    # a bar asks for the first close on or after its date plus the hold, and tells its own: both in one order, latest first
    day, close = F.unix_date("bar_date"), F.col("close").cast("double")
    places = F.array(F.struct(day.alias("day"), F.lit(0).alias("side"), close.alias("price")), F.struct((day + 365 * years).alias("day"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("price")))
    rows = bars.select("ticker", "bar_date", "close", F.inline(places)).withColumn("fwd", F.last("price", ignorenulls=True).over(ahead)).filter("side = 1").select("ticker", "bar_date", "close", "fwd")
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "prev": F.lag("close").over(w), "peak": F.max("close").over(past), "d0": F.min("bar_date").over(past), "c0": F.first("close").over(past), "endpoint": F.avg("close").over(w.rowsBetween(1 - late, 0))})
    rows = rows.withColumns({"ret": F.try_divide(F.col("close") - F.col("prev"), F.col("prev")) * 100, "dd": (F.col("peak") - F.col("close")) / F.col("peak") * 100})
    rows = rows.withColumns({"max_dd": F.max("dd").over(past), "vol": F.stddev_pop("ret").over(year), "r2": F.regr_r2(F.log("close"), F.col("i")).over(past)})
    at_cutoff = (F.col("i") >= history) & ((F.col("i") - history) % step == 0) & F.col("fwd").isNotNull()
    asked = rows.filter(at_cutoff).select("ticker", F.col("i").alias("q"), F.col("i").alias("upto"), F.col("endpoint").alias("value"))
    below = count_below(rows.select("ticker", F.col("i").alias("j"), F.col("close").alias("value")), asked, ["ticker"])
    cut = rows.filter(at_cutoff).join(below.withColumnRenamed("q", "i"), ["ticker", "i"])
    held = spans.groupBy("ticker").agg(F.collect_list(F.struct("start_date", "end_date")).alias("spans"))
    inside = F.exists("spans", lambda s: (s["start_date"] <= F.col("bar_date")) & (s["end_date"].isNull() | (F.col("bar_date") < s["end_date"])))
    cut = cut.join(held, "ticker", "left").filter(F.col("spans").isNull() | inside).join(sectors.select("ticker", "market", "class"), "ticker", "left")
    life = cagr((F.col("close") / F.col("c0") - 1) * 100, F.datediff("bar_date", "d0") / 365.25)
    out = cut.select(
        "ticker", F.col("bar_date").alias("cutoff"), half_year(F.col("bar_date")).alias("bucket"), "market", "class", F.round((F.col("fwd") / F.col("close") - 1) * 100, 6).alias("realized"),
        F.round(life, 6).alias("cagr_life"), F.round("max_dd", 6).alias("max_dd"), F.round("vol", 6).alias("vol"), F.round(F.when(F.col("i") >= 1, F.col("below") / F.col("i") * 100).otherwise(0.0), 6).alias("range_pct"), F.round("r2", 6).alias("r2"),
    )
    all_in, local = Window.partitionBy("bucket", "class"), Window.partitionBy("bucket", "class", "market")
    mean = F.when(F.count("*").over(local) >= peers, F.avg("realized").over(local)).otherwise(F.avg("realized").over(all_in))
    scored = F.round(F.least(F.col("cagr_life"), F.lit(30.0)) + F.col("range_pct") / 10 - F.col("max_dd") / 20, 4)
    return out.withColumns({"relative": F.round(F.col("realized") - mean, 6), "score": scored})


def books(rows: DataFrame, benchmark: DataFrame, years: int = 2, ladder: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """For each book size: buckets, yearly return of the equal-weight book, of the benchmark, excess, share of buckets
    won, the worst, and the excess of the early and the late half of the buckets."""
    spark = rows.sparkSession
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score"), "ticker", "cutoff")))
    sizes = F.broadcast(spark.createDataFrame([(k,) for k in ladder], "top int"))
    held = ranked.join(sizes, F.col("rn") <= F.col("top"))
    book = held.groupBy("top", "bucket").agg(F.avg(1 + F.col("realized") / 100).alias("multiple"), F.min("cutoff").alias("start"))
    bench = benchmark.select(F.unix_date("bar_date").alias("day"), "close").filter("close > 0")
    # the first benchmark bar on or after the start, and on or after the end
    want = book.select(F.col("start").alias("s")).distinct().select("s", F.unix_date("s").alias("a"), (F.unix_date("s") + 365 * years).alias("b"))
    span = want.join(bench, (F.col("day") >= F.col("a")) & (F.col("day") < F.col("a") + 365 * years + 400), "left").groupBy("s").agg(
        F.min_by("close", F.when(F.col("day") >= F.col("a"), F.col("day"))).alias("from"), F.min_by("close", F.when(F.col("day") >= F.col("b"), F.col("day"))).alias("to")
    )
    both = book.join(span, F.col("start") == F.col("s"))
    yearly = lambda m: (F.pow(F.greatest(m, F.lit(0.0)), 1.0 / years) - 1) * 100
    both = both.select("top", "bucket", yearly(F.col("multiple")).alias("book"), yearly(F.col("to") / F.col("from")).alias("index"))
    w = Window.partitionBy("top")
    both = both.withColumns({"rn": F.row_number().over(w.orderBy("bucket")), "m": F.count("*").over(w), "excess": F.col("book") - F.col("index")})
    early = F.col("rn") <= F.floor(F.col("m") / 2)
    return both.groupBy("top").agg(
        F.count("*").alias("buckets"), F.round(F.avg("book"), 4).alias("book"), F.round(F.avg("index"), 4).alias("index"), F.round(F.avg("excess"), 4).alias("excess"), F.round(100 * F.avg((F.col("excess") > 0).cast("double")), 4).alias("win_pct"),
        F.round(F.min("book"), 4).alias("worst"), F.round(F.avg(F.when(early, F.col("excess"))), 4).alias("early"), F.round(F.avg(F.when(~early, F.col("excess"))), 4).alias("late"),
    )


def purged_cut(rows: DataFrame, months: int = 24, share: float = 0.7) -> DataFrame:
    """(part, n, first, last): training and test rows by date, without training rows within ``months`` of the test."""
    parts = rows.withColumn("one", F.lit(1)).join(F.broadcast(edge_day(rows, share)), "one")
    part = F.when(F.col("cutoff") >= F.col("edge"), "test").when(F.col("cutoff") < F.date_sub("edge", months * 30), "train")
    return parts.withColumn("part", part).filter("part IS NOT NULL").groupBy("part").agg(F.count("*").alias("n"), F.min("cutoff").alias("first"), F.max("cutoff").alias("last"))


def gate_audit(rows: DataFrame, gate: Column) -> DataFrame:
    """(passed, n, mean, median): relative returns of what a gate accepts and refuses; a missing value passes."""
    told = rows.withColumn("passed", F.coalesce(gate, F.lit(True)))
    return told.groupBy("passed").agg(F.count("*").alias("n"), F.round(F.avg("relative"), 6).alias("mean"), F.round(F.percentile("relative", F.lit(0.5)), 6).alias("median"))


def newly_admitted(rows: DataFrame, base: Column, relaxed: Column) -> DataFrame:
    """(n, mean): rows that fail ``base`` and pass ``relaxed``."""
    return rows.filter(~F.coalesce(base, F.lit(True)) & F.coalesce(relaxed, F.lit(True))).agg(F.count("*").alias("n"), F.round(F.avg("relative"), 6).alias("mean"))


def exits(rows: DataFrame, gate: Column) -> DataFrame:
    """(stayed, n, mean): tickers that pass at a cutoff, by whether they pass at their next one."""
    w = Window.partitionBy("ticker").orderBy("cutoff")
    told = rows.withColumn("ok", F.coalesce(gate, F.lit(True))).withColumn("next", F.lead("ok").over(w))
    return told.filter("ok AND next IS NOT NULL").groupBy(F.col("next").alias("stayed")).agg(F.count("*").alias("n"), F.round(F.avg("relative"), 6).alias("mean"))


def unpivoted(rows: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, score, relative, ticker, cutoff): each factor of each row as a score, where it is known."""
    keys = ["relative", "ticker", "cutoff"]
    return rows.select(*keys, *[F.col(f).cast("double") for f in factors]).unpivot(keys, factors, "factor", "score").filter("score IS NOT NULL")


def factor_probe(rows: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, n, rho): rank correlation of each factor with relative returns, after unpivoting the factors."""
    return lanes(unpivoted(checkpointed(rows.select("relative", "ticker", "cutoff", *factors)), factors), ["factor"]).select("factor", "n", "rho")


def scored_by(rows: DataFrame, arms: DataFrame) -> DataFrame:
    """Each row under each arm (arm, w_range, w_dd, and maybe w_cagr; a table of settings, so it is small), with the score that the arm gives it."""
    growth = F.least(F.col("cagr_life"), F.lit(30.0)) * (F.col("w_cagr") if "w_cagr" in arms.columns else 1)
    each = rows.withColumn("one", F.lit(1)).join(F.broadcast(arms.withColumn("one", F.lit(1))), "one").drop("one")
    return each.withColumn("score", F.round(growth + F.col("w_range") * F.col("range_pct") - F.col("w_dd") * F.col("max_dd"), 4))


def knob_sweep(rows: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, n, edge): each arm re-scores the same samples; the halves' edge of its ranking."""
    return lanes(scored_by(_numbered(rows), arms), ["arm"], ("_at",), "_ry").select("arm", "n", "edge")


def _numbered(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``rows`` with _at, the place by ticker and cutoff, and _ry, the rank of the relative return (in each of ``by``), which all arms share that rank the same
    rows; and without ticker."""
    told = rows.withColumn("_all", F.lit(1))
    placed = running(told, ["_all"], [F.col("ticker"), F.col("cutoff")]).withColumn("_at", F.col("upto").cast("int")).drop("upto", "total", "ticker")
    return checkpointed(average_ranks(placed, by or ["_all"], "relative", "_ry").drop("_all"))


def purged_halves(rows: DataFrame, months: int = 24) -> DataFrame:
    """``rows`` with half: 'late' for those from the date on at which the second half of them begins, 'early' for those that lie ``months`` or
    more before it, and null for the rest, whose returns reach into the late half. The date comes from counts by date."""
    told = rows.withColumn("one", F.lit(1)).join(F.broadcast(edge_day(rows, 0.5)), "one").drop("one")
    return told.withColumn("half", F.when(F.col("cutoff") >= F.col("edge"), "late").when(F.col("cutoff") < F.date_sub("edge", months * 30), "early")).drop("edge")


def _by_halves(rows: DataFrame, by: str, months: int) -> DataFrame:
    """(by, n, rho, edge, early_rho, late_rho) of rows with a score."""
    halves = lanes(purged_halves(rows, months).filter("half IS NOT NULL"), [by, "half"])
    return _with_sides(lanes(rows, [by]), halves, by)


def _with_sides(whole: DataFrame, halves: DataFrame, by: str) -> DataFrame:
    side = lambda name: F.max(F.when(F.col("half") == name, F.col("rho"))).alias(f"{name}_rho")
    return whole.join(halves.groupBy(by).agg(side("early"), side("late")), by, "left")


def ablation(rows: DataFrame, base: Column, arms: dict[str, Column], months: int = 24) -> DataFrame:
    """(arm, n, rho, edge, d_rho, d_edge, early_rho, late_rho): what a score is worth without one of its terms, over the rows that the
    score admits. ``base`` and ``arms`` are scores, null where a row isn't admitted; a row that an arm doesn't admit keeps its old
    score, so all arms rank the same rows. Differences are to the arm 'full'."""
    admitted = checkpointed(rows.withColumn("_base", base).filter("_base IS NOT NULL"))
    each = F.array(F.struct(F.lit("full").alias("arm"), F.col("_base").alias("score")), *[F.struct(F.lit(k).alias("arm"), F.coalesce(c, F.col("_base")).alias("score")) for k, c in arms.items()])
    told = _by_halves(admitted.select("relative", "ticker", "cutoff", F.inline(each)), "arm", months)
    full = told.filter("arm = 'full'").select(F.col("rho").alias("_rho"), F.col("edge").alias("_edge"), F.lit(1).alias("one"))
    both = told.withColumn("one", F.lit(1)).join(F.broadcast(full), "one")
    return both.select("arm", "n", "rho", "edge", F.round(F.col("rho") - F.col("_rho"), 6).alias("d_rho"), F.round(F.col("edge") - F.col("_edge"), 6).alias("d_edge"), "early_rho", "late_rho")


def factor_draws(rows: DataFrame, factors: list[str], draws: int, months: int = 24) -> DataFrame:
    """(factor, draw, weight, n, rho, edge, early_rho, late_rho, beats): each factor added to the score with each of ``draws`` weights between -1 and
    1 (from a hash of the draw), where it is known; an arm beats the score as it is if its edge is higher and both purged
    halves' correlations are above 0."""
    weight = F.round(F.pmod(F.col("draw") * 2654435761 + 7, F.lit(1999)) / 999.0 - 1, 6)

    def scored(some: DataFrame) -> DataFrame:
        """Each row under each arm, a factor's place in the list and a draw in one number."""
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("nth"), F.col(f).cast("double").alias("value")) for k, f in enumerate(factors)])).alias("f")
        told = some.select(*[c for c in some.columns if c not in factors], each)
        told = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
        told = told.withColumns({"arm": F.col("f.nth") * draws + F.col("draw"), "score": F.round(F.col("score") + F.coalesce(weight * F.col("f.value"), F.lit(0.0)), 6)})
        return told.drop("f", "draw")

    slim = checkpointed(rows.select("relative", "ticker", "cutoff", "score", *factors))
    base = lanes(slim.withColumn("arm", F.lit("base")), ["arm"]).select(F.col("edge").alias("_edge"), F.lit(1).alias("one"))
    halves = _numbered(purged_halves(slim, months).filter("half IS NOT NULL"), ["half"])  # all arms have the same rows and so the same halves
    told = _with_sides(lanes(scored(_numbered(slim)), ["arm"], ("_at",), "_ry"), lanes(scored(halves), ["arm", "half"], ("_at",), "_ry"), "arm").withColumn("one", F.lit(1)).join(F.broadcast(base), "one")
    factor = F.element_at(F.array(*map(F.lit, factors)), (F.floor(F.col("arm") / draws) + 1).cast("int"))
    beats = F.coalesce((F.col("edge") > F.col("_edge")) & (F.col("early_rho") > 0) & (F.col("late_rho") > 0), F.lit(False))
    told = told.withColumns({"factor": factor, "draw": (F.col("arm") % draws).cast("int")}).withColumn("weight", weight)
    return told.select("factor", "draw", "weight", "n", "rho", "edge", "early_rho", "late_rho", beats.alias("beats"))


def cadences(bars: DataFrame) -> DataFrame:
    """(ticker, per_year, history, hold, step): bars a year of each series from its own span, and one year, three and a half as
    bars, one at least; null for a series of one day."""
    one = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.datediff(F.max("bar_date"), F.min("bar_date")).alias("days"))
    rate = F.try_divide((F.col("n") - 1) * F.lit(365.25), F.col("days"))
    rounded = lambda k: F.greatest(F.floor(rate * k + 0.5), F.lit(1)).cast("long")
    return one.select("ticker", F.round(rate, 6).alias("per_year"), rounded(1.0).alias("history"), rounded(3.0).alias("hold"), rounded(0.5).alias("step"))


def knob_draws(spark, n: int) -> DataFrame:
    """(arm, w_range, w_dd, w_cagr, active): weights between -1 and 1 from a hash of the draw; a third of each is off, and ``active`` counts those on."""
    part = lambda salt: F.pmod(F.col("id") * 2654435761 + salt, F.lit(997)) / 996.0
    on = lambda c: F.when(c < 1 / 3, 0.0).otherwise(F.round((c - 1 / 3) * 3 - 1, 4))
    rows = spark.range(n).select(F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("arm"), on(part(0)).alias("w_range"), on(part(31337)).alias("w_dd"), on(part(70001)).alias("w_cagr"))
    return rows.withColumn("active", ((F.col("w_range") != 0).cast("int") + (F.col("w_dd") != 0).cast("int") + (F.col("w_cagr") != 0).cast("int")))


def edge_day(rows: DataFrame, share: float) -> DataFrame:
    """(edge, one): the date of the row at ``share`` of all rows by date, from counts by date."""
    w = Window.partitionBy(F.lit(1))
    days = rows.groupBy("cutoff").agg(F.count("*").alias("k")).withColumns({"upto": F.sum("k").over(w.orderBy("cutoff")), "n": F.sum("k").over(w)})  # a row a date
    return days.filter(F.col("upto") >= F.floor(share * F.col("n")) + 1).agg(F.min("cutoff").alias("edge")).withColumn("one", F.lit(1))


def knob_search(rows: DataFrame, arms: DataFrame, share: float = 0.7, months: int = 24) -> DataFrame:
    """(arm, active, train_rho, train_edge, test_rho, test_edge): each arm scores the first ``share`` of the samples by date, less those
    within ``months`` of the rest; of the arms with a rank correlation above 0 there, the one with the best halves' edge, and
    of equal ones the one with fewest active weights, is tested once on the rest."""
    rows = checkpointed(rows.select("relative", "ticker", "cutoff", "cagr_life", "range_pct", "max_dd"))
    day = edge_day(rows, share)
    told = checkpointed(rows.withColumn("one", F.lit(1)).join(F.broadcast(day), "one").drop("one"))
    early = _numbered(told.filter(F.col("cutoff") < F.date_sub("edge", months * 30)).drop("edge"))
    train = lanes(scored_by(early, arms.drop("active")), ["arm"], ("_at",), "_ry").join(arms, "arm").filter("rho > 0")
    won = checkpointed(train.orderBy(F.desc("edge"), "active", "arm").limit(1).select("arm", "w_range", "w_dd", "w_cagr", "active", F.col("rho").alias("train_rho"), F.col("edge").alias("train_edge")))
    test = lanes(scored_by(told.filter("cutoff >= edge"), won.select("arm", "w_range", "w_dd", "w_cagr")), ["arm"])
    return won.join(test, "arm", "left").select("arm", "active", "train_rho", "train_edge", F.col("rho").alias("test_rho"), F.col("edge").alias("test_edge"))


def factor_sweep(rows: DataFrame, factors: list[str], months: int = 24) -> DataFrame:
    """(factor, n, rho, edge, early_rho, late_rho, beats): each factor as the score, over all samples and over either purged half; it
    beats the present score if its edge is higher and both halves' correlations are above 0."""
    rows = checkpointed(rows.select("relative", "ticker", "cutoff", "score", *factors))
    base = lanes(rows.select("relative", "ticker", "cutoff", "score").withColumn("arm", F.lit("base")), ["arm"]).select(F.col("edge").alias("_edge"), F.lit(1).alias("one"))
    told = _by_halves(unpivoted(rows, factors), "factor", months).withColumn("one", F.lit(1)).join(F.broadcast(base), "one")
    beats = F.coalesce((F.col("edge") > F.col("_edge")) & (F.col("early_rho") > 0) & (F.col("late_rho") > 0), F.lit(False))
    return told.select("factor", "n", "rho", "edge", "early_rho", "late_rho", beats.alias("beats"))
