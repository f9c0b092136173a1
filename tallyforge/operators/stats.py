"""Cross-sectional statistics: correlation, ranks, percentiles, edges of a ranked cohort, resampling.

Each is a grouping with windows by group; guards give null. Percentiles keep their own index rules, which aren't those
of the built-in ones. Ties are broken by explicit keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ranks import weighted_prefixes
from tallyforge.sources.folders import checkpointed


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns; null under two rows or without variance."""
    return F.when(F.count(x) >= 2, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1; equal values share the mean of their places."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)).cast("double") + (F.count("*").over(w.partitionBy(*by, value)) - 1) / F.lit(2.0)


def correlations(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, pearson, spearman) of two columns in each group."""
    ranked = rows.withColumns({"rx": average_rank(x, by), "ry": average_rank(y, by)})
    return ranked.groupBy(by).agg(F.round(pearson(x, y), 6).alias("pearson"), F.round(pearson("rx", "ry"), 6).alias("spearman"))


def placed(rows: DataFrame, by: str, order: list) -> DataFrame:
    """``rows`` with rn (from 1) in ``order`` and n, by group."""
    w = Window.partitionBy(by)
    return rows.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})


def pick(value: str, at: Column) -> Column:
    """The value at 0-based place ``at`` of an ordered group."""
    return F.max(F.when(F.col("rn") - 1 == at, F.col(value)))


def percentiles(rows: DataFrame, by: str, value: str, p: float = 30.0, q: float = 95.0) -> DataFrame:
    """(by, floor, nearest, median, mean): value at place trunc(p/100*n), at round(q/100*(n-1)), the median, the mean."""
    ranked = placed(rows.filter(F.col(value).isNotNull()), by, [value])
    n = F.col("n")
    low = F.least(F.floor(p / 100.0 * n), n - 1)
    near = F.floor(q / 100.0 * (n - 1) + 0.5)
    middle = F.avg(F.when(F.col("rn").isin(0) | ((F.col("rn") - 1).between(F.floor((n - 1) / 2), F.ceil((n - 1) / 2))), F.col(value)))
    return ranked.groupBy(by).agg(F.round(pick(value, low), 6).alias("floor"), F.round(pick(value, near), 6).alias("nearest"), F.round(middle, 6).alias("median"), F.round(F.avg(value), 6).alias("mean"))


def edges(samples: DataFrame, by: str, score: str = "score", relative: str = "relative", key: str = "ticker") -> DataFrame:
    """For each group, by score: mean of ``relative`` in the upper and lower half (an odd middle is left out), in thirds
    (the middle takes the remainder), whether these fall, and the halves' edge with values clamped to their 1st and 99th
    percentile (null under four rows)."""
    low, high = F.floor(0.01 * (F.col("n") - 1) + 0.5), F.floor(0.99 * (F.col("n") - 1) + 0.5)
    by_value = placed(samples, by, [relative, key])
    bounds = by_value.groupBy(by).agg(pick(relative, low).alias("lo"), pick(relative, high).alias("hi"))
    rows = placed(samples, by, [F.desc(score), key]).join(bounds, by).withColumn("clamped", F.greatest(F.least(F.col(relative), F.col("hi")), F.col("lo")))
    rn, n, half, third = F.col("rn"), F.col("n"), F.floor(F.col("n") / 2), F.floor(F.col("n") / 3)
    mean = lambda when, c=relative: F.avg(F.when(when, F.col(c)))
    one = rows.groupBy(by, "n").agg(
        mean(rn <= half).alias("top"), mean(rn > n - half).alias("bottom"), mean(rn <= third).alias("t1"), mean((rn > third) & (rn <= n - third)).alias("t2"), mean(rn > n - third).alias("t3"),
        (mean(rn <= half, "clamped") - mean(rn > n - half, "clamped")).alias("w"),
    )
    third_of = lambda c: F.round(F.when(n >= 3, F.col(c)), 6).alias(c)
    return one.select(
        by, "n", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"), F.round(F.col("top") - F.col("bottom"), 6).alias("edge"), third_of("t1"), third_of("t2"), third_of("t3"),
        F.coalesce((n >= 3) & (F.col("t1") > F.col("t2")) & (F.col("t2") > F.col("t3")), F.lit(False)).alias("monotone"), F.round(F.when(n >= 4, F.col("w")), 6).alias("winsor_edge"),
    )


def draws(spark, buckets: DataFrame, n_draws: int, block: int) -> DataFrame:
    """(draw, bucket, times): block resamples of ``buckets`` (bucket) with wrap-around, as the number of times that each is
    drawn. Where a block begins is a hash of the draw and the block's number, so the same table comes out wherever it is made."""
    w = Window.partitionBy(F.lit(1))
    numbered = F.broadcast(buckets.distinct().withColumns({"at": F.row_number().over(w.orderBy("bucket")) - 1, "m": F.count("*").over(w)}))  # half-years
    size = numbered.agg(F.max("m").alias("m")).withColumn("one", F.lit(1))
    each = spark.range(n_draws).select(F.col("id").cast("int").alias("draw"), F.lit(1).alias("one")).join(F.broadcast(size), "one")
    blocks = each.select("draw", "m", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / block).cast("int"))).alias("nth"))
    placed_at = blocks.withColumn("start", F.pmod((F.col("draw").cast("long") * 7919 + F.col("nth").cast("long") * 104729) * 48271 % 2147483647, F.col("m")))
    drawn = placed_at.select("draw", "m", F.explode(F.sequence(F.lit(0), F.least(F.lit(block), (F.col("m") - F.col("nth") * block).cast("int")) - 1)).alias("k"), "start").withColumn("at", F.pmod(F.col("start") + F.col("k"), F.col("m")))
    return drawn.groupBy("draw", "at").agg(F.count("*").alias("times")).join(numbered.select("at", "bucket"), "at").select("draw", "bucket", "times")


def bootstrap(samples: DataFrame, drawn: DataFrame, block: int = 2, least_keys: int = 4, least_blocks: int = 10) -> DataFrame:
    """(lo, mid, hi): 5th, 50th and 95th percentile of the halves' edge over resamples (draw, bucket, times) of the buckets; null
    under ``least_keys`` buckets, or for blocks of several under ``least_blocks`` of them. A row drawn several times counts so
    often. The halves of a draw are sums over its first units in order of score, which are found in counts by ranges of
    rank (``weighted_prefixes``), so samples are ranked once and never multiplied by the draws."""
    sizes = samples.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("relative").alias("all"))
    keys = sizes.agg(F.count("*").alias("keys")).withColumn("one", F.lit(1))
    units = drawn.join(sizes, "bucket").groupBy("draw").agg(F.sum(F.col("times") * F.col("rows")).alias("n"), F.sum(F.col("times") * F.col("all")).alias("all"))
    units = checkpointed(units.withColumn("half", F.floor(F.col("n") / 2)))
    ends = units.filter("half > 0").select("draw", F.explode(F.array(F.struct(F.lit(0).alias("q"), F.col("half").alias("upto")), F.struct(F.lit(1).alias("q"), (F.col("n") - F.col("half")).alias("upto")))).alias("e"))
    sums = weighted_prefixes(samples, checkpointed(drawn), ends.select("draw", "e.q", "e.upto"), [F.desc("score"), F.col("ticker"), F.col("cutoff")], "relative")
    halves = sums.groupBy("draw").agg(F.max(F.when(F.col("q") == 0, F.col("sum"))).alias("upper"), F.max(F.when(F.col("q") == 1, F.col("sum"))).alias("but_lower"))
    edge = (F.col("upper") - (F.col("all") - F.col("but_lower"))) / F.col("half")
    ranked = placed(halves.join(units, "draw").select(edge.alias("edge"), F.lit(1).alias("one")), "one", ["edge"])  # a row a draw
    at = lambda p: pick("edge", F.floor(p / 100.0 * (F.col("n") - 1) + 0.5))
    band = ranked.groupBy("one").agg(at(5.0).alias("lo"), at(50.0).alias("mid"), at(95.0).alias("hi")).join(F.broadcast(keys), "one")
    enough = (F.col("keys") >= least_keys) & ((F.lit(block) <= 1) | (F.floor(F.col("keys") / block) >= least_blocks))
    return band.select(*[F.when(enough, F.col(c)).alias(c) for c in ("lo", "mid", "hi")])


def lane_metrics(samples: DataFrame, by: str) -> DataFrame:
    """(by, n, rho, edge): rank correlation of score and relative return, and the halves' edge; null and 0 under four rows."""
    ranked = samples.withColumns({"rx": average_rank("score", by), "ry": average_rank("relative", by)})
    rho = ranked.groupBy(by).agg(F.when(F.count("*") >= 4, pearson("rx", "ry")).alias("rho"))
    keyed = samples.withColumn("id", F.concat_ws(":", "ticker", F.col("cutoff").cast("string")))
    return edges(keyed, by, key="id").join(rho, by).select(by, "n", F.round("rho", 6).alias("rho"), F.when(F.col("n") >= 4, F.col("edge")).otherwise(0.0).alias("edge"))


def tail_side(tests: int) -> float:
    """Percent to leave on either side of a band when the best of so many tests is looked at."""
    return 5.0 / max(1, tests)


def turnover(samples: DataFrame) -> DataFrame:
    """(turnover): mean Jaccard distance of the upper halves of consecutive buckets, by score; 0 under two buckets."""
    top = placed(samples, "bucket", [F.desc("score"), "ticker", "cutoff"]).filter(F.col("rn") <= F.floor(F.col("n") / 2))
    sets = top.groupBy("bucket").agg(F.collect_set("ticker").alias("held"))
    was = sets.withColumn("was", F.lag("held").over(Window.partitionBy(F.lit(1)).orderBy("bucket"))).filter("was IS NOT NULL")
    return was.agg(F.round(F.avg(1 - F.try_divide(F.size(F.array_intersect("held", "was")), F.size(F.array_union("held", "was")))), 6).alias("t")).select(F.coalesce("t", F.lit(0.0)).alias("turnover"))


def recall(samples: DataFrame, top: int = 10, share: float = 0.1, least: float = 0.0) -> DataFrame:
    """(recall, captured, winners), over all buckets of two rows or more: of each bucket's best ``share`` by realised return,
    rounded and one at least, that made ``least`` times their money, the part whose ticker is among the ``top`` by score, by
    number and by multiple. Rows without a score are in the pool and not among the picks; null without winners."""
    pool = placed(samples, "bucket", [F.desc("realized"), "ticker", "cutoff"]).filter("n >= 2")
    won = pool.filter(F.col("rn") <= F.least(F.greatest(F.floor(share * F.col("n") + 0.5), F.lit(1)), F.col("n"))).withColumn("multiple", F.greatest(1 + F.col("realized") / 100, F.lit(0.0))).filter(F.col("multiple") >= least)
    picks = placed(samples.filter("score IS NOT NULL"), "bucket", [F.desc("score"), "ticker", "cutoff"]).filter(F.col("rn") <= top).select("bucket", "ticker", F.lit(True).alias("held")).distinct()
    both = won.join(picks, ["bucket", "ticker"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    all_in = both.agg(F.count("*").alias("winners"), F.avg(F.col("held").cast("double")).alias("r"), F.try_divide(F.sum(F.when(F.col("held"), F.col("multiple")).otherwise(0.0)), F.sum("multiple")).alias("c"))
    return all_in.select(F.round(F.when(F.col("c").isNotNull(), F.col("r")), 6).alias("recall"), F.round("c", 6).alias("captured"), "winners")
