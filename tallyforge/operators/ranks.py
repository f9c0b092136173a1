"""Exact ranks and running sums of groups that are larger than a task.

A window keyed by a group holds all of the group in one task. Here rows are dealt into ranges of (group, order), the ranges are
kept in the shared folder so that each row's range is a fact, and a row's place is what the ranges before hold of its
group, which is a table of groups by ranges, and its place within the range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.folders import checkpointed, written


def running(rows: DataFrame, by: list[str], order: list[Column], amount: Column | None = None) -> DataFrame:
    """``rows`` with upto (the sum of ``amount``, or the number of rows, of the group up to and with this one in ``order``) and
    total (of the group). Rows that are equal in ``order`` must be in any order the same."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = rows.withColumn("_amount", F.lit(1) if amount is None else amount)
    laid = checkpointed(told.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    sums = laid.groupBy(*by, "_part").agg(F.sum("_amount").alias("_sum"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(group).alias("total"))
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return laid.join(offsets, [*by, "_part"]).withColumn("upto", F.col("_before") + F.sum("_amount").over(here)).drop("_amount", "_part", "_before")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the rank of ``value`` in its group from 1, where equal values share the mean of their places. Values are counted
    before they are ranked, so one that very many rows have is one row."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    ranked = running(counts, by, [F.col(value)], F.col("c")).select(*by, value, (F.col("upto") - (F.col("c") - 1) / 2.0).alias(name))
    return rows.join(ranked, [*by, value])


RANGE = 1 << 21  #: rows of a group that are ordered in one task, about; larger groups are dealt by ranges of their values
ROUND = 1 << 26  #: rows that are shuffled at a time, about


def _dealt(rows: DataFrame, by: list[str], value: str, sizes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with _range of ``value``, the highest first, and (by, _range, n, _before): the rows of each range's group, and those of its
    ranges before. Equal values are in one range, and which one doesn't depend on how rows were dealt."""
    count = -(-most // RANGE)
    if count <= 1:
        return rows.withColumn("_range", F.lit(0)), sizes.withColumns({"_range": F.lit(0), "_before": F.lit(0)})
    ends = checkpointed(rows.groupBy(*by).agg(F.percentile_approx(value, [k / count for k in range(1, count)], 10_000).alias("_ends")))
    # a few values by group
    laid = rows.join(F.broadcast(ends), by).withColumn("_range", F.when(F.col(value).isNull(), count).otherwise(F.size(F.filter("_ends", lambda e: e > F.col(value))))).drop("_ends")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    told = laid.groupBy(*by, "_range").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return laid, checkpointed(told.join(sizes, by).select(*by, "_range", "n", "_before"))


def _places(rows: DataFrame, by: list[str], value: str, keys: tuple[str, ...], sizes: DataFrame, most: int, rank: str) -> DataFrame:
    """``rows`` with upto, the place by falling ``value`` and ``keys``, n of the group, and ``rank``: that of ``value`` from the lowest, where equal values share
    the mean of their places. One shuffle and one sort by group and range."""
    laid, offsets = _dealt(rows, by, value, sizes, most)
    here = Window.partitionBy(*by, "_range")
    falling = here.orderBy(F.desc(value))
    told = laid.join(F.broadcast(offsets), [*by, "_range"])  # a row a group and range
    told = told.withColumns({"upto": F.col("_before") + F.row_number().over(here.orderBy(F.desc(value), *keys)), "_lo": F.rank().over(falling), "_hi": F.count("*").over(falling.rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    return told.withColumn(rank, F.when(F.col(value).isNotNull(), F.col("n") + 1 - F.col("_before") - (F.col("_lo") + F.col("_hi")) / 2.0)).drop("_range", "_before", "_lo", "_hi")


def lanes(rows: DataFrame, by: list[str], keys: tuple[str, ...] = ("ticker", "cutoff"), rank: str | None = None) -> DataFrame:
    """(by, n, rho, edge): rank correlation of score and relative return, and the mean return of the upper half by score less that of
    the lower (an odd middle is left out); null and 0 under four rows. ``rank`` is a column with the rank of the relative return, if it is known. No task holds a
    group of over about RANGE rows. Groups go through in rounds of about ROUND rows, so the disk that they need doesn't grow with their number."""
    # a row a group
    sizes = checkpointed(rows.groupBy(*by).agg(F.count("*").alias("n")))
    most, total = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rounds = max(1, min(-(-total // ROUND), sizes.count()))
    found = []
    for k in range(rounds):
        mine = F.pmod(F.xxhash64(*by), F.lit(rounds)) == k
        some, own = (rows.filter(mine), sizes.filter(mine)) if rounds > 1 else (rows, sizes)
        slim = some.select(*by, *keys, "score", "relative", *([rank] if rank else []))
        if not rank:
            slim = _places(slim, by, "relative", (), own, most, "_ry").drop("upto", "n")
        told = _lane(_places(slim, by, "score", keys, own, most, "_rx"), by, rank or "_ry")
        found.append(written(told) if rounds > 1 else told)
    return reduce(DataFrame.unionByName, found)


def _lane(placed: DataFrame, by: list[str], ry: str) -> DataFrame:
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    known = F.col("_rx").isNotNull() & F.col(ry).isNotNull()
    x, y = F.when(known, F.col("_rx")), F.when(known, F.col(ry))
    mean = lambda when: F.avg(F.when(when, F.col("relative")))
    rho = F.when(F.count_if(known) >= 4, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))
    edge = mean(F.col("upto") <= half) - mean(F.col("upto") > n - half)
    told = placed.groupBy(*by, "n").agg(F.round(rho, 6).alias("rho"), F.round(edge, 6).alias("edge"))
    return told.select(*by, "n", "rho", F.when(n >= 4, F.col("edge")).otherwise(0.0).alias("edge"))


def weighted_prefixes(rows: DataFrame, drawn: DataFrame, asked: DataFrame, order: list[Column], value: str, fan: int = 32) -> DataFrame:
    """(draw, q, sum): the sum of ``value`` over the first ``upto`` units of ``rows`` in ``order``, where a row stands for as many units
    as its bucket is drawn. ``drawn`` is (draw, bucket, times), ``asked`` (draw, q, upto).

    Rows are counted by ranges of rank and bucket, level by level, ``fan`` ranges to one of the level above. A question goes down
    the one range that holds its last unit, so it meets ``fan`` ranges by bucket a level, and never the rows."""
    spark = rows.sparkSession
    placed = checkpointed(running(rows.withColumn("_all", F.lit(1)), ["_all"], order).select("bucket", F.col(value).alias("v"), (F.col("upto") - 1).alias("at")))
    count = placed.count()
    depth = 1
    while fan**depth < count:
        depth += 1
    place = lambda level: F.floor(F.col("at") / float(fan ** (depth - level))).cast("long")
    found = asked.select("draw", "q", F.col("upto").alias("left"), F.lit(0).cast("long").alias("range"), F.lit(0.0).alias("sum"))
    for level in range(1, depth + 1):
        cells = placed.groupBy(place(level - 1).alias("range"), place(level).alias("child"), "bucket").agg(F.count("*").alias("c"), F.sum("v").alias("s"))
        met = found.join(cells, "range").join(drawn, ["draw", "bucket"])
        children = met.groupBy("draw", "q", "left", "sum", "child").agg(F.sum(F.col("c") * F.col("times")).alias("c"), F.sum(F.col("s") * F.col("times")).alias("s"))
        w = Window.partitionBy("draw", "q").orderBy("child")
        told = children.withColumns({"c_to": F.sum("c").over(w), "s_to": F.sum("s").over(w)})
        first = told.filter(F.col("c_to") >= F.col("left")).groupBy("draw", "q", "left", "sum").agg(F.min(F.struct("child", "c_to", "s_to", "c", "s")).alias("x"))
        found = first.select("draw", "q", (F.col("left") - (F.col("x.c_to") - F.col("x.c"))).alias("left"), F.col("x.child").alias("range"), (F.col("sum") + F.col("x.s_to") - F.col("x.s")).alias("sum"), F.col("x.c").alias("c"), F.col("x.s").alias("s"))
        if level < depth:
            found = checkpointed(found.drop("c", "s"))
    # the last range is one row: the units that are left are all of its value
    return found.select("draw", "q", (F.col("sum") + F.when(F.col("c") > 0, F.col("left") * F.col("s") / F.col("c")).otherwise(0.0)).alias("sum"))
