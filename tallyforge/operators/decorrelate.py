"""Books without copies of one bet: in order of rank, an entry is kept only while it doesn't move with one that is kept.

The walk is greedy, so what is kept depends on all that was kept before. It needs no more than the first ``keep`` that are
kept, though: ranked entries meet the kept ones block by block, in one row a bucket, and only buckets that aren't full
read another block. A block is a top-k by rank, of which Spark sends no more than that from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.folders import checkpointed

LEAST = 12  #: points that two trails must have in common to be judged (fixed value)


def tail_correlation(one: Column, two: Column) -> Column:
    """Correlation of two trails (newest first) over their common last points; null under ``LEAST`` of them or without variance."""
    bound = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def of(k: Column) -> Column:
        x, y = F.slice(one, F.lit(1), k), F.slice(two, F.lit(1), k)
        apart = lambda a: bound(total(a) / k, lambda m: F.transform(a, lambda v: v - m))
        dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
        rho = lambda u, v: F.try_divide(dot(u, v), F.nullif(F.sqrt(dot(u, u) * dot(v, v)), F.lit(0.0)))
        return bound(apart(x), lambda u: bound(apart(y), lambda v: rho(u, v)))

    return bound(F.least(F.size(one), F.size(two)), lambda k: F.when(k >= LEAST, of(k)))


def greedy(ranked: DataFrame, caps: list[float], keep: int = 10, block: int = 40) -> DataFrame:
    """(bucket, cap, rn, id): of each bucket's entries (bucket, id, score, trail), the best ``keep`` by score and id of which no two have a
    correlation of ``cap`` or more, later ones giving way. A cap above 1 keeps all; pairs that can't be judged don't block."""
    w = Window.partitionBy("bucket").orderBy(F.desc("score"), "id")
    placed = ranked.withColumn("rn", F.row_number().over(w))
    entry = "struct<rn:int,id:string,trail:array<double>>"
    none = F.array().cast(f"array<{entry}>")
    live = ranked.select("bucket").distinct().select("bucket", F.explode(F.array(*map(F.lit, caps))).alias("cap"), none.alias("kept"))

    def fold(cap: Column, kept: Column, candidates: Column) -> Column:
        near = lambda held, c: F.exists(held, lambda k: F.coalesce(tail_correlation(c["trail"], k["trail"]) >= cap, F.lit(False)))
        return F.aggregate(candidates, kept, lambda held, c: F.when(F.size(held) >= keep, held).when((cap <= 1) & near(held, c), held).otherwise(F.concat(held, F.array(c))))

    done, out = 0, None
    while True:
        some = placed.filter((F.col("rn") <= done + block) & (F.col("rn") > done))
        rows = some.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "trail"))).cast(f"array<{entry}>").alias("block"))  # block rows at most
        met = live.join(rows, "bucket", "left").withColumn("block", F.coalesce("block", none))
        told = checkpointed(met.select("bucket", "cap", fold(F.col("cap"), F.col("kept"), F.col("block")).alias("kept"), (F.size("block") < block).alias("over")))
        full = told.filter(F.col("over") | (F.size("kept") >= keep)).select("bucket", "cap", F.inline("kept")).drop("trail")
        out = full if out is None else out.unionByName(full)
        live = told.filter(~F.col("over") & (F.size("kept") < keep)).drop("over")
        if live.isEmpty():
            return out
        done += block
