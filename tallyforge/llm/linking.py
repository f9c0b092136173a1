"""Links between rows that share keys, and the groups that the links make.

Postings are rows (key, id, info), all numbers. Two ids that share a key are candidates if ``fits`` holds for their infos at
that key. A key's ids are never all paired with one another: first every id is compared to a few of the key's ids, which is
linear and joins the members of a group of copies; ids that are still in another group than these few are compared to
other ones, in some rounds; then only keys whose ids still lie in different groups are left, and for these the pairs
across groups. What the first step has joined needs no further comparison, as groups
are all that is asked for. How many pairs are left to the second step is a matter of how rare the keys are that rows
share without being alike, so callers make their keys of several features each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.staging import Workspace, maybe_among

Fits = Callable[[Column, Column], Column]
Enough = Callable[[Column, Column, Column], Column]


def _pairs(rows: DataFrame, shared: DataFrame, enough: Enough | None) -> DataFrame:
    """Distinct pairs (a, b) of rows (a, b, x, y: their infos at a key); ``enough`` looks at how many keys of ``shared``
    they have in common, which are counted for these pairs alone."""
    found = rows.groupBy("a", "b").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    if enough is None:
        return found.select("a", "b")
    keys = shared.select("id", "key")
    mine = found.join(keys.withColumnRenamed("id", "a"), "a").join(keys.withColumnRenamed("id", "b"), ["b", "key"])
    return mine.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("x").alias("x"), F.min("y").alias("y")).filter(enough(F.col("c"), F.col("x"), F.col("y"))).select("a", "b")


def shared_postings(postings: DataFrame, work: Workspace) -> DataFrame:
    """The postings whose key has two ids or more, staged."""
    often = work.staged(postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "keys")
    shared = work.staged(maybe_among(postings, "key", often).join(often, "key"), "shared")
    work.drop(often)
    return shared


def star_pairs(rows: DataFrame, shared: DataFrame, fits: Fits, work: Workspace, enough: Enough | None, anchors: int, salt: int = 0) -> DataFrame:
    """The pairs (a, b) of a key's anchors with the ids of its other groups; ``rows`` are postings with the ids' groups.
    Anchors are the least id, or with a ``salt`` by a hash of it, and the least by other hashes. More anchors leave
    fewer ids of a group unlinked."""
    by = [F.xxhash64("id", F.lit(k + anchors * salt)) if k + salt else F.col("id") for k in range(anchors)]
    heads = rows.groupBy("key").agg(F.array(*[F.min_by(F.struct("id", "info", "group"), b) for b in by]).alias("heads")).select("key", F.explode(F.array_distinct("heads")).alias("head"))
    both = rows.join(heads, "key").filter((F.col("head.group") != F.col("group")) & fits(F.col("head.info"), F.col("info")))
    low, high = F.least("head.id", "id"), F.greatest("head.id", "id")  # two anchors may meet both ways
    turned = F.col("head.id") > F.col("id")
    x, y = F.when(turned, F.col("info")).otherwise(F.col("head.info")), F.when(turned, F.col("head.info")).otherwise(F.col("info"))
    return work.staged(_pairs(both.select(low.alias("a"), high.alias("b"), x.alias("x"), y.alias("y")), shared, enough), "star")


def split_keys(shared: DataFrame, groups: DataFrame, work: Workspace) -> DataFrame:
    """The postings, with their ids' groups, of keys that span groups (id, group), staged; ids without a group are their own."""
    named = shared.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    split = named.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("key")
    return work.staged(named.join(split, "key"), "across")


def rest_pairs(left: DataFrame, shared: DataFrame, tried: DataFrame, fits: Fits, work: Workspace, enough: Enough | None = None) -> DataFrame:
    """Pairs (a, b) of ``left`` that share a key across groups and weren't ``tried``."""
    one, two = left.select("key", F.struct("id", "info", "group").alias("x")), left.select("key", F.struct("id", "info", "group").alias("y"))
    both = one.join(two, "key").filter((F.col("x.id") < F.col("y.id")) & (F.col("x.group") != F.col("y.group")) & fits(F.col("x.info"), F.col("y.info")))
    pairs = _pairs(both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.info").alias("x"), F.col("y.info").alias("y")), shared, enough)
    return work.staged(pairs.join(tried, ["a", "b"], "left_anti"), "rest")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id, group), staged: the least id that can be reached from each id on an edge (a, b). Large-star and small-star
    steps in turn on staged edges, until these no longer change. A node's least neighbour is a small table of
    its own, so that Spark can split the join of a node with very many edges."""
    found = work.staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(found)
    while before[0]:
        both = found.union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = work.staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after_edges = work.staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        work.drop(found, least, large)
        found, after = after_edges, mark(after_edges)
        if after == before:
            break
        before = after
    heads = found.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct()
    groups = work.staged(found.select(F.col("u").alias("id"), F.col("v").alias("group")).union(heads), "groups")
    work.drop(found)
    return groups


def linked_pairs(postings: DataFrame, fits: Fits, verify: Callable[[DataFrame], DataFrame], work: Workspace, enough: Enough | None = None, anchors: int = 4, rounds: int = 1, finish: bool = True) -> DataFrame:
    """Enough verified pairs (a, b) to join all ids that any verified pair joins. ``verify`` stages the true ones;
    ``fits`` must hold at some shared key of a true pair, and ``enough`` (of the number of keys they share, and their
    infos) of the pair; both spare ``verify`` the others. Each round compares ids to new anchors outside their groups.
    Without ``finish`` what the rounds leave is the caller's."""
    shared = shared_postings(postings, work)
    left = shared.withColumn("group", F.col("id"))
    links = tried = None
    for n in range(rounds):
        star = star_pairs(left, shared, fits, work, enough, anchors, n)
        asked = star if tried is None else work.staged(star.join(tried, ["a", "b"], "left_anti"), "asked")
        found = verify(asked)
        links = found if links is None else links.union(found)
        tried = asked if tried is None else tried.union(asked)
        if not finish and n == rounds - 1:
            work.drop(shared, left)
            return links
        before, left = left, split_keys(shared, components(links, work), work)
        work.drop(before)
        if left.isEmpty():
            return links
    rest = rest_pairs(left, shared, tried, fits, work, enough)
    work.drop(shared, left)
    return links.union(verify(rest))
