"""Filter audit: what five filters remove in each of their 120 orders, alone, together, and at whose cost.

A document's failures are a mask of five bits, one for each filter. Everything that an order of the filters does to a part
of the corpus follows from how many of its documents have each of the 32 masks: a filter removes what fails it and none of
the filters before it. So the texts are read once, 32 counts a part are summed, and the orders are walked over these counts.

The last filter, ``E``, compares texts across the table: a text's least doc_id is found by grouping digests of texts, with
counts by part, mask and label beside it, so that a text with very many copies is a few rows after the first step of each task.

DataFrame expressions only. The texts aren't shuffled: digests (SHA-256), masks and ids are.

Defined results: a null text is empty; a null doc_id has no label and is compared to no other document, so it doesn't fail
``E``; rows that repeat a doc_id are counted each, and equal ids are not smaller than one another; a null lang is the part
'', like an empty one; labels that repeat a doc_id count once (a document is good or toxic if any of them says so), and null
labels say nothing; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.staging import text_of

LETTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = "#$%&*|"
SPACE = r"\x20\x09-\x0D"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    sizes = F.element_at(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different"))), 1)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bits = lambda s: F.when(s["n"] < MIN_WORDS, 1).otherwise(0) + F.when(100 * s["different"] < DISTINCT_PERCENT * s["n"], 2).otherwise(0)
    of_words = F.element_at(F.transform(F.array(sizes), bits), 1)
    return of_words + F.when(100 * upper > UPPER_PERCENT * F.length(text), 4).otherwise(0) + F.when(text.rlike(f"[{SYMBOLS}]"), 8).otherwise(0)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part with each mask, those labelled good, those labelled toxic."""
    text = text_of()
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0)).alias(f) for c, f in (("quality", "good"), ("toxic", "toxic"))])
    told = seen.join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    # equal rows first, as an id may be repeated, then the copies of a text that are alike in all that is counted
    rows = told.groupBy("doc_id", "digest", "mask", "part", "good", "toxic").agg(F.count("*").alias("c"))
    kinds = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("unnamed"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("first")
    )
    each = kinds.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    kept = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    halves = each.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))).alias("h"))
    n = F.col("h.n")
    return halves.filter(n > 0).groupBy("part", F.col("h.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def _bits(letters) -> int:
    return sum(1 << LETTERS.index(x) for x in letters)


def orders(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, mask, n, good, toxic). A part is one row of
    three arrays of 32 counts before the orders are listed."""
    names = ("n", "good", "toxic")
    by_mask = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(32)])
    parts = cells.groupBy("part").agg(*[by_mask(c).alias(c) for c in names])
    walks = [("".join(p), k + 1, _bits(p[k]), _bits(p[:k])) for p in permutations(LETTERS) for k in range(len(p))]
    fields = ("filter_order", "step", "own", "before")
    marked = parts.select("part", *names, F.inline(F.array(*[F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, w)]) for w in walks])))
    own, before = F.col("own"), F.col("before")
    has = lambda m, bits: m.bitwiseAND(bits) != 0

    def total(column: str, holds) -> Column:
        return F.aggregate(F.transform(column, lambda x, m: F.when(holds(m), x).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)

    removed = lambda m: has(m, own) & ~has(m, before)
    share = lambda m: F.lit(120) / F.bit_count(m)  # noqa: E731  a filter comes first of the k that a document fails in 120 / k orders
    shapley = F.aggregate(F.transform("n", lambda x, m: F.when(has(m, own), x * share(m).cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)
    return marked.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~has(m, own + before)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: has(m, own) & has(m, before)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over ``docs``: a row for each part, each order and each step of it."""
    return orders(mask_counts(docs, labels))
