"""Sinks: the journal as JSON lines by day, keyed verdicts, and the payload of the viewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def journal_json(journal: DataFrame) -> DataFrame:
    """(day, line): a JSON line for each day, its rows as pairs of ticker and price in the order of rank; a missing price is null."""
    pair = lambda r: F.concat(F.regexp_replace(F.to_json(F.array(r["ticker"])), r"\]$", ","), F.coalesce(r["px"].cast("string"), F.lit("null")), F.lit("]"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker", "px"))), pair), ",")
    return journal.groupBy("day").agg(F.concat(F.lit('{"date":"'), F.first("day").cast("string"), F.lit('","rows":['), rows, F.lit("]}")).alias("line"))


def write_journal(journal: DataFrame, path: str) -> None:
    """Appends text lines in a folder for each day."""
    journal_json(journal).write.mode("append").partitionBy("day").text(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those that have their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def viewer_payload(ranked: DataFrame, by: str) -> DataFrame:
    """(payload): one JSON object with the first row of each class."""
    top = ranked.filter("place = 1").select(F.struct(*ranked.columns).alias("r"), by)
    return top.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by), F.col("r")))))).alias("payload"))
