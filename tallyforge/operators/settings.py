"""Settings as trees: an overlay merged over a base, and what it moves.

Documents are parsed to VARIANT and unfolded to their leaves, level by level, so a tree is rows (id, path, value) and merging is
a join of paths. The rules of the merge: a value of the overlay replaces what the base has at its path, be that a value or
a whole subtree; a subtree merges into a subtree and replaces a single value; a null names nothing, so it deletes nothing, but a key that
the base lacks is added even with a null. An empty tree names nothing either. Trees deeper than ``DEPTH`` keep the rest as text in their last level's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 6  #: levels of keys


def leaves(docs: DataFrame) -> DataFrame:
    """(id, path, value) of documents (id, json): one row for each value or list, its keys joined by slashes; text, null for a null."""
    level = docs.select("id", F.lit("").alias("path"), F.try_parse_json("json").alias("v"))
    out = None
    for depth in range(DEPTH):
        level.createOrReplaceTempView("_settings_level")
        each = docs.sparkSession.sql("SELECT l.id, IF(l.path = '', t.key, l.path || '/' || t.key) AS path, t.value AS v FROM _settings_level l, LATERAL variant_explode(l.v) t WHERE t.key IS NOT NULL")
        each = each.filter(F.coalesce(F.schema_of_variant("v") != "OBJECT<>", F.lit(True)))
        tree = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT<")), F.lit(False))
        last = depth == DEPTH - 1
        found = (each if last else each.filter(~tree)).select("id", "path", F.expr("CAST(v AS STRING)").alias("value"))
        out = found if out is None else out.unionByName(found)
        level = each.filter(tree)
    return out


def _under(rows: DataFrame) -> DataFrame:
    """(id, above): every path that lies above one of the rows."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return rows.filter(F.size(parts) > 1).select("id", F.explode(above).alias("above")).distinct()


def overlaid(base: DataFrame, over: DataFrame) -> DataFrame:
    """(id, path, value, origin): the leaves of ``over`` merged over those of ``base``."""
    said = over.filter("value IS NOT NULL")
    whole = said.select("id", F.col("path").alias("above"))
    parts = F.split("path", "/")
    above = base.select("id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("above"))
    replaced = above.join(whole, ["id", "above"]).select("id", "path")  # a value of the overlay at the path or above it
    opened = base.select("id", "path").join(_under(said).withColumnRenamed("above", "path"), ["id", "path"])  # a subtree of the overlay at the path
    stays = base.join(replaced.union(opened).distinct(), ["id", "path"], "left_anti").select("*", F.lit("base").alias("origin"))
    there = base.select("id", "path").union(_under(base).withColumnRenamed("above", "path")).distinct()
    new_nulls = over.filter("value IS NULL").join(there, ["id", "path"], "left_anti")
    return stays.unionByName(said.select("*", F.lit("overlay").alias("origin"))).unionByName(new_nulls.select("*", F.lit("overlay").alias("origin")))


def drift(base: DataFrame, over: DataFrame) -> DataFrame:
    """(id, path, was, now): the overlay's values that aren't the base's; numbers are equal by value, and ``was`` is null for what the base lacks."""
    both = over.filter("value IS NOT NULL").join(base.withColumnRenamed("value", "was"), ["id", "path"], "left")
    same = F.coalesce(F.expr("try_cast(was AS DOUBLE) = try_cast(value AS DOUBLE)"), F.col("was") == F.col("value"), F.lit(False))
    return both.filter(~same).select("id", "path", "was", F.col("value").alias("now"))
