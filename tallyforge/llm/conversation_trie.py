"""Conversation prefix trie: the turns that conversations begin with in common, with totals of each node's subtree.

A node is a distinct sequence of first turns (role, text); conversations that begin with it are its members. Prefixes are
known by 128 bits: the exclusive or of two hashes of each turn with its depth, which is a running aggregate of a conversation.

Totals go from the leaves to the root by messages. Nodes with the same smallest member follow one another on one path, so a
path stands for its nodes: it holds a counter of the paths that hang on it and haven't finished, a finished path sends its
totals to the path that it hangs on, whose counter falls by the number of messages, and so on until only the root's path
is left. Rounds are as many as paths hang on one another, not as many as turns; each round's unfinished paths are a table
in the shared folder. A node's totals are then those of its path below it, with what came in there.

Windows along a conversation are cut into blocks of ``BLOCK`` turn numbers or depths, whose totals are carried from block to
block, so that one very long conversation isn't one task. The ids of conversations that end at a node are joined for hashing in
chunks of ``CHUNK`` id numbers, and the hash reads chunk after chunk.

Defined results: turns are ordered by turn, null first, those of equal turn by role and text; a null role or text is
empty; rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.staging import Workspace, text_of

GROUP, SHARED = 20, 4  #: conversation c begins with turns of c - c % GROUP, fewer than SHARED of them
BLOCK, CHUNK = 4096, 4096
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "k1", "k2"]


def _running(rows: DataFrame, key: str, block: str, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """The staged ``rows`` with running aggregates along ``key``, this row included: counts and sums add up, and other aggregates are
    exclusive ors. Blocks are summed first, so that the window of a row only covers its block."""
    adds = {n: not n.startswith("k") for n in totals}
    agg = lambda n, c: F.sum(c) if adds[n] else F.bit_xor(c)
    both = lambda n, a, b: a + b if adds[n] else a.bitwiseXOR(b)
    sums = rows.groupBy(key, block).agg(*[agg(n, c).alias("b_" + n) for n, c in totals.items()])
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, block, *[F.coalesce(agg(n, F.col("b_" + n)).over(earlier), F.lit(0)).alias("b_" + n) for n in totals])
    here = Window.partitionBy(key, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.join(offsets, [key, block])
    return seen.withColumns({n: both(n, F.col("b_" + n), agg(n, c).over(here)) for n, c in totals.items()}).drop(*["b_" + n for n in totals])


def _tied(turns: DataFrame, talk: DataFrame, work: Workspace) -> DataFrame:
    """``talk`` with the place of each turn among different ones of the same number; texts are only read again for such."""
    same = talk.groupBy("conv_id", "turn").agg(F.min("t1").alias("low"), F.max("t1").alias("high")).filter("low <> high").select("conv_id", F.col("turn").alias("turn_"))
    same = work.staged(same, "tied")
    if same.isEmpty():
        return talk.withColumn("tie", F.lit(1))
    texts = turns.join(same, (turns["conv_id"] == same["conv_id"]) & turns["turn"].eqNullSafe(same["turn_"])).select(same["conv_id"], "turn", "role", "text", "t1", "t2")
    placed = texts.groupBy("conv_id", "turn", "t1", "t2").agg(F.min(F.struct("role", "text")).alias("said"))
    places = placed.select("conv_id", F.col("turn").alias("turn_"), "t1", "t2", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("said")).alias("tie"))
    far = places.withColumnsRenamed({"conv_id": "c_", "t1": "t1_", "t2": "t2_"})
    joined = talk.join(far, (F.col("conv_id") == F.col("c_")) & F.col("turn").eqNullSafe(F.col("turn_")) & (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_")), "left")
    return joined.select(*talk.columns, F.coalesce("tie", F.lit(1)).alias("tie"))


def rebuilt(turns: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, t1, t2, words) of each turn of the rebuilt conversations, and (conv_id, length) of them all, both staged."""
    talk = work.staged(turns.select("conv_id", "turn", "t1", "t2", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "talk")
    told = work.staged(_tied(turns, talk, work).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))), "told")
    order = [F.col("turn").asc_nulls_first(), F.col("tie")]
    numbered = work.staged(_running(told, "conv_id", "block", order, {"place": F.lit(1)}).select("conv_id", "place", "t1", "t2", "words"), "numbered")
    lengths = numbered.groupBy("conv_id").agg(F.max("place").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = numbered.filter((F.col("conv_id") % GROUP == 0) & (F.col("place") < SHARED)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "t1", "t2", "words"))).alias("heads"))
    asked = lengths.select("conv_id", "n", first.alias("base"), (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % SHARED).cast("int").alias("h"))
    met = asked.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("heads", F.when(F.col("h") > 0, F.slice(F.coalesce("heads", F.array().cast("array<struct<place:bigint,t1:bigint,t2:bigint,words:bigint>>")), F.lit(1), F.greatest("h", F.lit(1)))))
    convs = work.staged(met.select("conv_id", "n", "h", F.when(F.col("h") > 0, F.size("heads")).otherwise(0).alias("got"), "heads"), "convs")
    given = convs.select("conv_id", F.explode("heads").alias("x")).select("conv_id", F.col("x.place").alias("depth"), "x.t1", "x.t2", "x.words")
    own = numbered.join(convs.select("conv_id", "h", "got"), "conv_id").filter(F.col("place") > F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("got")).alias("depth"), "t1", "t2", "words")
    rows = work.staged(given.union(own), "rebuilt")
    return rows, convs.select("conv_id", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def prefixes(turns: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, ends), staged: each prefix of each rebuilt conversation, the empty one included, the prefix
    before it, the words of its last turn, and whether the conversation ends there."""
    rows, convs = rebuilt(turns, work)
    own = [F.xxhash64(F.lit(k), "depth", "t1", "t2") for k in (1, 2)]
    deep = rows.withColumns({"block": F.floor(F.col("depth") / BLOCK), "o1": own[0], "o2": own[1]})
    along = _running(deep, "conv_id", "block", [F.col("depth")], {"k1": F.col("o1"), "k2": F.col("o2")})
    steps = along.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("o1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("o2")).alias("p2"), "words")
    zero = F.lit(0).cast("long")
    whole = steps.union(convs.select("conv_id", zero, zero, zero, F.lit(None).cast("long"), F.lit(None).cast("long"), zero))
    return work.staged(whole.join(convs, "conv_id").select("*", (F.col("depth") == F.col("length")).alias("ends")).drop("length"), "prefixes")


def ends_digests(found: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end. A chunk holds the ids of one range of numbers, ascending."""
    ends = found.filter("ends").select(*NODE, F.floor(F.col("conv_id") / CHUNK).alias("chunk"), "conv_id")
    chunks = ends.groupBy(*NODE, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")]):
                if key == node:
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*NODE, "ends_sha256"])
                done = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], [*NODE, "ends_sha256"])

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids").mapInArrow(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def peeled(paths: DataFrame, work: Workspace) -> DataFrame:
    """(up, at, leaves, saved): the totals that finished paths have sent, by the path and the depth that they hang on. ``paths`` are
    staged rows (path, up, at, leaves, saved, waits)."""
    sent = None
    left = paths
    while True:
        ready = left.filter("waits = 0")
        if ready.isEmpty():
            break
        sent = ready if sent is None else sent.union(ready)
        news = ready.filter("up IS NOT NULL").groupBy("up").agg(F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("up", "path")
        told = left.filter("waits > 0").join(news, "path", "left")
        add = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        left = work.staged(told.select("path", "up", "at", add("leaves", "l"), add("saved", "s"), (F.col("waits") - F.coalesce("c", F.lit(0))).alias("waits")), "left")
    if sent is None:
        return paths.select("up", "at", "leaves", "saved")
    return work.staged(sent.filter("up IS NOT NULL").groupBy("up", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "sent")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, and of its subtree n_leaves and
    saved_tokens; ends_sha256 of the conversations that end there."""
    spark = conversations.sparkSession
    said = [text_of("role").alias("role"), text_of("text").alias("text")]
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *said)
    turns = turns.withColumns({"t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit(3), "text", "role")})
    with Workspace(spark, "conversations") as work:
        found = prefixes(turns, work)
        nodes = work.staged(found.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("words").alias("words")), "nodes")
        ends = work.staged(ends_digests(found), "ends")
        children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
        known = work.staged(nodes.join(children, NODE, "left").join(ends, NODE, "left").fillna(0, ["n_children"]), "known")
        above = known.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        own = [(F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("spared")]
        tree = work.staged(known.join(above, ["depth", "p1", "p2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", *own), "tree")
        tops = tree.filter("parent_conv_id IS NULL OR parent_conv_id <> conv_id").select(F.col("conv_id").alias("path"), F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at"))
        sums = tree.groupBy(F.col("conv_id").alias("path")).agg(F.sum("leaf").alias("leaves"), F.sum("spared").alias("saved"))
        waits = tops.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("waits"))
        paths = work.staged(tops.join(sums, "path").join(waits, "path", "left").fillna(0, ["waits"]), "paths")
        sent = peeled(paths, work)
        with_sent = tree.join(sent.select(F.col("up").alias("conv_id"), F.col("at").alias("depth"), "leaves", "saved"), ["conv_id", "depth"], "left")
        whole = work.staged(with_sent.select("*", (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("l"), (F.col("spared") + F.coalesce("saved", F.lit(0))).alias("s"), (-F.floor(F.col("depth") / BLOCK)).alias("block")).drop("leaves", "saved"), "whole")
        below = _running(whole, "conv_id", "block", [F.col("depth").desc()], {"n_leaves": F.col("l"), "saved_tokens": F.col("s")})
        empty = hashlib.sha256(b"").hexdigest()
        out = below.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
        return work.keep(work.staged(out, "trie"))
