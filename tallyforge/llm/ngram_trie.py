"""N-gram Jaccard join by a prefix tree of globally ordered shingle sets.

A document is the set of its distinct ``size``-word shingles, as 63-bit hashes in one global order: frequent shingles
last, else by hash. Two sets that are similar enough share a member among their first few, so those are the keys under
which documents meet. Candidates of a document are put into a trie of their ordered sets (sorted sets, each with the
length of what it shares with the one before it). The traversal counts overlaps with the document's own set once for each
shared path, and leaves a subtree when the overlap so far and the members that remain can't reach the threshold.

Equal sets are one class, compared once. Only frequent shingles' order, a bounded hint that any order could replace
without a change of results, is sent to all executors.

Defined results: a null or wordless text has the empty set, n_shingles 0, and links to nothing; a row with a null id
takes part in no link and its component is null; rows that repeat an id count as one document with all their links;
other columns are ignored or pass through, whatever their names but those that begin with ``P``. Hashes stand for shingles: two different shingles of two compared
documents agree with probability 2^-63 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.linking import components, linked_pairs
from tallyforge.llm.staging import Workspace, maybe_among, text_of

P = "_n_"  #: prefix of working columns
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]  # odd multipliers
HEAVY = np.uint64(1 << 63)
LOCAL, LEAST, MOST = 8, 32, 200_000  #: frequent shingles: uses in a block of documents, in all, and how many are ordered


class Words(dict):
    """64-bit hashes of words seen by this worker; at ``most`` entries it starts anew."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def shingles(text: str, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, below 2^63, ascending. Words are runs without ASCII white space, A-Z lowered."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    get = _WORDS
    h = np.array([get[w] for w in words], np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out += h[k : k + n] * MIX[k]
    out ^= out >> np.uint64(32)
    out *= MIX[-1]
    out ^= out >> np.uint64(29)
    out += np.uint64(min(size, len(h)))  # a short text's only shingle is none of a longer text's
    return np.unique(out >> np.uint64(1))


def ordered(keys: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The set in the global order; ``heavy``: frequent shingles ascending, which come last by their place there."""
    if len(heavy) and len(keys):
        at = np.searchsorted(heavy, keys)
        hit = heavy[np.minimum(at, len(heavy) - 1)] == keys
        if hit.any():
            return np.concatenate([keys[~hit], np.sort(at[hit].astype(np.uint64)) | HEAVY])
    return keys


def least_overlap(n: int, percent: int) -> int:
    """Members that a set of ``n`` shares with any set that is similar enough, at least."""
    return -(-percent * n // 100)


def frequent(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles, ascending: at most MOST numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(keys[often].astype(np.int64)), pa.array(n[often])], names=["key", "n"])

        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py(), size))
                total += len(held[-1])
                if total >= 4_000_000:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    rows = counts.orderBy(F.desc("n"), "key").limit(MOST).select("key").collect()
    return np.sort(np.array([r[0] for r in rows], np.uint64))


def signatures(docs: DataFrame, size: int, percent: int, heavy) -> DataFrame:
    """(id, n, d1, d2, head): set size, 128-bit digest of the set, and the first members in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = heavy.value
        for b in batches:
            rows = []
            for t in b.column(1):
                s = shingles(t.as_py(), size)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                head = ordered(s, last)[: len(s) - least_overlap(len(s), percent) + 1]
                rows.append((len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), head.view(np.int64)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n", "d1", "d2", "head"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, head array<long>")


def similar(members: list[tuple[int, np.ndarray]], anchor: np.ndarray, percent: int) -> list[int]:
    """Ids of ``members`` whose set is similar enough to ``anchor``, by one traversal of the members' trie: in the order
    of a walk through it, a member goes on from where it leaves the path of the one before. ``path[d]`` is the overlap of
    the first d members. Where the overlap so far and what remains on either side can't reach the threshold, the
    subtree is left, and members that begin with the same path are told at its end."""
    n, out = len(anchor), []
    members.sort(key=lambda m: m[1].tobytes())  # any order that keeps equal beginnings together
    before, path, place = np.empty(0, np.uint64), np.zeros(1, np.int64), 0  # place: members of the anchor up to the path's end
    for i, s in members:
        m = len(s)
        need = -(-percent * (n + m) // (100 + percent))
        if need > min(n, m):
            continue
        k = min(len(before), m, len(path) - 1)
        differs = np.flatnonzero(before[:k] != s[:k])
        depth = int(differs[0]) if len(differs) else k
        so_far = int(path[depth])
        if so_far + min(m - depth, n - (place if depth == len(path) - 1 else so_far)) < need:
            continue  # the path that is kept is a beginning of this member too, or shorter
        parts, stop = [path[: depth + 1]], False
        for at in range(depth, m, 256):
            part = s[at : at + 256]
            found = np.searchsorted(anchor, part)
            hit = anchor[np.minimum(found, n - 1)] == part
            parts.append(so_far + np.cumsum(hit))
            so_far, place = int(parts[-1][-1]), int(found[-1]) + int(hit[-1])
            if so_far + min(m - at - len(part), n - place) < need:
                stop = True
                break
        before, path = s, np.concatenate(parts)
        if not stop and 100 * so_far >= percent * (n + m - so_far):
            out.append(i)
    return out


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, heavy, block: int = 512) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Members of a document's trie come in blocks, dealt by hash."""
    keyed = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(64)))
    members = keyed.join(docs, F.col("b") == F.col("id")).select("a", "block", "b", "text")
    anchors = keyed.select("a", "block").distinct().join(docs, F.col("a") == F.col("id")).select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(anchors).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, key, anchors, held = heavy.value, None, [], []  # an id that repeats has several texts

        def out() -> pa.RecordBatch:
            found = sorted({b for anchor in anchors for b in similar(held, anchor, percent)})
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, k, b, t in zip(*(batch.column(c) for c in range(4)), strict=True):
                s = ordered(shingles(t.as_py(), size), last)
                here = (a.as_py(), k.as_py())
                if held and (here != key or len(held) >= block):
                    yield out()
                if here != key:
                    key, anchors = here, []
                if b.as_py() is None:
                    anchors.append(s)
                else:
                    held.append((b.as_py(), s))
        if held:
            yield out()

    return rows.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, size: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: its id, the size of its shingle set, and the least id that links reach from it."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    heavy = docs.sparkSession.sparkContext.broadcast(frequent(rows, size))
    with Workspace(docs.sparkSession, "ngrams") as work:
        whole = work.staged(signatures(rows, size, percent, heavy), "shingles")
        classes = work.staged(whole.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min(F.struct("id", "n", "head")).alias("x"), F.count("*").alias("copies")), "classes")
        signed = work.staged(whole.drop("head"), "sizes")
        work.drop(whole)
        postings = classes.select("x.*").select(F.col("id"), "n", F.posexplode("head").alias("at", "key")).select("key", "id", (F.shiftleft("n", 32) + F.col("at")).alias("info"))  # size and place in one number

        size_of, place_of = lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
        ceiling = lambda share, whole: F.floor((percent * share + (whole - 1)) / whole)

        def least_shared(n: Column, m: Column) -> Column:
            """Beyond its head a set has one less than the overlap that it needs itself; the rest is shared in the heads."""
            return F.greatest(ceiling(n + m, 100 + percent) - ceiling(F.greatest(n, m), 100) + 1, F.lit(1))

        def fits(x: Column, y: Column) -> Column:
            """Whether a key can be the first that two similar sets share: enough members follow, and enough of the heads."""
            n, m, p, q = size_of(x), size_of(y), place_of(x), place_of(y)
            head = lambda k: k - ceiling(k, 100) + 1
            close = 100 * F.least(n, m) >= percent * F.greatest(n, m)
            return close & (F.least(n - p, m - q) >= ceiling(n + m, 100 + percent)) & (F.least(head(n) - p, head(m) - q) >= least_shared(n, m))

        def enough(c: Column, x: Column, y: Column) -> Column:
            return c >= least_shared(size_of(x), size_of(y))

        def verify(pairs: DataFrame) -> DataFrame:
            ids = work.staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
            texts = work.staged(maybe_among(rows, "id", ids).join(ids, "id", "left_semi"), "texts")
            links = work.staged(verified(pairs, texts, size, percent, heavy), "links")
            work.drop(ids, texts)
            return links

        links = linked_pairs(postings, fits, verify, work, enough)
        copies = signed.filter("n > 0 AND id IS NOT NULL").join(classes.filter("copies > 1").select("d1", "d2", F.col("x.id").alias("head_id")), ["d1", "d2"]).select(F.col("head_id").alias("a"), F.col("id").alias("b"))
        groups = components(links.union(copies), work)
        found = work.keep(work.staged(signed.select("id", "n").join(groups, "id", "left"), "components"))
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("group", "id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the least id of each group of near copies. Rows that repeat an id stay or go together."""
    found = near_copies(docs, size, percent, id_column, text_column)
    gone = found.filter(F.col("component_id") != F.col(id_column)).select(F.col(id_column).alias(P + "id")).distinct()
    return docs.join(gone, F.col(id_column).cast("long") == F.col(P + "id"), "left_anti")
