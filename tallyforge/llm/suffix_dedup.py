"""Removal of repeated byte strings by sorted suffixes.

Every byte goes that a string of ``width`` bytes covers which also starts anywhere else. A corpus is too large for one
suffix array, so its suffixes are dealt out such that equal strings meet: of the ``GRAM``-byte substrings of a
string, the one with the least hash (leftmost if tied) is its anchor, and that depends on the string's bytes alone. Starts
with the same anchor are one segment. Segments whose anchor's bytes occur once can't repeat and are dropped; equal ones are
one entry that counts for several. The segments of an anchor meet in a block, whose suffixes are sorted in two stages:
a suffix that is smaller than its successor is sorted directly; the rest follow from scans of the buckets
of their first bytes, as each is its first byte before a suffix that is already placed. Common prefixes of neighbours
in that order are measured, and those of ``width`` bytes or more are repeats.

An anchor may stand in any number of different segments, which no block should hold. Where there are over ``CROWD``, the
segments are cut by how far before the anchor a string starts, into ``PARTS`` ranges; all strings of a range have the anchor
and some bytes around it in common, and these longer common bytes are the range's key. Cut again and again, a range is one
start at last and its key is the string itself. So equal strings still meet, and every block is sorted the same way.

Texts are known by their MD5; equal texts are handled once. Defined results: a null text is empty; rows that repeat a
text of ``width`` bytes or more lose all of it, whether or not they repeat the id too; a null id stays null; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.staging import Workspace, maybe_among, text_of

GRAM = 32  #: a power of two
CHUNK = 48_000  #: starts that are handled at a time; places in a chunk fit into 16 bits
BLOCK = 1 << 20  #: bytes of segments that are sorted together
CROWD, PARTS = 512, 4  #: segments of a key that meet in a block, at most; and the ranges into which more are cut
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * M1
    h ^= h >> np.uint64(29)
    step = 1
    while step < GRAM:
        h = h[:-step] * M2 + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    return h * M1


def segments(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, starts, bytes from the first start to the anchor) of each run of starts with the same anchor."""
    keys, firsts, counts, tops = [], [], [], []
    span = width - GRAM + 1
    for at in range(0, len(data) - width + 1, CHUNK):
        n = min(CHUNK, len(data) - width + 1 - at)
        h = gram_hashes(data[at : at + n + width - 1])
        low = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        place = (low & np.uint64(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        keys.append(h[place[first]].view(np.int64))
        firsts.append(first + at)
        counts.append(np.diff(np.append(first, n)))
        tops.append(place[first] - first)
    if not keys:
        return (np.empty(0, np.int64),) * 4
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(counts), np.concatenate(tops)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, step: int = 8192) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix of ``sa`` has in common with the next; all have as many."""
    windows = np.lib.stride_tricks.sliding_window_view(text, most)
    out = np.empty(max(0, len(sa) - 1), np.int64)
    for k in range(0, len(out), step):
        differs = windows[sa[k : min(k + step, len(out))]] != windows[sa[k + 1 : min(k + step, len(out)) + 1]]
        out[k : k + step] = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
    return out


def repeated_starts(parts: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment, whether each of its starts begins a string that also starts elsewhere in ``parts``."""
    data = b"".join(parts)
    text = np.frombuffer(data, np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    wanted = np.zeros(len(text) + 1, bool)
    for b, e in zip(begins, ends):
        wanted[b : e - width + 1] = True
    follows = np.append(text[1:], 0)
    later = np.append(text > follows, False)  # larger than the successor by its first byte: to be induced
    later[len(text) - 1] = False
    needed = wanted.copy()
    for _ in range(256):  # an induced suffix needs its successor placed; bytes fall along such a chain
        more = np.flatnonzero(needed[:-1] & later[:-1]) + 1
        more = more[~needed[more]]
        if not len(more):
            break
        needed[more] = True
    needed[len(text) :] = False
    direct = np.flatnonzero(needed & ~later).tolist()
    direct.sort(key=lambda p: data[p : p + width + 1])
    direct = np.array(direct, np.int64)
    heads = text[direct] if len(direct) else np.empty(0, np.uint8)
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    edges = np.searchsorted(heads, np.arange(257))
    for c in range(256):  # the bucket of a first byte: induced suffixes, which are smaller, then the direct ones
        bucket = np.concatenate([*placed[c], direct[edges[c] : edges[c + 1]]]) if placed[c] else direct[edges[c] : edges[c + 1]]
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[later[before] & needed[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for k, part in zip(cuts, np.split(before, cuts[1:])):
                placed[int(first[k])].append(part)
    repeated = np.zeros(len(text) + 1, bool)
    if order:
        sa = np.concatenate(order)
        sa = sa[wanted[sa]]
        same = common_prefixes(text, sa, width) >= width
        repeated[sa[:-1][same]] = repeated[sa[1:][same]] = True
    return [repeated[b : e - width + 1] for b, e in zip(begins, ends)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def _segment_rows(texts: DataFrame, width: int) -> DataFrame:
    """(d, keys, firsts, counts, tops) of each text, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [segments(np.frombuffer(t.as_py(), np.uint8), width) for t in b.column(1)]
            columns = [pa.array([f[k].astype(dtype) for f in found], pa.list_(kind)) for k, (dtype, kind) in enumerate(((np.int64, pa.int64()), *[(np.int32, pa.int32())] * 3))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["d", "keys", "firsts", "counts", "tops"])

    return texts.mapInArrow(run, "d binary, keys array<long>, firsts array<int>, counts array<int>, tops array<int>")


def _contexts(texts: DataFrame, width: int) -> DataFrame:
    """(key, c, d, first, top, context) of each segment of ``texts`` (d, b, parts); c names the context's bytes."""
    kinds = {"key": pa.int64(), "c": pa.binary(), "d": pa.binary(), "first": pa.int32(), "top": pa.int32(), "context": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for d, data, parts in zip(b.column(0), b.column(1), b.column(2)):
                d, data = d.as_py(), data.as_py()
                for p in parts.as_py():
                    context = data[p["first"] : p["first"] + p["starts"] + width - 1]
                    rows.append((p["key"], xxhash.xxh3_128_digest(context), d, p["first"], p["top"], context))
                    size += len(context) + 100
                    if size >= 1 << 22:
                        yield _batch(rows, kinds)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, kinds)

    return texts.mapInArrow(run, "key long, c binary, d binary, first int, top int, context binary")


def ranges(width: int, level: int) -> list[tuple[int, int]]:
    """The ranges (least, most) of bytes before the anchor at a level of cuts; each is in one of the level before."""
    out = [(0, width - GRAM)]
    for _ in range(level):
        out = [(lo + n * k // PARTS, lo + n * (k + 1) // PARTS - 1) for lo, hi in out for n in [hi - lo + 1] for k in range(PARTS) if n * k // PARTS < n * (k + 1) // PARTS]
    return out


def _narrowed(contexts: DataFrame, width: int, level: int) -> DataFrame:
    """(key, c, whole, shift, key2, c2, top, context): the parts of ``contexts`` (key, c, whole, top, context) by the
    ranges of ``level``, each with its own key; ``shift`` is the place of the part's first start in the whole."""
    kinds = {"key": pa.int64(), "c": pa.binary(), "whole": pa.bool_(), "shift": pa.int32(), "key2": pa.int64(), "c2": pa.binary(), "top": pa.int32(), "context": pa.binary()}
    cuts = ranges(width, level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, c, whole, top, context in zip(*(b.column(k).to_pylist() for k in range(5))):
                last = top - (len(context) - width)  # the offset of its last start
                for lo, hi in cuts:
                    begin, end = min(hi, top), max(lo, last)
                    if begin < end:
                        continue
                    shift = top - begin
                    part = context[shift : top - end + width]
                    shared = context[top - lo : top - hi + width]  # what all strings of the range have around the anchor
                    key2 = xxhash.xxh3_64_intdigest(shared, lo) - (1 << 63)
                    rows.append((key, c, whole, shift, key2, xxhash.xxh3_128_digest(part), begin, part))
            yield _batch(rows, kinds)

    return contexts.select("key", "c", "whole", "top", "context").mapInArrow(run, "key long, c binary, whole boolean, shift int, key2 long, c2 binary, top int, context binary")


def _sorted_blocks(contexts: DataFrame, width: int) -> DataFrame:
    """(key, c, begin, end): runs of repeated starts of each context (key, c, context), by blocks of whole keys."""
    dealt = contexts.repartition("key").sortWithinPartitions("key", "c")
    kinds = {"key": pa.int64(), "c": pa.binary(), "begin": pa.int32(), "end": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def out() -> pa.RecordBatch:
            return _batch([(k, c, *r) for (k, c, _), flags in zip(held, repeated_starts([h[2] for h in held], width)) for r in runs(flags)], kinds)

        for b in batches:
            for key, c, context in zip(*(b.column(k) for k in range(3)), strict=True):
                key = key.as_py()
                if key != last and size >= BLOCK:
                    yield out()
                    held, size = [], 0
                last = key
                held.append((key, c.as_py(), context.as_py()))
                size += len(held[-1][2])
        if held:
            yield out()

    return dealt.mapInArrow(run, "key long, c binary, begin int, end int")


def _repeated_runs(contexts: DataFrame, width: int, work: Workspace, level: int = 0) -> DataFrame:
    """(key, c, begin, end): runs of repeated starts of the staged ``contexts`` (key, c, whole, top, context)."""
    counts = contexts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sized = contexts.join(counts, "key")
    found = work.staged(_sorted_blocks(sized.filter(F.col("n") <= CROWD).select("key", "c", "context"), width), "runs")
    whole = contexts.filter("whole").select("key", "c", F.lit(0).alias("begin"), (F.octet_length("context") - (width - 1)).alias("end"))
    crowded = work.staged(sized.filter(F.col("n") > CROWD).drop("n"), "crowded")
    if crowded.isEmpty():
        return found.union(whole)
    parts = work.staged(_narrowed(crowded, width, level + 1), "parts")
    inner = parts.groupBy("key2", "c2").agg((F.max("whole") | (F.count("*") > 1)).alias("whole"), F.first("top").alias("top"), F.first("context").alias("context"))
    below = _repeated_runs(work.staged(inner.select(F.col("key2").alias("key"), F.col("c2").alias("c"), "whole", "top", "context"), "contexts"), width, work, level + 1)
    back = parts.select("key", "c", "shift", "key2", "c2").join(below.select(F.col("key").alias("key2"), F.col("c").alias("c2"), "begin", "end"), ["key2", "c2"])
    return found.union(whole).union(back.select("key", "c", F.col("begin") + F.col("shift"), F.col("end") + F.col("shift")))


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """(d, n_removed, n_spans, kept_sha256, kept) of each text (d, b, gone: runs of repeated starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, data, gone in zip(b.column(0), b.column(1), b.column(2)):
                data = data.as_py()
                mark = np.zeros(len(data) + 1, np.int32)
                for r in gone.as_py():
                    mark[r["begin"]] += 1
                    mark[r["end"] + width - 1] -= 1
                covered = np.cumsum(mark[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
                rows.append((d.as_py(), int(covered.sum()), len(runs(covered)), hashlib.sha256(kept).hexdigest(), kept))
            yield _batch(rows, {"d": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()})

    return texts.mapInArrow(run, "d binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_bytes(docs: DataFrame, width: int = 200, text_column: str = "text") -> DataFrame:
    """(d, n_removed, n_spans, kept_sha256, kept) of each different text that loses bytes to repeats between or within
    texts; ``d`` is the text's MD5. That a whole text occurs twice isn't looked at here."""
    b = F.encode(text_of(text_column), "UTF-8")
    rows = docs.select(F.unhex(F.md5(b)).alias("d"), b.alias("b")).filter(F.octet_length("b") >= width)
    with Workspace(docs.sparkSession, "suffixes") as work:
        found = work.staged(_segment_rows(rows, width), "segments")
        each = found.select("d", F.explode(F.arrays_zip("keys", "firsts", "counts", "tops")).alias("p"))
        each = each.select("d", F.col("p.keys").alias("key"), F.col("p.firsts").alias("first"), F.col("p.counts").alias("starts"), F.col("p.tops").alias("top"))
        place = F.xxhash64("d", "first")
        often = each.select("key", place.alias("p")).groupBy("key").agg(F.min("p").alias("low"), F.max("p").alias("high")).filter("low <> high").select("key")
        often = work.staged(often, "keys")
        parts = maybe_among(each, "key", often).join(often, "key").groupBy("d").agg(F.collect_set(F.struct("key", "first", "starts", "top")).alias("parts"))
        parts = work.staged(parts, "parts")
        work.drop(found, often)
        texts = maybe_among(rows, "d", parts).join(parts, "d").groupBy("d").agg(F.first("b").alias("b"), F.first("parts").alias("parts"))
        texts = work.staged(texts, "repeats")
        work.drop(parts)

        spots = _contexts(texts, width)
        seen = spots.withColumn("p", F.xxhash64("d", "first")).groupBy("key", "c").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.first("top").alias("top"), F.first("context").alias("context"))
        contexts = work.staged(seen.select("key", "c", (F.col("low") != F.col("high")).alias("whole"), "top", "context"), "contexts")
        gone = work.staged(_repeated_runs(contexts, width, work), "gone")

        # a context's runs, wherever it stands
        at = _contexts(texts, width).select("d", "first", "key", "c")
        marks = at.join(gone, ["key", "c"]).groupBy("d").agg(F.collect_set(F.struct((F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))).alias("gone"))
        return work.keep(work.staged(_cut(texts.select("d", "b").join(marks, "d"), width), "cut"))


def report(docs: DataFrame, width: int = 200) -> DataFrame:
    """For each document: its bytes, the bytes and runs removed, and the SHA-256 of what is left."""
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("d"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"))
    cut = repeated_bytes(docs, width).drop("kept")
    copies = rows.filter(F.col("n_bytes") >= width).groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d", F.lit(True).alias("copied"))
    both = rows.join(cut.join(copies, "d", "full"), "d", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    copied = F.coalesce("copied", F.lit(False))
    return both.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
