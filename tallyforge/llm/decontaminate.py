"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words, ``STRIDE`` apart, over every whole document, weighted by TF-IDF over the
benchmark's terms (other terms have no weight in any item). A randomised SVD of all passages and of the items finds the latent
space: passages are sums of blocks of ``STRIDE`` words, which are staged once; each task multiplies its blocks by a thin matrix and
sums what it gets, and only these sums of terms by ``RANK`` meet. A passage isn't looked up in the space if the words that the
last check would look at hold too few words of every item.
Passages whose latent vector has a cosine of ``COSINE`` or more with an item's are candidates. So that no match is left out, those
of lower cosine are candidates too where enough of an item's words are near the passage, whatever their order. The words themselves
decide: a longest common subsequence of ``COPY`` percent of the item's words is a leak; ``PARAPHRASE`` percent is one if the
item's answer (its last ``ANSWER`` words) is there too. Items longer than a window are found by
parts of equal size: around the passage that a part may stand in, the whole item decides, over a stretch of text as long as it
needs.

The benchmark is the stated query set. Its items go through in blocks of about ``ITEMS_BYTES``, each with one pass over the
documents; a block's terms share at most ``TERMS`` columns, so that the matrices on the driver and in a task have a
bound. Corpus counts (document frequencies) are over all passages.

Defined results: null texts are empty; an item without words matches nothing; rows that repeat an id count as one
document; a null id is reported as null; an empty table on either side gives no leaks; ``decontaminate`` keeps rows with
a null id and passes all columns through, whatever their names but those that begin with ``P``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.line_dedup import _NORMAL
from tallyforge.llm.staging import Workspace, text_of

P = "_d_"  #: prefix of working columns
WINDOW, STRIDE = 48, 16
RANK = 256
COSINE = 0.45
COPY, PARAPHRASE, ANSWER = 80, 60, 5
ITEMS_BYTES = 8 << 20  #: of the items that are looked for at a time, about
TERMS = 1 << 16  #: columns of the matrices; more different terms share them
HEAD = 128  #: columns, of the most common terms, that are multiplied densely


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_NORMAL).split()


def lcs(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``item``."""
    at: dict[bytes, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Items:
    """The benchmark as queries: items longer than a window are looked for by parts of equal size, and judged whole."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.whole: list[tuple[int, list[bytes]]] = [(i, w) for i, text in rows if (w := words_of(text or ""))]
        #: number of the item in ``whole``, the part's words, and the words of text to look at before and after a passage's first
        self.parts: list[tuple[int, list[bytes], int, int]] = []
        for k, (_, w) in enumerate(self.whole):
            edges = np.linspace(0, len(w), -(-len(w) // WINDOW) + 1).astype(int).tolist()
            for lo, hi in zip(edges, edges[1:]):
                self.parts.append((k, w[lo:hi], WINDOW + 3 * lo // 2, 2 * WINDOW + 3 * (len(w) - hi) // 2))
        uses = Counter(w for _, p, _, _ in self.parts for w in p)  # the most common terms have columns of their own, the first ones
        self.vocabulary = {w: k if k < TERMS else TERMS // 2 + k % (TERMS // 2) for k, w in enumerate(sorted(uses, key=lambda w: (-uses[w], w)))}
        self.columns = min(TERMS, len(self.vocabulary))
        self.rows = [np.unique([self.vocabulary[w] for w in p], return_counts=True) for _, p, _, _ in self.parts]


STRETCH = 64  #: blocks; a text's stretches are looked at as a whole first, with the blocks that their windows reach
CELLS = 1 << 22  #: stretches by items that are counted at a time


def _share(percent: int, n: int) -> int:
    return -(-percent * n // 100)


def _blocks(words: int) -> int:
    return -(-words // STRIDE)


class Reach:
    """Items whose windows reach about as far, by term: what a stretch of text holds of each is counted before its windows are. Where windows reach
    farther than a stretch, a text is one."""

    def __init__(self, guard: Guard, chosen: np.ndarray, before: int, after: int):
        self.chosen, self.before, self.after, self.whole = chosen, before, after, max(before, after) > STRETCH
        rows = [guard.rows[k] for k in chosen.tolist()]
        sizes = [len(r[0]) for r in rows]
        term, item = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(sizes)), sizes)
        count = np.concatenate([r[1] for r in rows])
        uses = np.bincount(term, minlength=guard.columns)
        common = uses > max(8, len(sizes) // 16)  # taken to be in every stretch
        self.ask = guard.least[chosen] - np.bincount(item, weights=count * common[term], minlength=len(sizes))  # of the other words
        order = np.argsort(term, kind="stable")
        order = order[~common[term[order]]]
        self.items, self.counts = item[order], count[order].astype(np.float64)
        self.starts = np.searchsorted(term[order], np.arange(guard.columns + 1))
        self.size = np.diff(self.starts)

    def asked(self, begins: np.ndarray, blocks: np.ndarray, owner: np.ndarray, block: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, texts): texts of which a stretch may hold enough words of the item."""
        parts_of = np.minimum(blocks, 1) if self.whole else -(-blocks // STRETCH)
        offset = np.cumsum(parts_of) - parts_of
        use = self.size[term] > 0
        at, t = block[use], term[use]
        text = owner[at]
        local = at - begins[text]
        home = offset[text]
        if self.whole:
            reached = home * len(self.size) + t
        else:
            s, within = local // STRETCH, local % STRETCH
            home = home + s
            back, on = (within < self.after) & (s > 0), (within >= STRETCH - self.before) & (s + 1 < parts_of[text])
            reached = np.concatenate([home, home[back] - 1, home[on] + 1]) * len(self.size) + np.concatenate([t, t[back], t[on]])
        once = np.unique(reached)
        stretch, t = once // len(self.size), once % len(self.size)
        n_items, n = len(self.chosen), int(parts_of.sum())
        whose = np.repeat(np.arange(len(blocks)), parts_of)
        found: dict[int, list[np.ndarray]] = {}
        step = max(1, CELLS // n_items)
        for low in range(0, n, step):
            high = min(n, low + step)
            lo, hi = np.searchsorted(stretch, [low, high])
            size = self.size[t[lo:hi]]
            each = np.arange(size.sum()) + np.repeat(self.starts[t[lo:hi]] - (np.cumsum(size) - size), size)
            cell = np.repeat(stretch[lo:hi] - low, size) * n_items + self.items[each]
            there = np.bincount(cell, weights=self.counts[each], minlength=(high - low) * n_items).reshape(-1, n_items)
            k, item = np.nonzero(there >= self.ask)
            order = np.argsort(item, kind="stable")
            k, item = whose[low + k[order]], item[order]
            first = np.flatnonzero(np.diff(item, prepend=-1))
            for p, texts in zip(item[first].tolist(), np.split(k, first[1:])):
                found.setdefault(p, []).append(texts)
        for p in sorted(found):
            yield int(self.chosen[p]), np.unique(np.concatenate(found[p]))


class Guard:
    """What a passage must hold to be a match: a share PARAPHRASE of an item's words must be in the blocks that the last check looks at for the
    item or a part of it, and COPY or the item's answer too. Nothing is said about their order, so no match is left out."""

    def __init__(self, items: Items):
        self.columns = items.columns
        self.rows = [np.unique([items.vocabulary[w] for w in words], return_counts=True) for _, words in items.whole]
        sizes = [len(words) for _, words in items.whole]
        self.least, self.copy = (np.array([_share(x, n) for n in sizes]) for x in (PARAPHRASE, COPY))
        self.answers = [(*np.unique([items.vocabulary[w] for w in words[-ANSWER:]], return_counts=True), _share(COPY, min(ANSWER, len(words)))) for _, words in items.whole]
        self.reach, self.parts = [p[2:] for p in items.parts], [[] for _ in items.whole]
        for p, (k, _, _, _) in enumerate(items.parts):
            self.parts[k].append(p)
        wide = np.array([max(_blocks(x) for p in some for x in self.reach[p]) for some in self.parts])
        cut = np.array([len(some) > 1 for some in self.parts])
        farthest = lambda side, chosen: max(_blocks(self.reach[p][side]) for k in chosen.tolist() for p in self.parts[k])
        kinds = (np.flatnonzero(x) for x in (~cut & (wide <= STRETCH), cut & (wide <= STRETCH), wide > STRETCH))
        self.reaches = [Reach(self, x, farthest(0, x), farthest(1, x)) for x in kinds if len(x)]
        self.scratch = np.zeros((2, items.columns), np.int64)

    def passes(self, begins: np.ndarray, blocks: np.ndarray, block: np.ndarray, term: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(text, first block, parts) of the windows that may match some part. Text k has ``blocks[k]`` blocks from ``begins[k]`` on; ``block``
        and ``term`` are distinct pairs, ascending."""
        owner = np.repeat(np.arange(len(blocks)), blocks)
        found: dict[tuple[int, int], list[int]] = {}
        last = begins + np.maximum(0, blocks - WINDOW // STRIDE)
        edge = np.searchsorted(block, np.append(begins, begins[-1] + blocks[-1] if len(begins) else 0))
        for reach in self.reaches:
            for item, texts in reach.asked(begins, blocks, owner, block, term):
                for part, windows in self._windows(block, term, edge, begins, last, owner, texts, item):
                    for w in windows.tolist():
                        d = int(owner[w])
                        found.setdefault((d, w - int(begins[d])), []).append(part)
        return [(d, w, sorted(parts)) for (d, w), parts in sorted(found.items())]

    def _windows(self, block: np.ndarray, term: np.ndarray, edge: np.ndarray, begins: np.ndarray, last: np.ndarray, owner: np.ndarray, texts: np.ndarray, item: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each part of ``item`` and the first blocks of the windows of ``texts`` that may match it. A term is in a run of windows around each of its
        places, less those that the place before is in, so a term counts once in a window."""
        size = edge[texts + 1] - edge[texts]
        at = np.arange(size.sum()) + np.repeat(edge[texts] - (np.cumsum(size) - size), size)
        (terms, counts), answer, (weight, told) = self.rows[item], self.answers[item], self.scratch
        weight[terms], told[answer[0]] = counts, answer[1]
        at = at[weight[term[at]] > 0]
        at = at[np.argsort(term[at], kind="stable")]
        t, b = term[at], block[at]
        d = owner[b]
        same = (t[1:] == t[:-1]) & (d[1:] == d[:-1])
        values = weight[t], told[t]
        weight[terms] = 0
        told[answer[0]] = 0
        for part in self.parts[item] if len(at) else []:
            before, after = map(_blocks, self.reach[part])
            lo, hi = np.maximum(b - after + 1, begins[d]), np.minimum(b + before, last[d])
            lo[1:] = np.where(same, np.maximum(lo[1:], hi[:-1] + 1), lo[1:])
            new = lo <= hi
            low, n = int(lo[new].min()), int(hi.max() - lo[new].min()) + 2
            total, said = (np.cumsum(np.bincount(lo[new] - low, weights=x[new], minlength=n) - np.bincount(hi[new] + 1 - low, weights=x[new], minlength=n)) for x in values)
            yield part, low + np.flatnonzero((total >= self.least[item]) & ((total >= self.copy[item]) | (said >= answer[2])))


CHUNK = 1 << 21  #: bytes of texts that are looked at together, about
ROW = 4096  #: blocks of a row of the staged blocks, about; a text is in one row


def passages(docs: DataFrame, shared, guard, work: Workspace) -> tuple[DataFrame, DataFrame, np.ndarray, int, int]:
    """(id, terms, counts, words, first, parts) of the passages that may match ``parts`` of items, where ``words`` reach as far to either side as these
    need and ``first`` is the place of the passage's first word in them; (terms, counts, sizes, texts) of all documents' blocks of words, some texts a
    row, with the number of terms of each block and of blocks of each text; the blocks that have each term; and the numbers of blocks and of passages. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, columns, span = shared.value.vocabulary, shared.value.columns, WINDOW // STRIDE
        numbers_of = pa.list_(pa.int32())
        kinds = {"id": pa.int64(), "terms": numbers_of, "counts": numbers_of, "words": pa.binary(), "first": pa.int32(), "parts": numbers_of, "sizes": numbers_of, "texts": numbers_of}
        total = np.zeros(columns + 2, np.int64)
        told = guard.value

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=[*kinds])

        def looked_at(ids: list, texts: list[list[bytes]]) -> list:
            sizes = np.array([len(t) for t in texts])
            blocks = -(-sizes // STRIDE)
            begins = np.cumsum(blocks) - blocks
            numbers = np.fromiter(map(vocabulary.get, chain.from_iterable(texts), repeat(-1)), np.int64, int(sizes.sum()))
            at = np.flatnonzero(numbers >= 0)
            owner = np.repeat(np.arange(len(texts)), sizes)[at]
            place = at - (np.cumsum(sizes) - sizes)[owner]
            pairs, count = np.unique((begins[owner] + place // STRIDE) * columns + numbers[at], return_counts=True)
            block, term = pairs // columns, pairs % columns
            total[:-2] += np.bincount(term, minlength=columns)
            total[-2:] += int(blocks.sum()), int(np.where(blocks, np.maximum(1, blocks - span + 1), 0).sum())
            rows = []
            held = np.bincount(block, minlength=int(blocks.sum()))
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(begins // ROW)) + 1):  # whole texts
                low, high = int(begins[some[0]]), int(begins[some[-1]] + blocks[some[-1]])
                lo, hi = np.searchsorted(block, [low, high])
                rows.append((None, term[lo:hi], count[lo:hi], None, None, None, held[low:high], blocks[some]))
            for d, k, parts in told.passes(begins, blocks, block, term):
                lo, hi = np.searchsorted(block, [begins[d] + k, begins[d] + min(k + span, int(blocks[d]))])  # none, if the item's words stand around the passage
                before, after = map(max, zip(*(told.reach[p] for p in parts)))
                begin = k * STRIDE
                first = min(begin, before)
                rows.append((ids[d], term[lo:hi], count[lo:hi], b" ".join(texts[d][begin - first : begin + after]), first, parts, None, None))
            return rows

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                ids.append(i)
                texts.append(words_of(text))
                size += len(text)
                if size >= CHUNK:
                    yield out(looked_at(ids, texts))
                    ids, texts, size = [], [], 0
            if texts:
                yield out(looked_at(ids, texts))
        k = np.flatnonzero(total)
        yield out([(None, k, total[k], None, None, None, None, None)])

    all_in = work.staged(docs.select("id", "text").mapInArrow(run, "id long, terms array<int>, counts array<int>, words binary, first int, parts array<int>, sizes array<int>, texts array<int>"), "passages")
    counts = np.zeros(shared.value.columns + 2, np.int64)
    sums = all_in.filter("words IS NULL AND sizes IS NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    for r in sums.collect():
        counts[r[0]] = r["n"]
    kept, blocks = all_in.filter("words IS NOT NULL").drop("sizes", "texts"), all_in.filter("sizes IS NOT NULL").select("terms", "counts", "sizes", "texts")
    return kept, blocks, counts[:-2], int(counts[-2]), int(counts[-1])


class Rows:
    """Sparse rows: their terms, one row's after another's (those that repeat add up), the TF-IDF of each, and its row."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        self.n, self.terms = len(sizes), terms
        self.owner, self.x = np.repeat(np.arange(len(sizes)), sizes), counts.astype(weights.dtype) * weights[terms]
        wide, few = min(HEAD, len(weights)), terms >= HEAD
        self.head = np.bincount(self.owner[~few] * wide + terms[~few], weights=self.x[~few], minlength=self.n * wide).reshape(self.n, wide).astype(weights.dtype)
        self.rest = np.flatnonzero(few)

    def times(self, thin: np.ndarray) -> np.ndarray:
        """The product with a thin matrix."""
        out = self.head @ thin[: self.head.shape[1]]
        _add(out, self.owner[self.rest], thin, self.terms[self.rest], self.x[self.rest])
        return out

    def transposed_times(self, right: np.ndarray, out: np.ndarray) -> None:
        """Adds the product of the transpose with ``right`` to ``out``."""
        out[: self.head.shape[1]] += self.head.T @ right
        order = self.rest[np.argsort(self.terms[self.rest], kind="stable")]
        _add(out, self.terms[order], right, self.owner[order], self.x[order])


def _add(out: np.ndarray, to: np.ndarray, values: np.ndarray, rows: np.ndarray, x: np.ndarray, step: int = 512) -> None:
    """Adds ``x`` times ``rows`` of ``values`` to the rows ``to`` of ``out``, which ascend; a little at a time, so that it stays in the caches."""
    for k in range(0, len(to), step):
        some = to[k : k + step]
        first = np.flatnonzero(np.diff(some, prepend=-1))
        part = values.take(rows[k : k + step], axis=0)
        part *= x[k : k + step, None]
        out[some[first]] += np.add.reduceat(part, first, axis=0)


def _sparse(terms: pa.Array, counts: pa.Array, weights: np.ndarray) -> Rows:
    flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
    return Rows(flat(terms), flat(counts), terms.value_lengths().to_numpy(zero_copy_only=False), weights)


def spread(blocks: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """From values of blocks, the sum over each block's passages of the sum over their blocks; ``texts`` are numbers of blocks."""
    owner = np.repeat(np.arange(len(texts)), texts)
    behind = np.repeat(np.cumsum(texts), texts) - np.arange(len(owner))  # blocks from this one to the text's end
    begin = behind == np.repeat(texts, texts)
    span = WINDOW // STRIDE
    sums = blocks.copy()
    for k in range(1, span):
        sums[:-k] += blocks[k:] * (behind[:-k] > k)[:, None]
    sums *= ((behind >= span) | begin)[:, None]  # of those that begin a passage
    out = sums.copy()
    for k in range(1, span):
        out[k:] += sums[:-k] * (behind[:-k] > k)[:, None]
    return out


def gram_times(blocks: DataFrame, weights, thin: np.ndarray) -> np.ndarray:
    """A'A times ``thin``, with A all passages of all documents, as sums of staged blocks: each task sums its rows, the sums meet by term."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(thin.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, thin = weights.value.astype(np.float32), shared.value
        out = np.zeros(thin.shape, np.float64)
        flat = lambda a: a.values.to_numpy(zero_copy_only=False)
        for b in batches:
            for k in range(b.num_rows):
                terms, counts, sizes, texts = (flat(c[k]) for c in b.columns)
                part = Rows(terms, counts, sizes, w)
                part.transposed_times(spread(part.times(thin), texts), out)
        k = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(list(out[k]), pa.list_(pa.float64()))], names=["term", "v"])

    sums = F.array(*[F.sum(F.get("v", F.lit(k))) for k in range(thin.shape[1])])
    total = np.zeros(thin.shape)
    parts = blocks.coalesce(max(1, spark.sparkContext.defaultParallelism))
    for r in parts.mapInArrow(run, "term long, v array<double>").groupBy("term").agg(sums.alias("v")).toLocalIterator():
        total[r["term"]] = r["v"]
    shared.unpersist()
    return total


def latent_space(blocks: DataFrame, passages: int, weights, items: Rows, seed: int = 7) -> np.ndarray:
    """Terms by RANK: right singular vectors of all passages and the items, which count as much as the passages do."""
    w = weights.value
    size = min(RANK, len(w))
    emphasis = max(1.0, passages / items.n)

    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(w), size)))[0]
    own = np.zeros(thin.shape)
    items.transposed_times(items.times(thin), own)
    product = gram_times(blocks, weights, thin) + emphasis * own
    # the matrix that this one product tells of is F F', with F below (Nystroem); the shift keeps the root real
    product += 1e-6 * np.linalg.norm(product, 2) * thin
    small = thin.T @ product
    root = np.linalg.cholesky((small + small.T) / 2)
    return np.linalg.svd(np.linalg.solve(root, product.T).T, full_matrices=False)[0]


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_column, item_column, lcs_words, item_words, answer_found): each document and item that match, by the best passage."""
    spark = docs.sparkSession
    schema = f"`{id_column}` long, `{item_column}` long, lcs_words long, item_words long, answer_found boolean"
    asked = benchmark.select(F.col(item_column).cast("long").alias("i"), text_of(item_text).alias("t"))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    blocks = 1 + (asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // ITEMS_BYTES
    found = []
    with Workspace(spark, "passages") as work:
        for k in range(blocks):
            part = asked.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
            items = Items([tuple(r) for r in part.orderBy("i", "t").collect()])
            if items.parts:
                found.append(work.keep(work.staged(_block_leaks(rows, items, work), "leaks")))
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    best = every.groupBy("id", "item").agg(F.max("m").alias("m")) if blocks > 1 else every
    return best.select(F.col("id").alias(id_column), F.col("item").alias(item_column), "m.*")


def _block_leaks(rows: DataFrame, items: Items, work: Workspace) -> DataFrame:
    """(id, item, m: the best passage's figures) of a block of items."""
    context = rows.sparkSession.sparkContext
    kept, blocks, df, n, n_passages = passages(rows, context.broadcast(items), context.broadcast(Guard(items)), work)
    weights = context.broadcast(np.log((n + 1) / (df + 0.5)).clip(0.01))
    asked = Rows(*(np.concatenate([r[k] for r in items.rows]) for k in (0, 1)), np.array([len(r[0]) for r in items.rows]), weights.value)
    space = latent_space(blocks, n_passages, weights, asked)
    queries = asked.times(space)
    queries /= np.linalg.norm(queries, axis=1, keepdims=True).clip(1e-12)
    shared = context.broadcast((space.astype(np.float32), queries.astype(np.float32), [(*items.whole[k], before, after) for k, _, before, after in items.parts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, queries, parts = shared.value
        w = weights.value.astype(np.float32)
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 1024):
                latent = _sparse(b.column(1).slice(at, 1024), b.column(2).slice(at, 1024), w).times(space)
                latent /= np.linalg.norm(latent, axis=1, keepdims=True).clip(1e-12)
                near = {(p, lo + q) for lo in range(0, len(queries), 4096) for p, q in zip(*(x.tolist() for x in np.nonzero(latent @ queries[lo : lo + 4096].T >= COSINE)))}
                left = {(p, q) for p, some in enumerate(b.column(5).slice(at, 1024).to_pylist()) for q in some}  # whatever their cosine
                for p, pairs in groupby(sorted(near | left), key=itemgetter(0)):
                    words, first = b.column(3)[at + p].as_py().split(b" "), b.column(4)[at + p].as_py()
                    for _, q in pairs:
                        item, asked, before, after = parts[q]
                        told = judged(asked, words[max(0, first - before) : first + after])
                        if told:
                            out.append((b.column(0)[at + p].as_py(), item, *told))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["id", "item", "lcs_words", "item_words", "answer_found"])

    matches = kept.mapInArrow(run, "id long, item long, lcs_words long, item_words long, answer_found boolean")
    return matches.groupBy("id", "item").agg(F.max(F.struct("lcs_words", "item_words", "answer_found")).alias("m"))


def judged(item: list[bytes], words: list[bytes]) -> tuple[int, int, bool] | None:
    """(longest common subsequence, words of the item, whether its answer is there) of a leak, else nothing."""
    n, answer = lcs(item, words), item[-ANSWER:]
    if 100 * n < PARAPHRASE * len(item):
        return None
    told = 100 * lcs(answer, words) >= COPY * len(answer)
    return (n, len(item), told) if 100 * n >= COPY * len(item) or (told and 100 * n >= PARAPHRASE * len(item)) else None


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the documents that match an item."""
    bad = leaks(docs, benchmark, id_column, text_column).select(F.col(id_column).alias(P + "id")).distinct()
    return docs.join(bad, F.col(id_column).cast("long") == F.col(P + "id"), "left_anti")
