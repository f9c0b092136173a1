"""Fuzzy line deduplication: SimHash and blocks of normalised lines, edit similarity, one occurrence a group.

A line is normalised to its words (bytes lowered and split at ASCII white space and punctuation, digits as 0); lines
without a word are left alone. Lines with the same words are one, however short. Two lines of ``FUZZY_CHARS`` characters
or more, spaces between words included, link when the edit similarity of their normalised forms (one minus edit distance
over the longer length) is 0.8 or more. The SimHash of such lines is up to 29 of 64 bits apart, too far for pigeonhole
blocks of its bits to be of use, so the blocks are made of the words: keys of several minimum hashes each, long words
counting more, and for lines of at most ``FEW_WORDS`` words the pigeonhole blocks of one changed word: the words without each
of them in turn, with the beginning or the end of that word if it is a large part of the line. Lines that meet in a block are
compared if their lengths allow it and their SimHashes of 48 bits are at most ``BITS`` apart: blocks join most groups at
little cost and decide nothing. Edits in every word leave lines no block in common, so all pairs of lines of like length
in different groups then go through the filter of ``edit_join``, which leaves none out. Of each connected
group the occurrence with the least (id, line number) stays and the others go.

Defined results: a null text is empty; rows with a null id are left as they are and take part in nothing; rows that repeat
an id and a line number count as the same occurrence, kept or removed together; an empty table gives no rows; columns of
the input pass through, whatever their names but those that begin with ``P``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.edit_join import linking_pairs
from tallyforge.llm.linking import components, linked_pairs
from tallyforge.llm.staging import Workspace, maybe_among, text_of

FUZZY_CHARS = 9  #: shorter normalised lines are only compared for equality; no line of five words is shorter
PERCENT = 80  #: edit similarity
FEW_WORDS, REST_BYTES = 8, 12  #: lines of so few words have keys without each word too, if so many bytes remain
ENOUGH = 12  #: longer words of a line that do without the short ones
BITS = 22  #: lines whose SimHashes of 48 bits differ by more are not compared
CHUNK = 1 << 18  #: bytes of whole lines that are hashed at a time
P = "_l_"  #: prefix of working columns
#: ASCII punctuation and control characters become spaces, capitals small, digits 0; line feeds stay for ``_LINES``.
_NORMAL = bytes(48 if 48 <= b < 58 else b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in range(256))
_LINES = bytes(10 if b == 10 else n for b, n in enumerate(_NORMAL))
#: Thirteen minimum hashes; a key has four of them, and two keys have one in common (lines of the projective plane of order 3:
#: the shifts of a perfect difference set). Lines of few words take two such keys together, as few words agree by chance.
HASHES, KEYS = 13, 8
_ROWS = [[(k + d) % HASHES for d in (0, 1, 3, 9)] for k in range(KEYS + 1)]
_ODD = np.random.default_rng(7).integers(0, 2**63, HASHES + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0xFFFF)  #: of a SimHash, the bits that are given to the line's length in characters
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: For SimHash: a byte's bits as eight counters of a byte each, the highest bit first.
_SPREAD = np.array([sum((b >> (7 - k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _LAST
    return x ^ (x >> np.uint64(29))


class Bytes:
    """Hashes of stretches of some bytes, as differences of running sums of powers."""

    def __init__(self, data: np.ndarray, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        powers = np.full(len(data) + 1, base, np.uint64)
        powers[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * np.cumprod(powers)[:-1], dtype=np.uint64)])
        powers[1:] = inverse
        self.back = np.cumprod(powers)

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[begins]) * self.back[begins])


def pieces(data: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the character n-grams of a long word: two characters in scripts of three bytes each, else four."""
    word = data[begin:end]
    starts = np.append(np.flatnonzero((word & 0xC0) != 0x80), len(word)) + begin
    size = min(2 if word.max() >= 0xE0 else 4, len(starts) - 1)
    return starts[: len(starts) - size], starts[size:]


def simhashes(hashes: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each line, whose words' hashes follow one another from its begin on."""
    spread = _SPREAD[hashes.astype(">u8").view(np.uint8)].reshape(-1, 8)
    sums = np.add.reduceat(spread, begins, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    for k in np.flatnonzero(counts > 255):  # more than a counter holds
        sums[k] = np.unpackbits(hashes[begins[k] : begins[k] + counts[k]].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0)
    return np.packbits(2 * sums > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


class Lines:
    """The lines of ``text`` that have a word: their numbers, their words and a 128-bit hash of these (``h1``, ``h2``)."""

    def __init__(self, text: bytes):
        self.data = data = np.frombuffer(text.translate(_LINES), np.uint8)
        inside = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        self.begins, self.ends = edge[::2], edge[1::2]
        self.line = np.cumsum(data == 10)[self.begins]
        self.one, two = Bytes(data, _ODD[-1]), Bytes(data, _ODD[-2])
        self.words = self.one.hashes(self.begins, self.ends)
        self.numbers, self.first = np.unique(self.line, return_index=True)
        self.n_words = np.diff(np.append(self.first, len(self.line)))
        self.owner = np.repeat(np.arange(len(self.numbers)), self.n_words)
        nth = (np.arange(len(self.line)) - self.first[self.owner]).astype(np.uint64)  # the line's hash knows its words' places
        self.h1 = mixed(np.add.reduceat(mixed(self.words + nth * _MIX), self.first)) if len(self.first) else np.empty(0, np.uint64)
        self.h2 = mixed(np.add.reduceat(mixed(two.hashes(self.begins, self.ends) ^ nth * _LAST), self.first)) if len(self.first) else np.empty(0, np.uint64)


def signed(text: bytes) -> tuple[np.ndarray, ...]:
    """Of each line of ``text``, all of which have a word: SimHash and length, keys and the number
    of keys, which follow one another. Words of up to five bytes, as the most common ones
    are, say nothing where ``ENOUGH`` others remain."""
    told = Lines(text)
    data, begins, ends, one, words, owner, n_words, first, numbers = told.data, told.begins, told.ends, told.one, told.words, told.owner, told.n_words, told.first, told.numbers
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n_chars = np.add.reduceat(chars[ends] - chars[begins], first) + n_words - 1
    n_bytes = np.add.reduceat(ends - begins, first) + n_words - 1

    size, hashes, lines = ends - begins, words, owner
    weight = np.clip((size - 2) // 2, 1, 5)
    if (size > 16).any():
        cut = [pieces(data, begins[k], ends[k]) for k in np.flatnonzero(size > 16)]
        more = np.repeat(owner[size > 16], [len(c[0]) for c in cut])
        hashes = np.concatenate([words[size <= 16], one.hashes(np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut]))])
        weight, lines = np.concatenate([weight[size <= 16], np.ones(len(more), np.int64)]), np.concatenate([owner[size <= 16], more])
        order = np.argsort(lines, kind="stable")
        hashes, weight, lines = hashes[order], weight[order], lines[order]
    long = weight > 1
    use = long | (np.bincount(lines[long], minlength=len(numbers)) < ENOUGH)[lines]
    hashes, lines, share = hashes[use], lines[use], (1.0 / weight[use]).astype(np.float32)
    counts = np.bincount(lines, minlength=len(numbers))
    at = np.cumsum(counts) - counts
    least = np.empty((HASHES, len(numbers)), np.uint64)
    for k in range(HASHES):
        least[k] = np.minimum.reduceat(((hashes * _ODD[k]) >> np.uint64(40)).astype(np.float32) * share, at).view(np.uint32)
    keys = np.empty((len(numbers), KEYS + 1), np.uint64)
    for k, rows in enumerate(_ROWS):
        keys[:, k] = k + 1
        for r in rows:
            keys[:, k] = mixed((keys[:, k] ^ least[r]) * _MIX)
    few = counts <= FEW_WORDS
    both = mixed(keys[few][:, :-1] * _MIX ^ keys[few][:, 1:])
    keys = keys[:, :-1]
    keys[few] = both
    fuzzy = n_chars >= FUZZY_CHARS
    blocks = mixed(words + np.uint64(1))  # of the words as a bag, less one of them
    bag = np.add.reduceat(blocks, first)
    few = n_words <= FEW_WORDS
    told = (few & fuzzy)[owner] & (n_bytes[owner] - size - 1 >= REST_BYTES)
    rest, small = bag[owner] - blocks, 4 * size <= n_bytes[owner]
    one_of = np.flatnonzero(told & small)  # any other short word in its place leaves the line similar
    long_one = np.flatnonzero(told & ~small)  # of a long word some must be left: its beginning or its end
    head, tail = one.hashes(begins[long_one], begins[long_one] + 3), one.hashes(ends[long_one] - 3, ends[long_one])
    more = np.concatenate([mixed(rest[one_of]), mixed(rest[long_one] ^ head), mixed(rest[long_one] * _MIX ^ tail)])
    mine = owner[np.concatenate([one_of, long_one, long_one])]
    whole = np.flatnonzero(few & fuzzy)
    wide = np.flatnonzero(fuzzy & (counts > 2))  # of one or two words there are no several to agree
    every = np.concatenate([keys[wide].ravel(), mixed(bag[whole]), more])
    owners = np.concatenate([np.repeat(wide, KEYS), whole, mine])
    order = np.argsort(owners, kind="stable")
    sims = simhashes(hashes, at, counts) & ~_LENGTH | np.minimum(n_chars, int(_LENGTH)).astype(np.uint64)
    return sims, every[order], np.bincount(owners, minlength=len(numbers))


def normal(line: str) -> str:
    return b" ".join(line.encode().translate(_NORMAL).split()).decode("utf-8")


def chunks(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Parts of whole lines of about ``CHUNK`` bytes, each with the number of its first line."""
    at, line = 0, 0
    while at <= len(text):
        end = text.find(b"\n", at + CHUNK)
        part = text[at:] if end < 0 else text[at:end]
        yield line, part
        if end < 0:
            return
        at, line = end + 1, line + part.count(b"\n") + 1


def _lines(rows: DataFrame, texts: bool = True) -> DataFrame:
    """(id, line, h1, h2, and with ``texts`` normal) of each line with a word; h1 and h2 are a 128-bit hash of its normalised form."""
    schema = "id long, line int, h1 long, h2 long" + ", normal string" * texts
    normal = texts

    def out(texts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        text = b"\n".join([t for _, _, t in texts])
        found = Lines(text)
        held = np.array([t.count(b"\n") + 1 for _, _, t in texts])
        begins = np.cumsum(held) - held
        owner = np.searchsorted(begins, found.numbers, side="right") - 1
        ids = np.array([i for i, _, _ in texts], np.int64)[owner]
        line = found.numbers - begins[owner] + np.array([n for _, n, _ in texts])[owner]
        columns = [pa.array(ids), pa.array(line.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (found.h1, found.h2)]]
        if normal:
            each = text.translate(_LINES).split(b"\n")
            columns.append(pa.array([b" ".join(each[k].split()) for k in found.numbers.tolist()], pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=["id", "line", "h1", "h2", "normal"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, size = [], 0
            for i, t in zip(b.column(0), b.column(1), strict=True):
                for line, part in chunks(t.as_py().encode()):
                    texts.append((i.as_py(), line, part))
                    size += len(part)
                    if size >= CHUNK:
                        yield out(texts)
                        texts, size = [], 0
            if texts:
                yield out(texts)

    return rows.mapInArrow(run, schema)


def _postings(unique: DataFrame) -> DataFrame:
    """(key, id, info) of lines (u, normal): each key of a line, the line, its SimHash and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = batch.column(0).to_numpy(), [], 0
            for n, t in enumerate(batch.column(1).to_pylist(), 1):
                held.append(t.encode())
                size += len(held[-1])
                if size >= CHUNK or n == len(ids):
                    sims, keys, counts = signed(b"\n".join(held))
                    columns = [keys.view(np.int64), np.repeat(ids[n - len(held) : n], counts), np.repeat(sims.view(np.int64), counts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "info"])
                    held, size = [], 0

    return unique.select("u", "normal").mapInArrow(run, "key long, id long, info long")


def within(x: str, y: str, most: int) -> bool:
    """Whether ``most`` edits or fewer turn ``x`` into ``y``. What they begin and end with alike is cut off; the rest is
    Myers' bit-parallel column, one bit for each character of the shorter."""
    if abs(len(x) - len(y)) > most:
        return False
    k, n = 0, min(len(x), len(y))
    while k < n and x[k] == y[k]:
        k += 1
    end = 0
    while end < n - k and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = sorted((x[k : len(x) - end], y[k : len(y) - end]), key=len)
    if len(y) <= most:  # as many substitutions and insertions do
        return True
    uses = Counter(y)
    uses.subtract(x)
    if sum(n for n in uses.values() if n > 0) > most:  # so many characters must come from somewhere
        return False
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << (len(x) - 1)
    plus, minus, score = full, 0, len(x)
    for left, c in enumerate(y):
        m = at.get(c, 0)
        d = ((((m & plus) + plus) ^ plus) | m | minus) & full
        up, down = (minus | ~(d | plus)) & full, plus & d
        score += bool(up & top) - bool(down & top)
        if score - (len(y) - left - 1) > most:
            return False
        up = (up << 1 | 1) & full
        plus, minus = (down << 1 | ~(d | up)) & full, up & d
    return score <= most


def similar(x: str, y: str) -> bool:
    return within(x, y, (100 - PERCENT) * max(len(x), len(y)) // 100)


def similar_pairs(pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, x, y) whose texts have the edit similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            kept = pa.array([similar(p, q) for p, q in zip(x, y)], pa.bool_())
            yield batch.select([0, 1]).filter(kept)

    return pairs.mapInArrow(run, "a long, b long")


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lines): the numbers, from 0, of the lines that each document loses. Documents that lose none aren't listed."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text")).filter("id IS NOT NULL")
    with Workspace(docs.sparkSession, "lines") as work:
        same = _lines(rows).groupBy("h1", "h2").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"), F.first("normal").alias("normal"))
        unique = work.staged(same.withColumn("u", F.monotonically_increasing_id()), "unique")
        postings = work.staged(_postings(unique), "postings")

        def fits(x: Column, y: Column) -> Column:
            length = lambda c: c.bitwiseAND(F.lit(int(_LENGTH)))
            near = 100 * F.least(length(x), length(y)) >= PERCENT * F.greatest(length(x), length(y)) - 100
            return near & (F.bit_count(F.shiftrightunsigned(x.bitwiseXOR(y), 16)) <= BITS)

        def verify(pairs: DataFrame) -> DataFrame:
            asked = work.staged(pairs.select(F.col("a").alias("u")).union(pairs.select("b")).distinct(), "asked")
            texts = work.staged(maybe_among(unique.select("u", "normal"), "u", asked).join(asked, "u"), "normal")
            both = pairs.join(texts.select(F.col("u").alias("a"), F.col("normal").alias("x")), "a").join(texts.select(F.col("u").alias("b"), F.col("normal").alias("y")), "b")
            links = work.staged(similar_pairs(both.select("a", "b", "x", "y")), "links")
            work.drop(asked, texts)
            return links

        links = linked_pairs(postings, fits, verify, work, anchors=3, rounds=2, finish=False)
        work.drop(postings)
        so_far = components(links, work).withColumnRenamed("id", "u")
        texts = unique.join(so_far, "u", "left").select("u", F.coalesce("group", "u").alias("grp"), F.length("normal").alias("n"), F.col("normal").alias("text"))
        groups = components(links.union(linking_pairs(texts, similar, work)), work).withColumnRenamed("id", "u")
        named = unique.select("h1", "h2", "u", "first", "n").join(groups, "u", "left").withColumn("group", F.coalesce("group", "u"))
        kept = named.groupBy("group").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).filter("n > 1").drop("n")
        marked = work.staged(named.join(kept, "group").select("h1", "h2", "keep"), "marked")
        gone = maybe_among(_lines(rows, texts=False), "h1", marked).join(marked, ["h1", "h2"]).filter(F.struct("id", "line") != F.col("keep"))
        return work.keep(work.staged(gone.groupBy("id").agg(F.collect_set("line").alias("lines")), "removed"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the text that is left, and P + ``lines``, P + ``removed``: lines before and lines removed."""
    removed = removals(docs, id_column, text_column)
    gone = removed.select(F.col("id").alias(P + "id"), F.col("lines").alias(P + "gone"))
    text = F.split(text_of(text_column), "\n", -1)
    keyed = docs.withColumn(P + "key", F.col(id_column).cast("long"))
    some, rest = maybe_among(keyed, P + "key", gone), maybe_among(keyed, P + "key", gone, others=True)
    both = some.join(gone, F.col(P + "key") == F.col(P + "id"), "left").unionByName(rest.withColumns({P + "id": F.lit(None).cast("long"), P + "gone": F.lit(None).cast("array<int>")})).drop(P + "key")
    left = F.when(F.col(P + "gone").isNull(), F.col(text_column)).otherwise(F.array_join(F.filter(text, lambda x, i: ~F.array_contains(P + "gone", i)), "\n"))
    return both.withColumns({P + "lines": F.size(text).cast("long"), P + "removed": F.coalesce(F.size(P + "gone"), F.lit(0)).cast("long"), text_column: left}).drop(P + "id", P + "gone")


def rewrite(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars") -> DataFrame:
    """``docs`` with their columns and the text that is left, without the documents that lost their last line of words;
    ``size_column``, where there is one, has the new length."""
    found = dedup_lines(docs, id_column, text_column)
    found = found.filter((F.col(P + "removed") == 0) | F.col(text_column).rlike(r"[^\x20\x09-\x0D]"))
    if size_column in docs.columns:
        found = found.withColumn(size_column, F.length(text_of(text_column)).cast(docs.schema[size_column].dataType))
    return found.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """For each document: its lines, those removed, the characters left and the SHA-256 of the text that is left."""
    text = text_of()
    return dedup_lines(docs).select("doc_id", F.col(P + "lines").alias("n_lines"), F.col(P + "removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))
