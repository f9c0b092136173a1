"""Token counts by byte-pair merging over a heap and a linked list.

A pre-token starts as one symbol a byte. The heap holds the rank and place of every adjacent pair that may merge;
the lowest is popped, its two symbols are joined in the linked list, and the pairs that this makes are pushed.
Each merge takes one symbol away, so the count is bytes minus merges and no identifier is ever made.

Defined results: a null text is empty and counts 0 bytes and 0 tokens; repeated rows give repeated rows; a null
id stays null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe_tables import SPACE, BpeTables, Splitter
from tallyforge.llm.staging import text_of

SHIFT = 24  #: a heap entry is rank << SHIFT | place; longer pre-tokens use a wider one
#: Pre-token patterns of the vocabulary's byte-level splitter; the first is for texts of ASCII only.
ASCII_WORDS = re.compile("'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
WORDS = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

SPLITTER = Splitter(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", ASCII_WORDS, WORDS)


def pair_table(tables: BpeTables) -> tuple[list[int], dict[int, int]]:
    """The symbol of each byte, and for a pair ``left << 20 | right`` its ``rank << 20 | joined symbol``."""
    number = {s: i for i, s in enumerate(tables.ids)}
    pairs = {}
    for rank, (a, b) in enumerate(tables.merges):
        pairs.setdefault(number[a] << 20 | number[b], rank << 20 | number[a + b])
    return [number[c] for c in tables.alphabet], pairs


def tokens_in(word: bytes, first: list[int], pairs: dict[int, int]) -> int:
    """Tokens of one pre-token."""
    n = len(word)
    if n < 2:
        return n
    sym = [first[b] for b in word]
    after = list(range(1, n + 1))  # the linked list: n is the end
    before = list(range(-1, n - 1))
    shift = max(SHIFT, n.bit_length())
    mask = (1 << shift) - 1
    get = pairs.get
    heap = []
    for i in range(n - 1):
        found = get(sym[i] << 20 | sym[i + 1])
        if found is not None:
            heap.append(found >> 20 << shift | i)
    heapq.heapify(heap)
    merges = 0
    while heap:
        entry = heapq.heappop(heap)
        i = entry & mask
        j = after[i]
        if sym[i] < 0 or j >= n:
            continue
        found = get(sym[i] << 20 | sym[j])
        if found is None or found >> 20 != entry >> shift:
            continue  # a neighbour has merged since
        merges += 1
        sym[i], sym[j] = found & 0xFFFFF, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = get(sym[i] << 20 | sym[k])
            if found is not None:
                heapq.heappush(heap, found >> 20 << shift | i)
        h = before[i]
        if h >= 0:
            found = get(sym[h] << 20 | sym[i])
            if found is not None:
                heapq.heappush(heap, found >> 20 << shift | h)
    return n - merges


class Counts(dict):
    """Counts of pre-tokens seen by this worker. At ``most`` entries it starts anew; long pre-tokens aren't kept."""

    def __init__(self, tables: BpeTables, most: int = 400_000, longest: int = 64):
        self.first, self.pairs = pair_table(tables)
        self.most, self.longest = most, longest

    def __missing__(self, word: str) -> int:
        n = tokens_in(word.encode(), self.first, self.pairs)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def counter(tables: BpeTables):
    """A function from text to its number of tokens."""
    special, counts = tables.special_pattern(), Counts(tables)

    def count(text: str) -> int:
        total = 0
        for k, part in enumerate(special.split(text)):
            if k % 2:
                total += 1
            elif part:
                total += sum([counts[w] for w in SPLITTER.split(part)])
        return total

    return count


_COUNTERS: dict = {}  # one for each vocabulary and worker process


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: its id, bytes in UTF-8, tokens, and whether these are more than ``limit``. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(BpeTables.read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = counter(shared.value)
        count = _COUNTERS[vocabulary]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([count(t.as_py()) for t in b.column(2)], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = text_of(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
