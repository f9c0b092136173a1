"""Byte-pair encoding as a transducer with bounded lookahead, and decoding as a state machine.

How far does the future reach back? What comes later can change a token only through a merge that takes it, or a part at
its end, as the left part. Whether the right part of that merge is there may depend on what follows it in turn, through
merges of lower rank. Going through the merge list in order of rank gives for each token the number of symbols after it
that such a chain can cover at most: the sum of the lengths of its right parts. A token with as many symbols after it is
stable. The encoder reads symbols, emits tokens once they are stable and holds the rest, never much more than the longest
reach; what is left starts at a token's edge, and no merge crosses that, so it may be encoded alone.

The decoder turns ids into text bit by bit, in whatever portions they come.

Defined results: a null text is empty (no ids, empty decoding); repeated rows give repeated rows; a null id stays
null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from tallyforge.llm.bpe_tables import SPACE, BpeTables, Splitter, pieces
from tallyforge.llm.staging import text_of

SLICE = 1 << 16  #: characters normalised and split at a time
STEP = 64  #: symbols read before those held are encoded again
#: The vocabulary's word patterns, for texts of ASCII only and for all.
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SPLITTER = Splitter(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", ASCII_WORDS, WORDS)
NORMALIZER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def sufficient_lookahead(merges: list[tuple[str, str]], width: Callable[[str], int] = len) -> dict[str, int]:
    """For each token that some merge takes or makes, the symbols after it that can still change it, at most."""
    reach: dict[str, int] = {}
    for a, b in merges:
        beyond = reach.get(b, 0)  # of the right part, through merges of lower rank
        reach[a] = max(reach.get(a, 0), width(b) + beyond)
        reach[a + b] = max(reach.get(a + b, 0), beyond)
    return reach


class Transducer:
    """Encodes the symbols of one word after another; ``words`` keeps short words' results, up to a bound."""

    def __init__(self, tables: BpeTables, most: int = 250_000, longest: int = 64):
        self.tables, self.most, self.longest = tables, most, longest
        self.ranks = {}
        for rank, pair in enumerate(tables.merges):
            self.ranks.setdefault(pair, rank)
        self.lookahead = sufficient_lookahead(tables.merges, self.width)
        self.decoder = Decoder(tables)

    def settle(self, symbols: list[str]) -> list[str]:
        """The tokens of a closed run of symbols."""
        rank = self.ranks.get
        if len(symbols) <= 48:
            s, none = symbols[:], len(self.ranks)
            ranks = [rank(pair, none) for pair in zip(s, s[1:])]
            while ranks and (best := min(ranks)) < none:
                i = ranks.index(best)  # the leftmost of the lowest rank
                s[i] += s.pop(i + 1)
                del ranks[i]
                if i:
                    ranks[i - 1] = rank((s[i - 1], s[i]), none)
                if i < len(ranks):
                    ranks[i] = rank((s[i], s[i + 1]), none)
            return s
        s: list = symbols[:]
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if s[i] is None or j >= n or rank((s[i], s[j])) != r:
                continue
            s[i], s[j] = s[i] + s[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := rank((s[h], s[i]))) is not None:
                heapq.heappush(heap, (q, h))
        return [x for x in s if x is not None]

    def tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a stream of symbols, each given out once nothing that follows can change it."""
        reach, held, full = self.lookahead, [], STEP
        for symbol in symbols:
            held.append(symbol)
            if len(held) < full:
                continue
            at = 0
            for token in self.settle(held):
                end = at + self.width(token)
                if end + reach.get(token, 0) >= len(held):  # the last held symbol may still become another one's part
                    break
                at = end
                yield token
            del held[:at]
            full = len(held) + STEP
        yield from self.settle(held)

    def width(self, token: str) -> int:
        """Symbols in a token."""
        suffix = self.tables.suffix
        return len(token) - len(suffix) if suffix and token.endswith(suffix) and len(token) > len(suffix) else len(token)

    def symbols(self, word: str) -> Iterator[str]:
        """A word's symbols: a character for each byte, the last with the word-end mark."""
        alphabet, data = self.tables.alphabet, word.encode()
        for b in data[:-1]:
            yield alphabet[b]
        yield alphabet[data[-1]] + self.tables.suffix

    def encode(self, word: str) -> list[int]:
        ids = self.tables.ids
        return [ids[t] for t in self.tokens(self.symbols(word))]


class Decoder:
    """Text of ids that come bit by bit. ``byte_level``: tokens spell bytes, and a character is given out once its
    last byte is there; else tokens are joined by single spaces, as for a vocabulary without a decoder of its own."""

    def __init__(self, tables: BpeTables, byte_level: bool = False):
        self.names = {i: t for t, i in tables.ids.items()} | {i: t for t, i in tables.special.items()}
        self.special = set(tables.special.values())
        self.bytes = {c: b for b, c in enumerate(tables.alphabet)}
        self.byte_level = byte_level
        self.reset()

    def reset(self) -> None:
        self.started = False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        names = list(map(self.names.__getitem__, ids))
        if not self.byte_level:
            text = " ".join(names)
            out = f" {text}" if self.started and names else text
            self.started |= bool(names)
            return out
        return "".join(self.state.decode(bytes(self.bytes[c] for c in t)) for t in names)

    def finish(self) -> str:
        return self.state.decode(b"", True) if self.byte_level else ""


def encode_text(text: str, transducer: Transducer, cache: dict) -> Iterator[tuple[str, list[int]]]:
    """For each word or special string of ``text``: its ids in decimal, and the ids."""
    tables = transducer.tables
    for k, part in enumerate(tables.special_pattern().split(text)):
        if k % 2:
            yield str(tables.special[part]), [tables.special[part]]
            continue
        for piece in pieces(part, SLICE):
            words = SPLITTER.split(piece.lower() if piece.isascii() else NORMALIZER.normalize_str(piece))
            for w in words:
                found = cache.get(w)
                if found is None:
                    ids = transducer.encode(w)
                    found = (" ".join(map(str, ids)), ids)
                    if len(w) <= transducer.longest:
                        if len(cache) >= transducer.most:
                            cache.clear()
                        cache[w] = found
                yield found


def digests(text: str, transducer: Transducer, cache: dict) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the text that they decode to; ids are hashed and decoded
    in portions, as they come."""
    n, hashed, decoded = 0, hashlib.sha256(), hashlib.sha256()
    decoder, lead = transducer.decoder, ""
    decoder.reset()
    found = encode_text(text, transducer, cache)
    while held := list(itertools.islice(found, 4096)):
        ids = list(itertools.chain.from_iterable([h[1] for h in held]))
        hashed.update((lead + " ".join([h[0] for h in held])).encode())
        decoded.update(decoder.push(ids).encode())
        n, lead = n + len(ids), " "
    decoded.update(decoder.finish().encode())
    return n, hashed.hexdigest(), decoded.hexdigest()


def ids_of(text: str, transducer: Transducer, cache: dict, most: int = 100_000) -> Iterator[list[int]]:
    """The ids of each word or special string of ``text``; ``cache`` keeps short words' ids, up to ``most``."""
    special = transducer.tables.special
    for k, part in enumerate(transducer.tables.special_pattern().split(text)):
        if k % 2:
            yield [special[part]]
            continue
        for piece in pieces(part, SLICE):
            for w in SPLITTER.split(piece.lower() if piece.isascii() else NORMALIZER.normalize_str(piece)):
                ids = cache.get(w)
                if ids is None:
                    ids = transducer.encode(w)
                    if len(w) <= transducer.longest:
                        if len(cache) >= most:
                            cache.clear()
                        cache[w] = ids
                yield ids


ROWS = 128  #: rows whose ids or texts are held at a time
_IDS: dict = {}  # the same, for ids alone
_TRANSDUCERS: dict = {}  # one for each vocabulary and worker process


def _ready(vocabulary: str, shared) -> tuple[Transducer, dict]:
    if vocabulary not in _TRANSDUCERS:
        _TRANSDUCERS[vocabulary] = (Transducer(shared.value), {})
    return _TRANSDUCERS[vocabulary]


def roundtrip_digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: its id, number of tokens, and the hashes of its ids and of their decoding. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(BpeTables.read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, cache = _ready(vocabulary, shared)
        for b in batches:
            found = [digests(t.as_py(), transducer, cache) for t in b.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)


def encode(docs: DataFrame, vocabulary: str, text_column: str = "text", ids_column: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text as an array. A column named ``ids_column`` is replaced. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(BpeTables.read(vocabulary))
    rest = docs.drop(ids_column)
    schema = f"struct<{', '.join(f'`{f.name.replace("`", "``")}`: {f.dataType.simpleString()}' for f in rest.schema)}, `{ids_column}`: array<int>>"
    at = rest.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, _ = _ready(vocabulary, shared)
        cache = _IDS.setdefault(vocabulary, {})
        for whole in batches:
            for at_row in range(0, whole.num_rows, ROWS):
                b = whole.slice(at_row, ROWS)
                ids = [list(itertools.chain.from_iterable(ids_of(t.as_py() or "", transducer, cache))) for t in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, ids_column])

    return rest.mapInArrow(run, schema.removeprefix("struct<").removesuffix(">"))


def decode(rows: DataFrame, vocabulary: str, ids_column: str = "token_ids", text_column: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids (null: empty). A column named ``text_column`` is replaced. No shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(BpeTables.read(vocabulary))
    rest = rows.drop(text_column)
    schema = ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in rest.schema) + f", `{text_column}`: string"
    at = rest.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _ready(vocabulary, shared)[0].decoder
        for whole in batches:
            for at_row in range(0, whole.num_rows, ROWS):
                b, out = whole.slice(at_row, ROWS), []
                for ids in b.column(at):
                    decoder.reset()
                    out.append("".join([decoder.push(ids.as_py() or []), decoder.finish()]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text_column])

    return rest.mapInArrow(run, schema)
