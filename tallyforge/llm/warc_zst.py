"""WARC archives under Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Archives are binary values of bounded size in a table (``path``, ``content``), the shape that Spark's ``binaryFile``
source gives, so the reader takes real ``.warc.zst`` files and archives just written alike. The writer's table is
committed by Spark, so a retried task leaves no half archive. Equal payloads are found by their SHA-1: the record
with the largest id is the response, the others are revisits without the payload.

Defined results: a null payload is empty; a null id is written as ``null`` and comes back null, and is a revisit where
an equal payload has an id; rows that repeat an id and payload are all responses; an empty table gives no archive.
A record that breaks the format comes back with ``problem`` set and its other columns as far as they were read; a
frame that can't be decoded ends its archive with one such row, as nothing says where the next frame begins.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.staging import Workspace, text_of

MAGIC = 0x184D2A5D  #: the skippable frame that holds the dictionary
DICT_MAGIC, FRAME_MAGIC = b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 15  #: compressed bytes given to the decoder at a time
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, problem string"


def digest_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def uri(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def page_of(text: str) -> int | None:
    inner = text.strip().removeprefix("<urn:x-page:").removesuffix(">")
    return None if inner == "null" else int(inner)


def record(page: int | None, url: str | None, payload: bytes, sha1: bytes, refers: int | None, revisit: bool) -> bytes:
    """One WARC record, blank lines at its end included. A revisit keeps the HTTP header, whose length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {uri(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(url.splitlines()))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(sha1)}")
    if revisit:
        lines += [f"WARC-Refers-To: {uri(refers)}", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3, dictionary_bytes: int = 16384, train_bytes: int = 1 << 18) -> bytes:
    """The bytes of one archive. The dictionary is trained on its first records; too few leave it without one."""
    samples, seen = [], 0
    for r in records:
        samples.append(r[:4096])
        seen += len(samples[-1])
        if seen >= train_bytes:
            break
    shared, lead = None, b""
    if len(samples) >= 16 and seen >= 8 * dictionary_bytes:
        try:
            shared = zstandard.train_dictionary(dictionary_bytes, samples, d=8, k=256, steps=1, level=level)
            lead = struct.pack("<II", MAGIC, len(shared.as_bytes())) + shared.as_bytes()
        except zstandard.ZstdError:
            shared = None
    packer = zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
    return lead + b"".join(packer.compress(r) for r in records)


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    view, at, shared = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise ValueError("dictionary frame is longer than the archive")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != DICT_MAGIC:
            raise ValueError("leading frame holds no dictionary")
        shared, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()
    while at < len(view):
        if 0x184D2A50 <= struct.unpack_from("<I", view, at)[0] <= 0x184D2A5F:  # other skippable frames
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        decoder, out = reader.decompressobj(), []
        while not decoder.eof:
            if at >= len(view):
                raise ValueError("frame is cut off")
            part = view[at : at + STEP]
            out.append(decoder.decompress(part))
            at += len(part)
        at -= len(decoder.unused_data)
        yield b"".join(out)


def parsed(raw: bytes) -> tuple:
    """The fields of READ_SCHEMA for one record."""
    page = size = digest = kind = refers = url = payload = None
    try:
        head, gap, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not gap or not lines[0].startswith("WARC/1."):
            raise ValueError("no WARC header")
        fields = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"header line without a colon: {line[:40]}")
            fields[name.strip().lower()] = value.strip()
        kind, url, page = fields["warc-type"], fields.get("warc-target-uri"), page_of(fields["warc-record-id"])
        if not (fields["content-length"].isdecimal() and fields["warc-date"]):
            raise ValueError("bad Content-Length")
        length = int(fields["content-length"])
        if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError("Content-Length doesn't match the record")
        http, gap, body = rest[:length].partition(b"\r\n\r\n")
        inner = dict(x.decode().lower().split(": ", 1) for x in http.split(b"\r\n")[1:])
        if not gap or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        size, digest = int(inner["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "revisit":
            refers = page_of(fields["warc-refers-to"])
            if body or fields.get("warc-profile") != REVISIT:
                raise ValueError("revisit with a payload or an unknown profile")
        elif kind == "response":
            payload = body
            if len(body) != size or digest_of(hashlib.sha1(body).digest()) != digest:
                raise ValueError("payload doesn't match its length or digest")
        else:
            raise ValueError("unknown record type")
    except (KeyError, ValueError) as e:
        return page, size, digest, kind, refers, url, payload, f"{type(e).__name__}: {e}"
    return page, size, digest, kind, refers, url, payload, None


def write_archives(pages: DataFrame, archive_bytes: int = 1 << 20, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """A staged table (path, content) of archives of about ``archive_bytes`` before compression, or one record."""
    rows = pages.select(F.col(id_column).cast("long").alias("page"), F.col(url_column).cast("string").alias("url"), F.encode(text_of(payload_column), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    copies = rows.groupBy("sha1").agg(F.max("page").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = rows.join(copies, "sha1", "left").select("page", "url", "payload", "sha1", "last", F.coalesce(F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last")), F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            content = archive(held)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["path", "content"])

        for b in batches:
            for k in range(b.num_rows):
                page, url, payload, sha1, last, revisit = (c[k].as_py() for c in b.columns)
                held.append(record(page, url, payload, sha1, last, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    with Workspace(pages.sparkSession, "warc") as work:
        return work.keep(work.staged(told.mapInArrow(run, "path string, content binary"), "archives"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of ``archives`` (path, content). ``payloads=False`` leaves that column null, after the checks."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, size = [], 0
                try:
                    for raw in frames(b.column(0)[k].as_py() or b""):
                        row = parsed(raw)
                        rows.append(row if payloads else (*row[:6], None, row[7]))
                        size += len(raw) if payloads else 1000
                        if size >= 1 << 22:
                            yield batch(rows)
                            rows, size = [], 0
                except (ValueError, struct.error, zstandard.ZstdError) as e:
                    rows.append((*[None] * 7, f"archive: {e}"))
                if rows:
                    yield batch(rows)

    return archives.select("content").mapInArrow(run, READ_SCHEMA)


def read_files(spark, path: str) -> DataFrame:
    """Records of ``.warc.zst`` files under ``path``; a file is one value, so it must be under 2 GB."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content"))


def roundtrip(pages: DataFrame) -> DataFrame:
    """What comes back for each page once it has been written to archives and read."""
    found = read_archives(write_archives(pages), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("problem").isNull().alias("valid"))
