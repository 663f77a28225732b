"""WARC archives: a writer with revisits, and a salvage reader that recovers what follows damage."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonspark.llm.components import join_per_key
from seasonspark.llm.files import AtomicFile, filesystem
from seasonspark.llm.scratch import Scratch

#: Size at which a file is closed, bytes read at once, and rows of a list of shared payloads that may be broadcast.
FILE_BYTES, CHUNK, BROADCAST_ROWS = 1 << 26, 1 << 18, 300_000
#: Fixed values of the WARC 1.1 format.
VERSION, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER_END = b"\r\n\r\n"


def record(kind: str, record_id: str, uri: str, digest: str, length: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. A revisit's block is the HTTP header alone, whose length is that of the payload it stands for."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {refers_to}"] if refers_to else []),
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + _HEADER_END + block + _HEADER_END) + packer.flush()


@dataclass
class Found:
    offset: int
    length: int
    headers: dict[str, str] | None = None
    block: bytes = b""


def _headers(data: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", data).split(b"\r\n")
    pairs = (x.partition(b":") for x in lines[1:] if b":" in x)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


class Salvager:
    """Reads records at random offsets of a file and checks each; what fails becomes a gap up to the next good one."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        self.size = self.file.size()

    def close(self) -> None:
        self.file.close()

    def _member(self, at: int) -> tuple[bytes, int] | None:
        unpacker, out, pos = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof and pos < self.size:
                data = self.file.read_at(min(CHUNK, self.size - pos), pos)
                out.append(unpacker.decompress(data))
                pos += len(data)
        except zlib.error:
            return None
        return (b"".join(out), pos - len(unpacker.unused_data)) if unpacker.eof else None

    def _plain(self, at: int) -> tuple[bytes, int] | None:
        # The header ends before the next version line or the end of the file, however long it is.
        data, pos, seen = bytearray(), at, 0
        while (head := data.find(_HEADER_END, max(0, seen - 3))) < 0:
            more = self.file.read_at(min(CHUNK, self.size - pos), pos)
            if not more or data.find(b"\n" + VERSION, max(0, seen - len(VERSION))) >= 0:
                return None
            seen = len(data)
            data += more
            pos += len(more)
        data, head = bytes(data), head + 4
        length = _headers(data[: head - 4]).get("content-length", "")
        if not length.isdigit() or at + head + int(length) + 4 > self.size:
            return None
        whole = head + int(length) + 4
        return (data + self.file.read_at(max(0, whole - len(data)), pos))[:whole], at + whole

    def record(self, at: int) -> Found | None:
        """The record at an offset if every check holds: member, version line, length, block digest."""
        start = self.file.read_at(min(8, self.size - at), at)
        got = self._member(at) if start.startswith(GZIP) else self._plain(at) if start.startswith(VERSION) else None
        if not got or not got[0].startswith(VERSION) or _HEADER_END not in got[0]:
            return None
        data, end = got
        head, _, rest = data.partition(_HEADER_END)
        if re.search(rb"WARC/1\.\d\r\n", head[8:]):  # a cut header that runs on into the next record's
            return None
        headers = _headers(head)
        length = headers.get("content-length", "")
        if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(_HEADER_END):
            return None
        block, digest = rest[:-4], headers.get("warc-block-digest", "")
        if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:].lower():
            return None
        return Found(at, end - at, headers, block)

    def _candidates(self, at: int) -> Iterator[int]:
        """Offsets from ``at`` on where a member or a version line could begin."""
        pos, keep = at, 8
        while pos < self.size:
            data = self.file.read_at(min(CHUNK + keep, self.size - pos), pos)
            for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", data):
                if m.start() < CHUNK:
                    yield pos + m.start()
            pos += CHUNK

    def __iter__(self) -> Iterator[Found]:
        at = 0
        while at < self.size:
            found = self.record(at)
            if found is None:
                found = next(filter(None, map(self.record, self._candidates(at + 1))), None)
                end = found.offset if found else self.size
                yield Found(at, end - at)
            if found is None:
                return
            yield found
            at = found.offset + found.length


def write_pages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row and return one row ``(uri, records)`` per archive.

    The payload is the body in UTF-8, null: empty. Of the rows with equal payloads of at least ``least_bytes``
    bytes that with the smallest id (nulls last) is a response, the others revisit it, unless they bear its
    id or it has none. Shared digests are pre-aggregated; a list of up to ``BROADCAST_ROWS`` of them is broadcast, so that
    no body is shuffled; beyond that bodies are joined by digest, those of digests with many rows by broadcast.
    Null urls are ``urn:none``. Files close at about 64 MB; a task that is run again writes the same names. Memory is bounded
    by the longest body. Other columns are ignored, whatever their names. An empty table gives no archive.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    scratch = Scratch(pages.sparkSession, "archives")
    firsts = rows.where((F.octet_length("body") >= least_bytes) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = scratch.table(firsts.where("n > 1"), "shared")
    if shared.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(shared.drop("n")), "digest", "left")
    else:
        rows = join_per_key(rows, shared, "digest", "n", pages.count())
    rows = rows.select("id", "url", "body", "digest", F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, made, count = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            ids, urls, digests, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, body in enumerate(batch.column(2)):
                out = out or AtomicFile(f"{folder}/part-{task:06d}-{len(made):04d}.warc.gz")
                body, first = body.as_py(), firsts[i]
                urn = f"<urn:page:{'null' if ids[i] is None else ids[i]}>"
                refers = None if first is None else f"<urn:page:{first}>"
                url = quote(urls[i] or "", safe="%/:?#[]@!$&'()*+,;=-._~") or "urn:none"
                out.write(record("revisit" if refers else "response", urn, url, digests[i], len(body), b"" if refers else body, refers, date))
                count += 1
                if out.size >= FILE_BYTES:
                    out.close()
                    made.append((out.uri, count))
                    out, count = None, 0
        if out:
            out.close()
            made.append((out.uri, count))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["uri", "records"])

    return scratch.table(rows.mapInArrow(run, "uri string, records long"), "archives")


SCHEMA = pa.schema(
    [("kind", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
     ("refers_to", pa.string()), ("payload_digest", pa.string()), ("entity_length", pa.int64()), ("payload", pa.binary())]
)
DDL = "kind string, uri string, offset long, length long, type string, record_id string, target_uri string, refers_to string, payload_digest string, entity_length long, payload binary"


def _row(uri: str, f: Found) -> tuple:
    if f.headers is None:
        return ("gap", uri, f.offset, f.length, *[None] * 7)
    h, payload, entity = f.headers, f.block, None
    if h.get("content-type", "").startswith("application/http"):
        head, _, payload = f.block.partition(_HEADER_END)
        value = _headers(head).get("content-length", "")
        entity = int(value) if value.isdigit() else None
    return ("record", uri, f.offset, f.length, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), entity, payload)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            source, rows, size, whole, gaps = Salvager(uri), [], 0, 0, 0
            for found in source:
                rows.append(_row(uri, found))
                size += len(found.block)
                whole, gaps = whole + (found.headers is not None), gaps + (found.headers is None)
                if size > 4_000_000 or len(rows) >= 5000:
                    yield _batch(rows)
                    rows, size = [], 0
            source.close()
            if expected is not None and (whole != expected or gaps):
                raise ValueError(f"{uri}: {whole} whole records and {gaps} gaps, {expected} records were written")
            if rows:
                yield _batch(rows)


def read_archives(archives: DataFrame, *, uri: Column | str = "uri", expected: Column | None = None) -> DataFrame:
    """Records and gaps of the archives, gzip or plain.

    ``kind`` is ``record`` or, for quarantined bytes, ``gap`` with offset and length alone. A record whose
    member, version line, length or block digest fails is skipped up to the next offset at which all hold;
    later records are read as usual. Where ``expected`` tells how many records an archive has, the reader raises an
    error if it finds a gap or another number. Memory is bounded by the longest record. Empty files hold
    nothing, an empty table gives an empty result.
    """
    n = max(1, min(archives.count(), 10 * archives.sparkSession.sparkContext.defaultParallelism))
    expected = expected if expected is not None else F.lit(None)
    return archives.select(uri, expected.cast("long").alias("expected")).repartition(n).mapInArrow(_read, DDL)
