"""Token ids in sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter, footer.

Layout, integers little-endian: blocks, index, filter, footer of 56 bytes (offset and size of index and
filter, documents, ids, magic). A block is a zstd frame followed by the CRC-32 of its content; the content
is entries ``varint shared, varint unshared, varint value size, key suffix, value``, every 16th with its whole
key, then the offsets of those and their number. A key is one byte (0: null), the big-endian id with its sign
bit flipped, and 8 bytes that order rows of equal ids. A value is the width of an id in bytes and the ids.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.llm.files import AtomicFile, filesystem
from seasonspark.llm.scratch import Scratch
from seasonspark.llm.tokens import encoder, in_slices

MAGIC = b"SSTIDS01"
RESTART, BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, BLOOM_HASHES = 16, 1 << 16, 1 << 26, 10, 7
FOOTER = struct.Struct("<QQQQQQ8s")


def key_of(doc_id: int | None, tie: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">Q", tie + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while data[at] > 127:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
    return n | data[at] << shift, at + 1


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _bloom_places(key: bytes, bits: int) -> Iterator[int]:
    a, b = xxhash.xxh3_64_intdigest(key[:9]), xxhash.xxh3_64_intdigest(key[:9], 1) | 1
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


class Writer:
    """Entries must come by rising key."""

    def __init__(self, uri: str):
        self.file, self.packer = AtomicFile(uri), zstandard.ZstdCompressor(level=1)
        self.index, self.keys, self.docs, self.ids = [], [], 0, 0
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value, shared = pack_ids(ids), 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count, self.last = self.count + 1, key
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.count:
            data = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            frame = self.packer.compress(data)
            self.index.append((self.last, self.file.write(frame + struct.pack("<I", zlib.crc32(data))), len(frame) + 4))
            self._fresh()

    def close(self) -> None:
        self.flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) for k, at, size in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[list(_bloom_places(key, bits))] = True
        bloom = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        i, b = self.file.write(index), self.file.write(bloom)
        self.file.write(FOOTER.pack(i, len(index), b, len(bloom), self.docs, self.ids, MAGIC))
        self.file.close()


class Reader:
    """Scans a shard, or finds one id by Bloom filter and binary search in index and block."""

    def __init__(self, uri: str):
        files, path = filesystem(uri)
        self.file = files.open_input_file(path)
        end = self.file.size()
        i, i_size, b, b_size, self.docs, self.ids, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        data, at, self.index = self.file.read_at(i_size, i), 0, []
        while at < i_size:
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            self.index.append((key, offset, size))
        data = self.file.read_at(b_size, b)
        self.bits, self.bloom = struct.unpack("<Q", data[:8])[0], np.frombuffer(data, np.uint8, offset=8)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def _block(self, number: int) -> bytes:
        _, offset, size = self.index[number]
        raw = self.file.read_at(size, offset)
        data = zstandard.ZstdDecompressor().decompress(raw[:-4])
        if struct.unpack("<I", raw[-4:])[0] != zlib.crc32(data):
            raise ValueError(f"block {number} is damaged")
        return data

    @staticmethod
    def _entries(data: bytes, at: int, end: int, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        while at < end:
            shared, at = _read_varint(data, at)
            unshared, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + unshared], at + unshared
            yield key, data[at : at + size]
            at += size

    @staticmethod
    def _restarts(data: bytes) -> tuple[int, ...]:
        n = struct.unpack("<I", data[-4:])[0]
        return struct.unpack(f"<{n}I", data[-4 - 4 * n : -4])

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for number in range(len(self.index)):
            data = self._block(number)
            end = len(data) - 4 - 4 * len(self._restarts(data))
            for key, value in self._entries(data, 0, end):
                yield id_of(key), unpack_ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this id."""
        low = key_of(doc_id, -(1 << 63))
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(low, self.bits)):
            return []
        found = []
        for number in range(bisect_left([k for k, _, _ in self.index], low), len(self.index)):
            data = self._block(number)
            restarts = self._restarts(data)
            first = max(0, bisect_left(restarts, low, key=lambda at: next(self._entries(data, at, at + 1))[0]) - 1)
            for key, value in self._entries(data, restarts[first], len(data) - 4 - 4 * len(restarts)):
                if key[:9] > low[:9]:
                    return found
                if key[:9] == low[:9]:
                    found.append(unpack_ids(value))
        return found


def write_shards(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Encode whole texts and write them by rising id; one row ``(task, number, uri, docs, ids)`` per shard.

    Rows are range-partitioned by id and, among equal ids, by a hash of the text, so one id may hold any
    share of them. A shard is closed at about 64 MB. A task that is run again writes the same files.
    Null text is empty; null ids come first. Very long texts are encoded and stored whole: a block holds at least one
    document, and memory is bounded by the longest. Other columns are ignored, whatever their names. An empty table
    gives no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = encoder(tokenizer).encode, np.array([end_id], "<u4"), TaskContext.get().partitionId()
        writer, made = None, []

        def close() -> None:
            writer.close()
            made.append((task, len(made), writer.file.uri, writer.docs, writer.ids))

        for batch in batches:
            ids, ties, at = batch.column(0).cast(pa.int64()).to_pylist(), batch.column(2).to_pylist(), 0
            for texts in in_slices(t.as_py() or b"" for t in batch.column(1).cast(pa.binary())):
                for data in encode(texts):
                    writer = writer or Writer(f"{folder}/shard-{task:06d}-{len(made):04d}.sst")
                    writer.add(key_of(ids[at], ties[at]), np.concatenate([np.frombuffer(data, "<u4"), end]))
                    at += 1
                    if writer.file.size >= SHARD_BYTES:
                        close()
                        writer = None
        if writer:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("task", "number", "uri", "docs", "ids"), m, strict=True)) for m in made], schema=pa.schema([("task", pa.int32()), ("number", pa.int32()), ("uri", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    return Scratch(docs.sparkSession, "shards").table(dealt.mapInArrow(run, "task int, number int, uri string, docs long, ids long"), "shards")


def read_shards(shards: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, start, ids)`` of every document in the shards; start counts the ids of all documents before it.

    Shards are summed up in one task, a slim row each. No shards give an empty result. A block whose checksum fails is an error.
    """
    spark = shards.sparkSession
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = shards.select("uri", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    n = max(1, min(shards.count(), 10 * spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Reader(uri) as reader:
                    ids, starts, data, size = [], [], [], 0
                    for doc_id, tokens in reader.scan():
                        ids.append(doc_id)
                        starts.append(start)
                        data.append(tokens.tobytes())
                        start, size = start + len(tokens), size + len(data[-1])
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names=[id_col, "start", "ids"])
                            ids, starts, data, size = [], [], [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], names=[id_col, "start", "ids"])

    return files.repartition(n).mapInArrow(run, f"{id_col} long, start long, ids binary")
