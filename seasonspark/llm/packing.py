"""Fixed windows packed by lexical retrieval: neighbours found in a sharded BM25 index fill each seed's window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonspark.llm.scratch import Scratch
from seasonspark.llm.tokens import encoder, in_slices
from seasonspark.llm.workers import tidy

K1, B = 1.2, 0.75
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Neighbours that are sorted at once, successive ids that are hashed together for dealing, and ids of a task.
FIRST, RUN, TASK_TOKENS = 64, 4, 1 << 22
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Bm25:
    """Inverted index of one shard; terms are token ids, postings are kept with their full weights."""

    def __init__(self, docs: list[np.ndarray], query_terms: int | None = None):
        self.size, self.query_terms = len(docs), query_terms
        found = [np.unique(d.astype(np.uint16) if d.max() < 65536 else d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in found]
        term = np.concatenate([t.astype(np.int64) for t, _ in found])
        doc = np.repeat(np.arange(self.size), [len(t) for t in self.terms])
        tf = np.concatenate([c for _, c in found]).astype(float)
        length = np.array([len(d) for d in docs], float)
        self.df = df = np.bincount(term)
        self.idf = np.log1p((self.size - df + 0.5) / (df + 0.5))
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / length.mean())[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.ends = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents with a score, by falling score against the seed's terms that others share; ties by position."""
        terms = self.terms[seed].astype(np.int64)
        terms = terms[self.df[terms] > 1]
        if self.query_terms is not None:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")[: self.query_terms]]
        counts = self.df[terms]
        at = np.arange(counts.sum()) + np.repeat(self.ends[terms] - np.cumsum(counts) + counts, counts)
        scores = np.bincount(self.doc[at], self.weight[at], self.size)
        found = np.flatnonzero((scores > 0) & unused)
        while len(found):  # few are asked for, so they are sorted in parts
            least = np.partition(scores[found], -min(FIRST, len(found)))[-min(FIRST, len(found))]
            part = found[scores[found] >= least]
            yield from part[np.argsort(-scores[part], kind="stable")].tolist()
            found = found[scores[found] < least]


class Windows:
    """Open window of one task and the pieces of its full ones."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id, self.open, self.fill, self.done = size, first_id, [], 0, []

    def add(self, doc: tuple) -> bool:
        """Append a document, cut wherever a window is full; true if the open window still has room and a part of it."""
        start, n = 0, doc[2]
        while start < n:
            take = min(n - start, self.size - self.fill)
            self.open.append((doc, start, take))
            self.fill += take
            start += take
            if self.fill == self.size:
                self.close(self.size)
        return self.fill > 0

    def close(self, *lengths: int) -> None:
        """Turn the open pieces into sequences of these lengths."""
        pieces, self.open, self.fill = iter(self.open), [], 0
        doc, start, left = next(pieces)
        for length in lengths:
            offset = 0
            while offset < length:
                if not left:
                    doc, start, left = next(pieces)
                take = min(left, length - offset)
                self.done.append((doc[0], start, take, doc[2], self.next_id, offset, doc[1][4 * start : 4 * (start + take)]))
                start, left, offset = start + take, left - take, offset + take
            self.next_id += 1

    def finish(self) -> None:
        """The rest becomes sequences whose lengths are powers of two, which need no padding."""
        if self.fill:
            self.close(*(1 << b for b in reversed(range(self.fill.bit_length())) if self.fill >> b & 1))

    def batch(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def _fill(windows: Windows, docs: list[tuple], carry: int = 0, query_terms: int | None = None) -> list[tuple]:
    """Fill windows from a shard. When no unused document has a score and at most ``carry`` ids are left,
    the rest is returned to be tried with the next shard; with ``carry`` 0 it goes in by position."""
    index = Bm25([np.frombuffer(d[1], "<u4") for d in docs], query_terms)
    unused, seed, at, left = np.ones(len(docs), bool), 0, 0, sum(d[2] for d in docs)
    while True:
        while at < len(docs) and not unused[at]:
            at += 1
        if at == len(docs):
            return []
        seed, unused[at] = at, False
        left -= docs[seed][2]
        room = windows.add(docs[seed])
        while room:
            before = windows.next_id
            for other in index.neighbours(seed, unused):
                unused[other] = False
                left -= docs[other][2]
                room = windows.add(docs[other])
                if windows.next_id != before:  # the window is full; what is left of this document seeds the next
                    seed = other
                    break
            else:
                if 0 < left <= carry:
                    return [docs[i] for i in np.flatnonzero(unused)]
                break


def lexical_key(ids: np.ndarray) -> int:
    """The least hash of a document's runs of ``RUN`` ids: documents share it as often as they share such runs."""
    x = ids.astype(np.uint64)
    n = max(1, len(x) - RUN + 1)
    h = x[:n].copy()
    for j in range(1, min(RUN, len(x))):
        h = (h ^ (h >> np.uint64(29))) * MIX + x[j : n + j]
    h = (h ^ (h >> np.uint64(29))) * MIX
    return int((h ^ (h >> np.uint64(32))).min() >> np.uint64(1))


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            at = 0
            for texts in in_slices(t.as_py() or b"" for t in batch.column(1).cast(pa.binary())):
                data = [d + end for d in encode(texts)]
                ids = [np.frombuffer(d, "<u4") for d in data]
                slim = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else d for x, d in zip(ids, data, strict=True)]
                keys, sizes = pa.array([lexical_key(x) for x in ids], pa.int64()), pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(data)).cast(pa.int64()), keys, sizes, pa.array(slim, pa.binary())], names=["id", "key", "n", "ids"])
                at += len(data)

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, shard_tokens: int = 1 << 20, query_terms: int | None = None
) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, sequence_id, offset, ids)`` of packed sequences.

    Every document is its token ids and ``end_id`` (a null or empty text: that id alone). Documents are dealt by
    ``lexical_key``, so that like ones meet wherever they stood, to tasks of about ``TASK_TOKENS`` ids; a group of copies
    of any size is spread over the ranges it takes. A task packs its range in shards of about ``shard_tokens`` ids: a seed document opens a
    window, the unused documents most like it by BM25 (all its terms, or its ``query_terms`` rarest shared ones)
    fill it, and the one that is cut seeds the next. What has no score is tried with the next shard. A task's last
    window is split into sequences whose lengths are powers of two, so nothing is padded.

    Memory is bounded by a shard or the longest document; very long texts are encoded whole and cut into windows. Rows
    with equal or null ids are documents of their own. Other columns are ignored, whatever their names. An empty table
    gives an empty result. ``ids`` holds little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window, TaskContext.get().partitionId() << 40)
        shard, size = [], 0
        for batch in batches:
            for i, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_py()
                shard.append((i, data if len(data) == 4 * n else np.frombuffer(data, "<u2").astype("<u4").tobytes(), n))
                size += n
                if size >= shard_tokens:
                    shard = _fill(windows, shard, shard_tokens // 2, query_terms)
                    size = sum(d[2] for d in shard)
                    yield windows.batch()
        if shard:
            _fill(windows, shard, 0, query_terms)
        windows.finish()
        yield windows.batch()

    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(_encoded(tokenizer, end_id), tokenizes=True), "id long, key long, n long, ids binary")
    rows = Scratch(docs.sparkSession, "packing").table(rows, "tokens")
    parts = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // TASK_TOKENS))
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, "key", "place").sortWithinPartitions("key", "place")
    return dealt.select("id", "n", "ids").mapInArrow(tidy(run), DDL)
