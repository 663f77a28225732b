"""Exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonspark.llm.scratch import Scratch
from seasonspark.llm.vectors import as_arrays

#: Rows of a block of queries and of a block of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
LARGEST = 2**63 - 1


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = []
            for x in as_arrays(batch.column(1)):
                v = None if x is None else np.floor(x * scale)
                ints.append(None if v is None else [int(y) for y in v] if len(v) and np.abs(v).max() >= 2**62 else v.astype(np.int64).tolist())
            big = [v is not None and any(abs(y) >= 2**62 for y in v) for v in ints]
            small = pa.array([None if v is None or b else v for v, b in zip(ints, big, strict=True)], pa.list_(pa.int64()))
            text = pa.array([" ".join(map(str, v)) if b else None for v, b in zip(ints, big, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), small, text], names=["id", "query", "ints", "big"])

    return run


def _rows(table: pa.Table) -> list[np.ndarray]:
    return [np.array([int(y) for y in b.split(" ")], object) if b else np.array(v, np.int64) for v, b in zip(table.column("ints").to_pylist(), table.column("big").to_pylist(), strict=True)]


class Postings:
    """Inverted lists of a block: for each term the candidates that have it and their weights."""

    def __init__(self, rows: list[np.ndarray]):
        width = max(map(len, rows), default=0)
        self.size, self.largest = len(rows), max((int(abs(r).max()) for r in rows if len(r)), default=0)
        dense = np.zeros((width, len(rows)), object if any(r.dtype == object for r in rows) else np.int64)
        for i, r in enumerate(rows):
            dense[: len(r), i] = r
        self.lists = [(np.flatnonzero(w), w) for w in dense]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Each non-zero term of the query scatters its weighted list into one dense array."""
        bound = int(abs(query).max() if len(query) else 0) * self.largest * max(1, len(self.lists))
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
        out = np.zeros(self.size, kind)
        for term in np.flatnonzero(query[: len(self.lists)]).tolist():
            at, weights = self.lists[term]
            if 2 * len(at) > self.size:
                out += weights.astype(kind, copy=False) * kind(query[term]) if kind is not object else weights.astype(object) * int(query[term])
            elif len(at):
                out[at] += (weights[at].astype(object) * int(query[term])) if kind is object else weights[at].astype(kind) * kind(query[term])
        return np.array([max(-LARGEST - 1, min(LARGEST, int(s))) for s in out], np.int64) if kind is object else out


def _best(k: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if len(queries) and len(candidates):
            postings = Postings(_rows(candidates))
            for term, (at, w) in enumerate(postings.lists):
                if w.dtype != object and postings.largest < 2**31:
                    postings.lists[term] = (at, w.astype(np.int32))
            ids = candidates.column("id")
            null = ids.is_null().to_numpy()
            ids = ids.fill_null(LARGEST).to_numpy()
            for q, row in zip(queries.column("id").to_pylist(), _rows(queries), strict=True):
                scores = postings.scores(row)
                pool = np.flatnonzero((ids != q) | null)
                if len(pool) > k:
                    own = scores[pool]
                    least = np.partition(own, len(own) - k)[len(own) - k]
                    pool = pool[own >= least]
                values = [int(s) for s in scores[pool]]
                for s, _, i in sorted(zip([-v for v in values], ids[pool].tolist(), pool.tolist(), strict=True))[:k]:
                    out[0].append(q), out[1].append(None if null[i] else int(ids[i])), out[2].append(-s)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of each query row, ties to the smaller id.

    Components become floor(scale * x). Every row but those with the query's id is a candidate. Blocks of
    queries meet blocks of candidates in a task of bounded size, whose winners per query are merged by
    rank; a row goes to as many tasks as there are blocks of the other kind. Scores are exact integers,
    held to the range of a long.

    Vectors that are null or hold null or non-finite components take no part; in vectors of different
    lengths, missing components are 0. Null ids are no queries and rank last among ties. Of rows with
    equal ids that are queries, one whose vector is least speaks for the id; all are candidates. Very long vectors
    are read whole: a task holds one block of each kind. Other columns are ignored, whatever their names. An empty
    table, or one without queries, gives an empty result.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    rows = vectors.select(F.col(id_col), F.col(vector_col), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = scratch.table(rows.mapInArrow(_integers(scale), "id long, query boolean, ints array<long>, big string").where("ints is not null or big is not null"), "rows")
    asked = rows.where("query and id is not null").groupBy("id").agg(F.min(F.struct("ints", "big")).alias("v")).select("id", "v.*")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    qs, cs = -(-sizes.q // QUERY_ROWS) or 1, -(-sizes.n // CANDIDATE_ROWS) or 1
    q = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(qs))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cs - 1))))
    c = rows.select("id", "ints", "big", F.pmod(F.monotonically_increasing_id(), F.lit(cs)).cast("int").alias("c")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qs - 1).cast("long"))))
    found = q.groupBy("q", "c").cogroup(c.groupBy("q", "c")).applyInArrow(_best(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
