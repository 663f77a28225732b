"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept vector per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonspark.llm.components import components, join_per_key
from seasonspark.llm.scratch import Scratch
from seasonspark.llm.vectors import as_arrays

#: Rows of the sample on which the cells are fit, vectors meant for a cell of one label, cells at most, rows of a block.
SAMPLE_ROWS, CELL_ROWS, MAX_CELLS, BLOCK_ROWS = 20_000, 1024, 1024, 1024
#: Bytes of the sample at most.
SAMPLE_BYTES = 64_000_000


def fit_cells(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of spherical k-means; empty cells keep their last centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.where(norm > 1e-12, norm, 1), centres)
    return centres


def cells_of(units: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and a mask of all cells that can be home to a vector within the threshold.

    If y lies in cell j, x is at home in i and |x - y| <= d, then x.(ci - cj) <= d |ci - cj|.
    """
    score = units @ centres.T
    home = score.argmax(1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[home]
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    mask = score[np.arange(len(units)), home][:, None] - score <= reach * gap + 1e-9
    mask[np.arange(len(units)), home] = True
    return home, mask


def _groups(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component number of each row and column of a block's link matrix, by spreading least numbers."""
    rows, cols = np.arange(hits.shape[0]), np.full(hits.shape[1], hits.shape[0])
    while True:
        new_cols = np.where(hits, rows[:, None], hits.shape[0]).min(0)
        new_rows = np.minimum(rows, np.where(hits, new_cols[None, :], hits.shape[0]).min(1))
        if (new_cols == cols).all() and (new_rows == rows).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, unit, dim = [], [], []
        for x in as_arrays(batch.column(1)):
            scale = np.abs(x).max() if x is not None and len(x) else 0.0
            if scale == 0.0:
                key.append(None), unit.append(None), dim.append(None)
                continue
            x = x + 0.0
            y = x / scale
            key.append(xxhash.xxh3_128_digest(x.tobytes()))
            unit.append((y / np.sqrt((y * y).sum())).tobytes())
            dim.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.string()), pa.array(key, pa.binary()), pa.array(unit, pa.binary()), pa.array(dim, pa.int32())], names=["id", "label", "key", "unit", "dim"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), float) for x in column])


def _assigned(centres: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                for i in range(0, len(part), 4096):
                    rows = part.slice(i, 4096)
                    home, mask = cells_of(_matrix(rows.column("unit")), centres[dim], threshold)
                    x, cell = np.nonzero(mask)
                    yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(x)) for c in ("label", "dim", "id", "n", "unit")), pa.array(cell.astype(np.int32)), pa.array(home[x] == cell)], names=["label", "dim", "id", "n", "unit", "cell", "home"])

    return run


def _block(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        lead = table.column("lead").to_numpy()
        homes, all_ = table.filter(pa.array(lead)), table.filter(pa.array(~lead))
        out = {"id": [], "links": [], "root": []}
        if len(homes) and len(all_):
            h_id, a_id = homes.column("id").to_numpy(), all_.column("id").to_numpy()
            hits = _matrix(all_.column("unit")) @ _matrix(homes.column("unit")).T >= threshold
            hits &= a_id[:, None] != h_id[None, :]
            a, h = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
            if len(a):
                hits = hits[np.ix_(a, h)]
                rows, cols = _groups(hits)
                out["id"] = np.concatenate([a_id[a], h_id[h]])
                out["links"] = np.concatenate([hits @ homes.column("n").to_numpy()[h], np.zeros(len(h), np.int64)])
                out["root"] = a_id[a][np.concatenate([rows, cols])]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, seed: int = 4) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors with equal, non-null labels are linked when their cosine in double precision reaches the
    threshold. Equal vectors of a label are one node that counts its rows. Cells are fit by spherical
    k-means on at most ``SAMPLE_ROWS`` nodes (and 64 MB); every node is at home in one cell and visits each cell in
    which a linked vector can be at home, so no link is lost. A cell's home rows are compared with all its
    rows in blocks; each ordered pair meets once. Only counts and spanning links leave a block.

    Null, zero, empty and non-finite vectors and null labels: no links, a component of their own. Vectors
    of different lengths are not linked. Null ids: no part, null component, not kept. Rows with equal ids
    are counted each. Other columns are ignored, whatever their names; an empty table gives an empty result.
    Memory is bounded by a block of vectors. Up to ``CELL_ROWS`` nodes a label all lie in one cell.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col), F.col(vector_col), F.col(label_col))
    rows = scratch.table(rows.mapInArrow(_prepared, "id long, label string, key binary, unit binary, dim int"), "rows")
    usable = rows.where("id is not null and label is not null and key is not null")
    nodes = scratch.table(usable.groupBy("label", "key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("unit").alias("unit"), F.min("dim").alias("dim")), "nodes")
    size = nodes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    k = max(1, min(MAX_CELLS, (size[0] or 0) // CELL_ROWS))
    by_dim: dict[int, list[np.ndarray]] = {r.dim: [] for r in nodes.select("dim").distinct().collect()}
    most = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(by_dim, default=1)))
    sample = nodes.orderBy(F.xxhash64("key", F.lit(seed)), "key", "label").limit(most).select("unit", "dim").collect()
    for r in sample:
        by_dim[r.dim].append(np.frombuffer(r.unit))
    centres = {dim: fit_cells(np.array(v), k, seed) if v else np.eye(1, dim) for dim, v in by_dim.items()}
    dealt = scratch.table(nodes.mapInArrow(_assigned(centres, threshold), "label string, dim int, id long, n long, unit binary, cell int, home boolean"), "cells")
    cell = ["label", "dim", "cell"]
    counts = dealt.groupBy(*cell).agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK_ROWS).alias("hs"), F.ceil(F.count("*") / BLOCK_ROWS).alias("rs"))
    at = dealt.join(counts.where("hs > 0"), cell)
    place = F.xxhash64("id")
    lead = at.where("home").withColumn("h", F.pmod(place, "hs")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rs") - 1))).withColumn("lead", F.lit(True))
    rest = at.withColumn("r", F.pmod(place, "rs")).withColumn("h", F.explode(F.sequence(F.lit(0), F.col("hs") - 1))).withColumn("lead", F.lit(False))
    columns = [*cell, "h", "r", "lead", "id", "n", "unit"]
    blocks = lead.select(*columns).unionByName(rest.select(*columns)).groupBy(*cell, "h", "r")
    found = scratch.table(blocks.applyInArrow(_block(threshold), "id long, links long, root long"), "found")
    comp = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), scratch).withColumnRenamed("id", "node")
    links = found.groupBy(F.col("id").alias("linked")).agg(F.sum("links").alias("links"))
    place = F.concat(F.col("label").cast("binary"), F.lit(b"\0"), F.col("key")).alias("place")
    classes = nodes.select(place, "id", "n").join(links, F.col("id") == F.col("linked"), "left").join(comp, F.col("id") == F.col("node"), "left")
    classes = classes.select("place", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("c"), "n")
    out = join_per_key(rows.select("id", place), classes, "place", "n", rows.count())
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    links = F.when(F.col("id").isNotNull(), F.col("n_links"))
    out = out.select(F.col("id").alias(id_col), F.coalesce(links, F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
    return scratch.last(out, "classes")
