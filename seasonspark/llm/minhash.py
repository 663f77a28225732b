"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonspark.llm.components import components, join_per_key
from seasonspark.llm.scratch import Scratch
from seasonspark.llm.workers import tidy

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Rows of one verification group besides its pivot, and the rows of a table that may be broadcast.
GROUP_ROWS, BROADCAST_ROWS = 256, 300_000
#: Members up to which a bucket's pairs are listed, and members and shingles of a block beyond.
LISTED_BUCKET, BLOCK_ROWS, BLOCK_SHINGLES = 48, 2048, 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of an UTF-8 text.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Fewer words than
    ``width`` make one shingle of all of them; no words make none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    s = h[:n] + np.uint64(width)
    for j in range(1, width):
        s = (s * M1) ^ ((h[j : n + j] + M2) * M2)
    return np.unique(_mixed(s))


class MinMax:
    """Signatures that keep the least and the greatest hash under each of ``bands * rows / 2`` permutations."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**64, (n, 1), np.uint64)
        self.salt = rng.integers(0, 2**64, (bands,), np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        low = high = None
        for i in range(0, len(s), 2048):
            x = self.a * s[None, i : i + 2048]
            x += self.b
            lo, hi = x.min(1), x.max(1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.stack([low, high], 1).reshape(-1)[: self.bands * self.rows]

    def buckets(self, s: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key per band."""
        v = self.signature(s).reshape(self.bands, self.rows)
        k = self.salt.copy()
        for j in range(self.rows):
            k = _mixed((k * M2) ^ v[:, j])
        return k.view(np.int64)


def _sketches(width: int, bands: int, rows: int, seed: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinMax(bands, rows, seed)
        for batch in batches:
            n, key, out = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                out.append(hashing.buckets(s) if len(s) else None)
            flat = np.concatenate([x for x in out if x is not None] or [np.empty(0, np.int64)])
            ends = np.cumsum([0] + [0 if x is None else bands for x in out]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists], schema=schema)

    return run


def _confirm(width: int, percent: int):
    """Rows come by ``(a, block)``, the pivot's first; each member is compared with the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for batch in batches:
            us, vs = [], []
            a, block, ids, lead, text = (batch.column(i) for i in range(5))
            text = text.cast(pa.binary())
            for i, key in enumerate(zip(a.to_pylist(), block.to_pylist(), strict=True)):
                s = shingle_set(text[i].as_py(), width)
                if key != at:
                    at, pivots = key, []
                if lead[i].as_py():
                    pivots.append(s)
                    continue
                for p in pivots:
                    if _linked(p, s, percent):
                        us.append(key[0])
                        vs.append(ids[i].as_py())
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets reach the similarity. Each group has one pivot and at most some hundred members."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    need = scratch.table(
        dealt.select("a", "block", F.col("b").alias("id"), F.lit(False).alias("lead"))
        .unionByName(dealt.select("a", "block", F.col("a").alias("id"), F.lit(True).alias("lead")).distinct()),
        "need",
    )
    small = need.count() <= BROADCAST_ROWS
    rows = texts.join(F.broadcast(need) if small else need, "id").select("a", "block", "id", "lead", "text")
    sorted_rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("lead"))
    links = scratch.table(sorted_rows.mapInArrow(tidy(_confirm(width, percent)), "u long, v long").distinct(), "links")
    scratch.drop(need)
    return links


def _linked(p: np.ndarray, s: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, s, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(p) + len(s) - both)


def _compare_blocks(width: int, percent: int):
    """Rows come by ``(cluster, i, j)``: the nodes of blocks i and j, whose open pairs are held against each other."""

    def compare(rows: list[tuple], i: int, j: int) -> tuple[list[int], list[int]]:
        us, vs, root, sets = [], [], {}, {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def of(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_set(rows[x][4].as_py(), width)
            return sets[x]

        keys = np.array([r[3] for r in rows])
        left = [x for x, r in enumerate(rows) if r[2] == i]
        right = np.array([x for x, r in enumerate(rows) if r[2] == j], np.int64)
        n = np.array([r[5] for r in rows])
        for x in left:
            near = right[(keys[right] == keys[x]).any(1) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            for y in near.tolist():
                if (i == j and y <= x) or find(rows[x][1]) == find(rows[y][1]):
                    continue
                if _linked(of(x), of(y), percent):
                    us.append(rows[x][0])
                    vs.append(rows[y][0])
                    root[find(rows[x][1])] = find(rows[y][1])
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def done() -> pa.RecordBatch:
            us, vs = compare(rows, at[1], at[2]) if rows else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for batch in batches:
            cluster, i, j, ids, c, k, n = (batch.column(x).to_pylist() for x in range(7))
            buckets, text = batch.column(7), batch.column(8).cast(pa.binary())
            for x, key in enumerate(zip(cluster, i, j, strict=True)):
                if key != at:
                    yield done()
                    at, rows = key, []
                rows.append((ids[x], c[x], k[x], buckets[x].values.to_numpy(), text[x], n[x]))
        yield done()

    return run


def _block_links(many: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Links between components that meet in large buckets: nodes joined by such buckets form a cluster, cut into blocks."""
    near = components(many.select(F.col("id").alias("u"), F.col("lead").alias("v")), scratch)
    of = many.select("id", "n", "c").distinct().join(near, "id", "left").select("id", "n", "c", F.coalesce("component_id", "id").alias("cluster"))
    blocks = of.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = of.join(blocks, "cluster").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "id", "c", "k")
    need = scratch.table(dealt.join(nodes.select("id", "n", "buckets"), "id"), "need")
    small = need.count() <= BROADCAST_ROWS // 10
    rows = texts.join(F.broadcast(need) if small else need, "id").select("cluster", "i", "j", "id", "c", "k", "n", "buckets", "text")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
    links = scratch.table(rows.mapInArrow(tidy(_compare_blocks(width, percent)), "u long, v long").distinct(), "links")
    scratch.drop(need, near)
    return links


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, seed: int = 20
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two documents are linked when 100 * |A n B| >= percent * |A u B| for their sets of distinct
    ``width``-word shingles. Documents with equal sets are one node from the start. Nodes that share
    a band's bucket are candidates. With 40 bands of 5 values a pair at 0.8 is missed with a probability
    of about 1.2e-7 if its union is large; the least and the greatest value of one permutation depend on each other
    in small sets, where it rises (measured by a test; below 1e-5 at five shingles). Every link is confirmed on full sets. First all nodes of a bucket are held
    against its smallest, so that most groups of copies merge without their pairs being listed.
    Then every pair of a bucket that is still in different components is held against each other:
    listed for small buckets, as products of blocks for large ones. None is skipped.

    No words or null text: an empty set, linked with nothing. Null ids: returned with null
    component, not kept. Rows with equal ids each take the class of their own set. Very long texts are read whole:
    a task holds one text, its set, and the sets of one block. Other columns are ignored, whatever their names.
    An empty table gives an empty result. The result is written to the shared folder, the tables it took are deleted.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.table(texts.mapInArrow(tidy(_sketches(width, bands, rows, seed)), "id long, n long, key binary, buckets array<long>"), "sketches")
    nodes = sketch.where("key is not null and id is not null").groupBy("key").agg(F.min(F.struct("id", "n", "buckets")).alias("x"), F.count("*").alias("copies"))
    nodes = scratch.table(nodes.select("key", "x.*", "copies"), "nodes")
    rows_of = nodes.select("id", "n", F.explode("buckets").alias("bucket"))
    shared = rows_of.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("pivot"), F.max("id").alias("last")).where("last > pivot.id")
    open_ = scratch.table(rows_of.join(shared.select("bucket", "pivot"), "bucket").distinct(), "candidates")
    fits = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
    pair = (F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))

    stars = open_.select(F.col("pivot.id").alias("a_id"), F.col("pivot.n").alias("a_n"), F.col("id").alias("b_id"), F.col("n").alias("b_n"))
    tested = scratch.table(stars.where("a_id <> b_id").where(fits).select(*pair).distinct(), "pairs")
    links = _verified(tested, texts, scratch, width, percent)
    comp = components(links, scratch)

    marked = open_.drop("pivot").join(comp, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
    mixed = marked.groupBy("bucket").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("id").alias("lead"))
    mixed = scratch.table(mixed.where("low < high").select("bucket", "m", "lead"), "mixed")
    marked = scratch.table(marked.join(mixed, "bucket"), "open")
    scratch.drop(open_, comp)
    few = marked.where(f"m <= {LISTED_BUCKET}")
    a, b = (few.select("bucket", *(F.col(k).alias(f"{p}_{k}") for k in ("id", "n", "c"))) for p in "ab")
    rest = a.join(b, "bucket").where("a_id < b_id and a_c <> b_c").where(fits).select(*pair).distinct()
    rest = scratch.table(rest.join(tested, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(rest, texts, scratch, width, percent))
    many = marked.where(f"m > {LISTED_BUCKET}")
    links = links.unionByName(_block_links(many, nodes, texts, scratch, width, percent))
    comp = components(links, scratch)
    classes = nodes.select("key", "id", "copies").join(comp, "id", "left").select("key", F.coalesce("component_id", "id").alias("c"), "copies")
    out = join_per_key(sketch.select("id", "n", "key"), classes, "key", "copies", sketch.count())
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    out = out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")
    )
    return scratch.last(out, "classes")
