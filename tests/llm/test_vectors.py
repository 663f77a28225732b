from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonspark.llm import components, embedding_dedup, topk

ROWS = "vec_id long, embedding array<float>, label int, extra string"


def vectors(n=700, d=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, d))
    v = np.concatenate([base, *(base + rng.normal(size=base.shape) * s for s in (0.03, 0.1, 0.2, 1.0))]).astype(np.float32)
    v[50:60] = v[0]
    label = rng.integers(0, 3, len(v))
    label[: n // 10] = 0
    return v, label


def brute(rows, threshold):
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (x, la), (y, lb) = rows[a], rows[b]
            if la is None or la != lb or x is None or y is None or len(x) != len(y):
                continue
            p, q = np.array(x, float), np.array(y, float)
            if not (np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any()):
                continue
            if p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold:
                links[a] += 1
                links[b] += 1
                s, t = find(a), find(b)
                root[max(s, t)] = min(s, t)
    return links, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("cells", "block"), [(1024, 1024), (20, 16)])
@pytest.mark.parametrize("threshold", [0.98, 0.8])
def test_links_equal_brute_force(spark, monkeypatch, cells, block, threshold):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cells)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    v, label = vectors()
    odd = [([0.0] * 16, 0), (None, 0), ([float("nan")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), (v[0].tolist(), None), (v[0].tolist()[:8], 0), ([], 0), ((2 * v[0]).tolist(), 0), ([1e-30] * 16, 1), ([3e38] * 16, 1)]
    rows = [(x.tolist(), int(y)) for x, y in zip(v, label, strict=True)] + odd
    df = spark.createDataFrame([(i, x, y, "e") for i, (x, y) in enumerate(rows)], ROWS)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, threshold=threshold).collect()}
    links, component = brute([(None if x is None or None in x else x, y) for x, y in rows], threshold)
    assert {i: r.n_links for i, r in got.items()} == links
    assert [got[i].component_id for i in range(len(rows))] == component
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_cells_cover_all_close_pairs():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(400, 12))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = u + rng.normal(size=u.shape) * 0.05
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    centres = embedding_dedup.fit_cells(u, 30, 0)
    home, _ = embedding_dedup.cells_of(u, centres, 0.95)
    _, mask = embedding_dedup.cells_of(w, centres, 0.95)
    close = (u * w).sum(1) >= 0.95
    assert close.sum() > 100 and mask[np.arange(400), home][close].all() and mask.mean() < 0.7


def test_odd_tables_of_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], ROWS)).count() == 0
    rows = [(None, [1.0, 0.0], 1, "e"), (4, [1.0, 0.0], 1, "e"), (4, [1.0, 0.0], 1, "e")]
    got = sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, ROWS)).collect())
    assert got == [(False, 4, 1, 4, True), (False, 4, 1, 4, True), (True, None, 0, None, False)]


@pytest.mark.parametrize(("queries", "candidates"), [(1024, 8192), (3, 50)])
def test_top_k_equals_brute_force(spark, monkeypatch, queries, candidates):
    monkeypatch.setattr(topk, "QUERY_ROWS", queries)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", candidates)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 10)).astype(np.float32)
    v[rng.random(v.shape) < 0.6] = 0
    v[100:140] = v[0]
    rows = [(i, x.tolist(), 1, "e") for i, x in enumerate(v)] + [(1000, [1e30] * 10, 1, "e"), (1050, [2.0] * 4, 1, "e"), (1001, None, 1, "e"), (1002, [None, 1.0], 1, "e"), (1003, [float("inf")] * 10, 1, "e"), (None, v[3].tolist(), 1, "e")]
    got = topk.top_k(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 50 == 0, k=5).collect()
    ok = [(i, [int(np.floor(256 * float(y))) for y in x]) for i, x, _, _ in rows if x is not None and None not in x and np.isfinite(x).all()]
    want = []
    for q, x in ok:
        if q is not None and q % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i is None, i) for i, y in ok if i != q)[:5]  # noqa: B905
            want += [(q, n + 1, i, -s) for n, (s, _, i) in enumerate(scores)]
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_top_k_of_little(spark):
    query = F.col("vec_id") % 50 == 0
    assert topk.top_k(spark.createDataFrame([], ROWS), query).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0], 1, "e")], ROWS), query).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0], 1, "e"), (7, [0.5], 1, "e"), (0, [1.0], 1, "e")], ROWS), query).collect()
    assert [tuple(r) for r in got] == [(0, 1, 7, 256 * 128)]


def test_vectors_with_other_columns_and_a_long_one(spark):
    rows = [(0, [1.0, 0.0], 1, "e"), (50, [1.0, 0.1], 1, "e"), (7, [0.5] * 100_000, 1, "e"), (8, [0.5] * 100_000, 1, "e")]
    df = spark.createDataFrame(rows, ROWS)
    wide = df.select("*", *(F.lit("x").alias(n) for n in "id key unit dim n n_links component_id kept place cell home query q c score rank ints big".split()))
    for run in (embedding_dedup.near_vectors, lambda d: topk.top_k(d, F.col("vec_id") % 50 == 0)):
        assert sorted(map(tuple, run(wide).collect())) == sorted(map(tuple, run(df).collect()))
    assert {r.vec_id: r.component_id for r in embedding_dedup.near_vectors(wide).collect()} == {0: 0, 50: 0, 7: 7, 8: 7}


def test_keys_of_many_rows_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 10)
    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 7 = 0 THEN null ELSE string(id % 50) END AS k")
    per = rows.where("k is not null").groupBy("k").agg(F.max("id").alias("v"), F.count("*").alias("n"))
    got = components.join_per_key(rows, per, "k", "n", 500)
    assert got.columns == ["id", "k", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(per.drop("n"), "k", "left").select("id", "k", "v").collect()))
