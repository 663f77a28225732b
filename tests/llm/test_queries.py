"""The registered corpus queries and the pipeline on whole small tables, against brute force."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seasonspark.llm import queries as corpus

from ..conftest import SF
from .test_documents import brute_components, goals, shingles, words_of


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def token_ids(documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {r[0]: np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids, "<u4") for r in documents}


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = corpus.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(corpus.oracle_sql()[name])
    assert columns == sorted(want.columns)
    order = ", ".join(f'"{c}"' for c in columns)
    key = lambda r: tuple((x is None, x) for x in r)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows == sorted(db.sql(f"SELECT {order} FROM ({corpus.oracle_sql()[name]})").fetchall(), key=key)


def check_pieces(rows, documents, window=4096):
    """Each document's pieces are its ids, each sequence is gapless; returns the share of padding."""
    copies, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        copies[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, ids in documents:
        n = Counter(r.start for r in copies[i]).get(0, 0)
        whole = sum(r.length for r in copies[i])
        assert n >= 1 and whole == n * len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in copies[i])
        covered = np.zeros(len(ids) + 1, int)
        for r in copies[i]:
            covered[r.start] += 1
            covered[r.start + r.length] -= 1
        assert (np.cumsum(covered)[:-1] == n).all()
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        n = sum(r.length for r in pieces)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding / sum(r.length for r in rows)


def test_op3(spark, token_ids):
    rows = corpus.op3_retrieval_packing(spark, SF).collect()
    assert check_pieces(rows, [(i, np.append(x, 2).astype("<u4")) for i, x in token_ids.items()]) < 0.01


def test_op10(spark, token_ids):
    want, start = [], 0
    for i in sorted(token_ids):
        ids = np.append(token_ids[i], 1).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus.op10_token_shards(spark, SF).collect()) == want


def test_op9(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in corpus.op9_style_tree_text(spark, SF).collect()}
    for i, url, page in pages:
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page)
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body[1] if body else "")).split())
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))


def test_op7(spark, documents):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    rows = corpus.op7_sentence_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == [r[0] for r in documents]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    clean = [r.predicted == 0 for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(clean) > 0.95


def test_op7_finds_held_out_toxic_documents(spark):
    folder = SF.replace("0.001", "0.1")
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    held = [r for r in corpus.op7_sentence_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 1]) > 0.85
    assert np.mean([1 - r.predicted for r in held if labels[r.doc_id] == 0]) > 0.98


def test_pipeline_stage_by_stage(spark, documents, token_ids, tmp_path):
    docs, kept, mixed = spark.read.parquet(f"{SF}/documents.parquet"), None, None
    source, text = {r[0]: r[3] for r in documents}, {r[0]: r[1] for r in documents}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name == "toxicity":
            labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
            gone = set(text) - {r.doc_id for r in rows}
            assert all(tuple(r) in set(documents) for r in rows)
            assert sum(labels.get(i) == 0 for i in gone) <= 2
            assert sum(labels.get(i) == 1 for i in gone) >= 0.5 * sum(y == 1 for y in labels.values())
        elif name == "near_duplicates":
            component = brute_components({r.doc_id: shingles(r.text, 5) for r in before.collect()})
            kept = {r.doc_id for r in rows}
            assert kept == set(component.values()) and len(rows) == len(kept)
        elif name == "mixing":
            mixed = Counter(r.doc_id for r in rows)
            sizes, totals, taken = {i: len(words_of(text[i])) for i in kept}, Counter(), Counter()
            for i in kept:
                totals[source[i]] += sizes[i]
                taken[source[i]] += mixed[i] * sizes[i]
            assert docs.columns == list(corpus_pipeline.COLUMNS) and set(mixed) <= kept and max(mixed.values()) <= 3
            for s, t in goals(totals).items():
                assert abs(taken[s] - t) <= max(sizes[i] for i in kept if source[i] == s)
        else:
            want = [(i, np.append(token_ids[i], 2).astype("<u4")) for i in mixed]
            assert check_pieces(rows, want) < 0.02
            assert Counter(r.doc_id for r in rows if r.start == 0) == mixed
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


ODD = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11), (3, None, "en", None, None), (4, "", None, "s", 0), (None, "a b c d e f", "en", "s", 11), (None, None, None, None, None)]


def test_pipeline_stages_on_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], kind)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    docs = spark.createDataFrame(ODD, kind).selectExpr("*", "1 AS score", "2 AS size", "3 AS id", "4 AS copies")
    assert corpus_pipeline.drop_toxic(spark, docs, SF).count() == len(ODD)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None", "None"]
    assert corpus_pipeline.mix_sources(spark, docs, SF).columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.pack_sequences(spark, docs, SF).select("doc_id").distinct().count() == 5
