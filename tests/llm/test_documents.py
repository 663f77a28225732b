"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasonspark.llm import minhash, mix, packing, sstable, toxicity
from seasonspark.llm.scratch import Scratch
from seasonspark.llm.tokens import WordEncoder, encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, extra string"


def corpus(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(6):
            c = list(b)
            for _ in range(rng.randint(0, 1 + len(c) // 15)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append("\n\t ".join(c).upper() if rng.random() < 0.3 else " ".join(c))
    texts += [texts[0], texts[0], texts[1], "", "  \n", None, None, "one", "ONE", "one ", "é two", "É two", " ".join(words * 60)]
    return [(i * 3, t, rng.choice(["a", "b", "c", None]) if i % 3 else "hot", "x") for i, t in enumerate(texts)]


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text, k):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("listed", [48, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, listed):
    monkeypatch.setattr(minhash, "LISTED_BUCKET", listed)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0 if listed == 2 else 300_000)
    rows = corpus()
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), width=width).collect()}
    sets = {r[0]: shingles(r[1], width) for r in rows}
    want = brute_components(sets)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 30


def test_near_duplicates_odd_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c", "s", "x"), (5, "a b c", "s", "x"), (5, "a b c", "s", "x"), (2, None, "s", "x"), (1, "", "s", "x")]
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), width=2).collect())
    assert got == [(False, 1, 1, True), (False, 2, 2, True), (False, 5, 5, True), (False, 5, 5, True), (True, None, None, False)]


def test_min_and_max_agree_with_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 2000, np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**64, 400, np.uint64)])
    hashing = minhash.MinMax(40, 5, 1)
    same = (hashing.signature(np.unique(a)) == hashing.signature(np.unique(b))).mean()
    assert same == pytest.approx(1600 / 2400, abs=0.12)


def goals(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left, share = total - cap * sum(sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * w[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("propensity", [None, "size"])
def test_mix_reaches_its_targets(spark, propensity):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["a", "a", "a", "b", "c", "d", None]), "x") for i in range(900)] + [(9000, None, "tiny", "x"), (9001, "one", "tiny", "x"), (9002, "", "a", "x")]
    df = spark.createDataFrame(rows, DOCS)
    column = None if propensity is None else F.sqrt(mix.word_count(F.col("text")).cast("double") + 1)
    got = mix.mix(df, propensity=column).collect()
    again = mix.mix(df.repartition(7), propensity=column).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size, source = {r[0]: len(words_of(r[1])) for r in rows}, {r[0]: r[2] for r in rows}
    totals = Counter()
    for i, s in source.items():
        totals[s] += size[i]
    want, taken = goals(totals), Counter()
    for r in got:
        assert (r["size"], r.source_size) == (size[r.doc_id], totals[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows)
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, abs=40)  # the longest document


def test_mix_inclusion_follows_the_odds(spark):
    rows = [(i, "w w", "a" if i < 4000 else "b", "x") for i in range(4500)]
    got = mix.mix(spark.createDataFrame(rows, DOCS), weights=(1, 1), propensity=F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(1.0)).where("doc_id < 4000").collect()
    even, odd = (np.mean([r.copies for r in got if r.doc_id % 2 == k]) for k in (0, 1))
    assert even / odd == pytest.approx(2, abs=0.25)


def test_mix_goes_on_behind_a_very_long_document(spark):
    rng = random.Random(4)
    u = {i: (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(1400)}
    long = sorted(range(301), key=u.get)[10]
    sizes = {("a", i): rng.choice([5, 50, 51, 52]) for i in range(301)} | {("b", i): rng.randint(1, 60) for i in range(1000, 1400)} | {("a", long): 40_000}
    rows = [(i, "w " * n, s, "x") for (s, i), n in sizes.items()]
    want = {}
    for s in "ab":
        target = goals({x: sum(n for (y, _), n in sizes.items() if y == x) for x in "ab"}, (1, 1))[s]
        e = target / sum(n for (y, _), n in sizes.items() if y == s)
        certain, p = int(e), e - int(e)
        mine = {i: n for (y, i), n in sizes.items() if y == s}
        gap = target - certain * sum(mine.values())
        order = {i: (u[i] / (1 - u[i])) / (p / (1 - p)) for i in mine}
        for i in sorted(mine, key=order.get):
            take = mine[i] <= gap
            gap -= mine[i] * take
            want[i] = certain + take
    assert want[long] == 0 and sum(want[i] for i in range(301)) == 300
    got = {r.doc_id: r.copies for r in mix.mix(spark.createDataFrame(rows, DOCS), weights=(1, 1), propensity=None).collect()}
    assert got == want


def test_mix_odd_tables(spark):
    assert mix.mix(spark.createDataFrame([], DOCS)).count() == 0
    empty = mix.mix(spark.createDataFrame([(1, None, None, "x"), (1, "", "a", "x")], DOCS)).collect()
    assert [(r["size"], r.taken, r.target) for r in empty] == [(0, 0, 0.0)] * 2


ODD = ["", " ", "<|endoftext|> a <|ENDOFTEXT|>x <|endoftext|>, it's,IT'S don't'S \xa0x\x85\x1c\x1fq é. ́ < 4,5. ÉTÉ. İ. ΣΣ,  q �. .. ,. a,. 中文. é. É,", "A.B.,c. d,\te.\n", "x" * 3000]


def test_word_encoder_equals_the_library():
    fast, slow = WordEncoder(PATH), Tokenizer.from_file(PATH)
    texts = [t or "" for _, t, _, _ in corpus()] + ODD
    for chunk in (texts, texts[::-1]):
        got = fast.encode([t.encode() for t in chunk])
        for t, ids in zip(chunk, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids


def test_word_encoder_forgets(monkeypatch):
    from seasonspark.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN_WORDS", 3)
    fast = WordEncoder(PATH)
    first = fast.encode([b"alpha beta gamma delta epsilon"])
    assert fast.encode([b"zeta"]) and fast.encode([b"alpha beta gamma delta epsilon"]) == first


def token_table(rows, end):
    encode = encoder(PATH).encode
    return [(r[0], np.append(np.frombuffer(encode([(r[1] or "").encode()])[0], "<u4"), end).astype("<u4")) for r in rows]


@pytest.mark.parametrize("shard", [1 << 20, 700])
def test_packing_is_a_partition(spark, shard):
    rows = corpus() + [(None, "no id", "a", "x"), (3, "again", "a", "x")]
    got = packing.pack(spark.createDataFrame(rows, DOCS), PATH, window=512, shard_tokens=shard).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        whole[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, ids in token_table(rows, 2):
        want[i].append(ids)
    for i, pieces in whole.items():
        if len(want[i]) > 1:
            continue
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert b"".join(r.ids for r in pieces) == want[i][0].tobytes()
        assert all(r.doc_tokens == len(want[i][0]) and len(r.ids) == 4 * r.length for r in pieces)
    assert sum(r.length for r in got) == sum(len(x) for v in want.values() for x in v)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        n = sum(r.length for r in pieces)
        assert n <= 512 and n & (n - 1) == 0
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_neighbours_rank_by_shared_rare_terms():
    docs = [np.array(x) for x in ([1, 2, 3, 9], [1, 2, 50, 51], [1, 3, 9, 9], [60, 61, 62, 63])]
    index = packing.Bm25(docs, 64)
    unused = np.array([False, True, True, True])
    assert list(index.neighbours(0, unused)) == [2, 1]  # the last one shares nothing


def test_long_seed_finds_a_like_document():
    rng = np.random.default_rng(0)
    shared, own = np.arange(500, 800), np.arange(1000, 1500)
    others = [rng.integers(0, 400, 300) for _ in range(20)]
    docs = [np.concatenate([own, shared]), *others, np.concatenate([shared, others[0][:50]])]
    unused = np.arange(len(docs)) > 0
    assert next(packing.Bm25(docs).neighbours(0, unused)) == len(docs) - 1
    windows = packing.Windows(1400, 0)
    packing._fill(windows, [(i, d.astype("<u4").tobytes(), len(d)) for i, d in enumerate(docs)])
    windows.finish()
    assert [p[0] for p in windows.done][:2] == [0, len(docs) - 1]


def test_packing_puts_like_with_like():
    rng = np.random.default_rng(0)
    docs = [(i, (rng.integers(0, 50, 60) + 1000 * (i % 4)).astype("<u4").tobytes(), 60) for i in range(80)]
    windows = packing.Windows(600, 0)
    packing._fill(windows, docs, query_terms=64)
    windows.finish()
    kinds = defaultdict(set)
    for piece in windows.done:
        kinds[piece[4]].add(piece[0] % 4)
    assert sum(len(k) == 1 for k in kinds.values()) >= len(kinds) - 4


def test_neighbours_come_in_order_beyond_the_first(monkeypatch):
    monkeypatch.setattr(packing, "FIRST", 3)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 40, 20) for _ in range(50)]
    index, unused = packing.Bm25(docs), np.arange(50) % 3 > 0
    got = list(index.neighbours(0, unused))
    one = lambda d: sum(index.weight[k] for t in np.unique(docs[0]) if index.df[t] > 1 for k in range(index.ends[t], index.ends[t + 1]) if index.doc[k] == d)
    want = sorted((d for d in range(50) if unused[d] and one(d) > 0), key=lambda d: (-round(one(d), 9), d))
    assert got == want


def test_what_has_no_score_is_tried_with_the_next_shard():
    make = lambda i, low: (i, (np.arange(30) + low).astype("<u4").tobytes(), 30)
    windows = packing.Windows(90, 0)
    left = packing._fill(windows, [make(0, 0), make(1, 100), make(2, 10)], carry=100)
    assert [d[0] for d in left] == [1]
    assert packing._fill(windows, [*left, make(3, 110), make(4, 200)], carry=0) == []
    windows.finish()
    assert [p[0] for p in windows.done if p[4] == 0] == [0, 2, 1] and [p[0] for p in windows.done][3] == 3


def test_like_documents_meet_from_far_apart(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    text = lambda: [rng.choice(words) for _ in range(60)]
    pairs = [text() for _ in range(60)]
    rows = [(i, " ".join(p), "s", "x") for i, p in enumerate(pairs)] + [(1000 + i, " ".join(text()), "s", "x") for i in range(600)]
    rows += [(100 + i, " ".join([*p[:55], "kak", "kek"]), "s", "x") for i, p in enumerate(pairs)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartitionByRange(4, "doc_id"), PATH, window=1024, shard_tokens=6000).collect()
    at = defaultdict(set)
    for r in got:
        at[r.doc_id].add(r.sequence_id)
    # Dealt by place, a pair would meet in one of some twenty shards; other windows may take a partner first.
    assert sum(bool(at[i] & at[100 + i]) for i in range(60)) >= 30


def test_token_shards_round_trip(spark, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 500)
    rows = corpus() + [(None, "no id", "a", "x"), (3, "again", "a", "x"), (-7, "below", "a", "x")]
    folder = Scratch(spark, "test").path("sst")
    shards = sstable.write_shards(spark.createDataFrame(rows, DOCS).repartition(5), PATH, folder)
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in sstable.read_shards(shards).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == np.cumsum([0] + [len(r[2]) // 4 for r in got])[:-1].tolist()
    assert sorted(r[2] for r in got) == sorted(x.tobytes() for _, x in token_table(rows, 1))
    want = dict(token_table(rows, 1))
    for s in shards.collect():
        with sstable.Reader(s.uri) as reader:
            for i, ids in list(reader.scan()):
                assert any(np.array_equal(ids, x) for x in reader.get(i))
                if i not in (3,):
                    assert np.array_equal(reader.get(i)[0], want[i])
            assert reader.get(10**12) == [] and sum(map(len, (reader.get(10**9 + k) for k in range(200)))) == 0
    assert sstable.read_shards(sstable.write_shards(spark.createDataFrame([], DOCS), PATH, folder + "-none")).count() == 0


def test_shard_damage_is_found(tmp_path):
    writer = sstable.Writer(f"file://{tmp_path}/x.sst")
    for i in range(500):
        writer.add(sstable.key_of(i), np.arange(i % 90, dtype="<u4") + (70000 if i % 7 == 0 else 0))
    writer.close()
    data = bytearray((tmp_path / "x.sst").read_bytes())
    with sstable.Reader(f"file://{tmp_path}/x.sst") as reader:
        assert [i for i, _ in reader.scan()] == list(range(500))
        assert reader.get(77)[0].tolist() == (np.arange(77) + 70000).tolist()
    data[20] ^= 255
    (tmp_path / "y.sst").write_bytes(bytes(data))
    with pytest.raises(Exception), sstable.Reader(f"file://{tmp_path}/y.sst") as reader:  # noqa: B017
        list(reader.scan())


def labelled(n=1200, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    bad = ["zorkel", "zorkla", "vunt"]
    out = []
    for i in range(n):
        y = int(rng.random() < 0.2)
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 3) * y):
            k = rng.randrange(len(lines))
            lines[k] += " " + rng.choice(bad) + " here"
        out.append((i, ". ".join(lines), y))
    return out


def test_toxicity_on_held_out_documents(spark):
    rows = labelled() + [(5000, None, 0), (5001, "", 1), (5002, "?!. \n", 0)]
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(99999, 1), (None, 1)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, labels, fold != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0 and i < 5000]
    right = [(got[i].score >= 0.5) == bool(y) for i, _, y in held]
    assert np.mean(right) > 0.97
    assert got[5000].score == got[5001].score == got[5002].score == 0.0
    for i, t, y in held:
        if y:
            assert any(re.search("zork|vunt", t[s.start : s.end]) for s in got[i].offending)
        assert all(0 <= s.start < s.end <= len(t) for s in got[i].offending)


def test_noisy_or_by_brute_force():
    model = toxicity.train(*zip(*((t.encode(), y) for _, t, y in labelled(300, 2)), strict=True))
    for _, t, _ in labelled(40, 9):
        clean, spans = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", t):
            words = {w.strip(".,;:!?\"'()[]{}<>*_-").lower() for w in m[0].split()} - {""}
            z = model.bias + sum(float(model.weights[f]) for w in words for f in toxicity.features(w.encode()))
            p = 1 / (1 + np.exp(-z))
            clean *= 1 - p
            if p >= 0.5:
                spans.append((m.start(), m.end()))
        got, found = model.score(t.encode())
        assert got == pytest.approx(1 - clean, abs=1e-5) and [(a, b) for a, b, _ in found] == spans
    assert model.bias < 0 and np.count_nonzero(model.weights) > 0


def test_training_raises_the_likelihood():
    rows = [(t.encode(), y) for _, t, y in labelled(200, 3)]
    texts, ys = [t for t, _ in rows], [y for _, y in rows]

    def loss(model):
        p = np.clip([model.score(t)[0] for t in texts], 1e-9, 1 - 1e-9)
        return -np.mean(np.where(ys, np.log(p), np.log(1 - p)))

    assert loss(toxicity.train(texts, ys)) < 0.5 * loss(toxicity.train(texts, ys, epochs=0))


def test_a_score_of_one_half_is_toxic_and_long_texts_are_whole(spark):
    model = toxicity.Model(np.zeros(toxicity.DIMENSIONS, np.float32), 0.0)
    rows = [(1, "one sentence", "s", "x"), (2, "two. two", "s", "x"), (3, "a" * 3_000_000, "s", "x"), (4, "b. " * 100_000, "s", "x")]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, DOCS), model).collect()}
    assert got[1].score == 0.5 and len(got[1].offending) == 1 and got[2].score == 0.75 and got[3].score == 0.5
    assert got[4].score == 1.0 and len(got[4].offending) == 100_000


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x")], DOCS)
    for rows in ([], [(1, 0)], [(1, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"), F.lit(True))
        assert toxicity.score(docs, model).first().score < 0.5
    assert toxicity.score(spark.createDataFrame([], DOCS), model).count() == 0
    assert toxicity.score(docs.withColumn("score", F.lit("old")), model).dtypes[-2] == ("score", "double")


def test_other_columns_of_any_name_are_ignored(spark):
    rows = corpus()[:40] + [(9000, "word " * 50_000, "a", "x")]
    plain = spark.createDataFrame(rows, DOCS)
    names = "id n key buckets component_id kept size source_size target copies taken e order certain s scale propensity ids start length tie place label bucket pivot".split()
    wide = plain.select("*", *(F.lit("x").alias(n) for n in names))
    for run in (
        lambda d: minhash.near_duplicates(d), lambda d: mix.mix(d), lambda d: packing.pack(d, PATH).select("doc_id", "start", "length", "doc_tokens"),
        lambda d: sstable.read_shards(sstable.write_shards(d, PATH, Scratch(spark, "test").path("sst"))).select("doc_id", "start"),
    ):
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(plain).collect()))
    with pytest.raises(ValueError):
        mix.mix(wide, carry=("taken",))


def test_bands_miss_few_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    hashing = minhash.MinMax(40, 5, 20)
    for both, union in ((4, 5), (8, 10), (40, 50)):
        match = []
        for _ in range(300):
            s = rng.integers(0, 2**64, union, np.uint64)
            a, b = s[: union - (union - both) // 2], np.concatenate([s[:both], s[union - (union - both) // 2 :]])
            match.append((hashing.buckets(np.unique(a)) == hashing.buckets(np.unique(b))).mean())
        assert (1 - np.mean(match)) ** 40 < 1e-5


def test_workers_drop_what_an_earlier_task_left():
    """Spark keeps Python workers: the next stage's task does not carry the words that a tokenizing one remembers."""
    import pyarrow as pa

    from seasonspark.llm import queries, tokens, workers

    def run(batches):
        for batch in batches:
            seen.append(len(tokens._encoders))
            yield batch

    batches, seen = [pa.RecordBatch.from_pydict({"x": [1]}), pa.RecordBatch.from_pydict({"x": [2, None]})], []
    tokens.encoder(queries.TOKENIZER).encode([b"some words to remember"])
    assert list(workers.tidy(run, tokenizes=True)(iter(batches))) == batches
    assert list(workers.tidy(run)(iter(batches))) == batches
    assert seen == [1, 1, 0, 0]
