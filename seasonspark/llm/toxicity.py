"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonspark.llm.workers import tidy

#: Weights of hashed features, and words whose sum a worker remembers.
DIMENSIONS, KNOWN_WORDS = 1 << 20, 150_000
#: Evidence a feature needs and the first bias.
EVIDENCE, START, DAMPING, BALANCE = 1.4, -6.0, 1.0, 0.5
_SENTENCE = re.compile(rb"[^.!?\n]+")
_EDGE = b".,;:!?\"'()[]{}<>*_-"


def features(word: bytes) -> list[int]:
    """Hashes of a word and of its first four and five letters."""
    letters = word.decode()
    found = [zlib.crc32(b"w" + word)]
    found += [zlib.crc32(str(n).encode() + letters[:n].encode()) for n in (4, 5) if len(letters) > n]
    return [f % DIMENSIONS for f in found]


def sentences(text: bytes) -> Iterator[tuple[int, int, set[bytes]]]:
    """Span and distinct words of each sentence."""
    for m in _SENTENCE.finditer(text):
        words = {w.strip(_EDGE) for w in m[0].decode().lower().encode().split()}
        words.discard(b"")
        if words:
            yield m.start(), m.end(), words


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Logistic sentence scores: bias plus the weights of the distinct words' features."""

    weights: np.ndarray
    bias: float
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def word(self, w: bytes) -> float:
        value = self.known.get(w)
        if value is None:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            value = self.known[w] = float(sum(self.weights[f] for f in features(w)))
        return value

    def score(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or over all sentences, and byte span and score of those at 0.5 or more."""
        spans, z = [], []
        get = self.word
        for a, b, words in sentences(text):
            spans.append((a, b))
            z.append(self.bias + sum(map(get, words)))
        if not z:
            return 0.0, []
        p = _sigmoid(np.array(z))
        clean = np.exp(np.log1p(-p).sum())
        return float(min(1.0, max(0.0, 1 - clean))), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5).tolist()]


def _evidence(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """G statistic of each feature's presence against the label, from documents counted by label and feature."""
    there = counts.sum(0)
    rows = ((counts, there), (totals[:, None] - counts, totals.sum() - there))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * sum(np.nan_to_num(x * np.log(x * (totals.sum() / totals[:, None]) / n)).sum(0) for x, n in rows)


def train(
    texts: list[bytes], labels: list[int], *, epochs: int = 16, rate: float = 0.3, l2: float = 1e-6, evidence: float = EVIDENCE, start: float = START, least: int = 3, damping: float = DAMPING, balance: float = BALANCE, seed: int = 3
) -> Model:
    """AdaGrad on the noisy-or likelihood of the document labels.

    Features in fewer than ``least`` documents, or whose presence tells too little about the label (likelihood ratio below
    ``evidence`` times the logarithm of the number of documents), keep weight 0, so that a long text
    does not add up chance findings. The bias starts at ``start``.
    """
    hashed: dict[bytes, list[int]] = {}
    counts, rows = np.zeros((2, DIMENSIONS)), []
    for text, y in zip(texts, labels, strict=True):
        found, sizes = [], []
        for _, _, words in sentences(text):
            before = len(found)
            for w in sorted(words):
                found += hashed.get(w) or hashed.setdefault(w, features(w))
            sizes.append(len(found) - before)
        f = np.array(found, np.int32)
        counts[y][np.unique(f)] += 1
        rows.append((f, np.array(sizes, np.int64), y))
        if len(hashed) > KNOWN_WORDS:
            hashed.clear()
    totals = np.bincount(labels, minlength=2).astype(float)
    telling = (counts.sum(0) >= least) & (_evidence(counts, np.maximum(totals, 1)) >= evidence * np.log(max(2, len(labels))))
    weights, power, bias, bias_power = np.zeros(DIMENSIONS), np.full(DIMENSIONS, damping), start, 1.0
    docs = []
    for f, sizes, y in rows:
        if len(sizes):  # a sentence without telling words counts with the bias alone
            keep = telling[f]
            docs.append((f[keep].astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)[keep], len(sizes), y))
    del rows, counts, hashed
    rng = np.random.default_rng(seed)
    positive = sum(d[3] for d in docs)
    if not positive or positive == len(docs):
        return Model(np.zeros(DIMENSIONS, np.float32), 30.0 if positive else -30.0)
    share = {1: (0.5 * len(docs) / positive) ** balance, 0: (0.5 * len(docs) / (len(docs) - positive)) ** balance}
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            f, at, n, y = docs[i]
            p = _sigmoid(bias + np.bincount(at, weights[f], n))
            if y:
                clean = np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())
                g = -p * clean / max(1 - clean, 1e-9)
            else:
                g = p
            g = g * share[y]
            step = np.bincount(np.searchsorted(u := np.unique(f), f), g[at], len(u)) + l2 * weights[u]
            power[u] += step * step
            weights[u] -= rate * step / np.sqrt(power[u])
            bias_power += g.sum() ** 2
            bias -= 0.1 * rate * g.sum() / np.sqrt(bias_power)
    return Model(weights.astype(np.float32), float(bias))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted({(t or b"", y) for b in batches for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True)})
    model = train([t for t, _ in rows], [y for _, y in rows])
    at = np.flatnonzero(model.weights)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()]), pa.array([model.weights[at].astype("<f4").tobytes()]), pa.array([model.bias])], names=["at", "weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, max_bytes: int = 20_000) -> Model:
    """Train on a bounded sample: of the labelled rows that are ``usable``, ``per_class`` of each label by a hash
    of the id, without texts of more than ``max_bytes``. One task trains; the model has a fixed size. Null ids and
    labels other than 0 and 1 do not count, of several labels of one id the greatest does, of several texts the least. With
    one label alone, or none, the model answers 0 (or 1 if all are toxic)."""
    known = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    order = F.xxhash64(F.col(id_col))
    sample = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, id_col).limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).where(F.octet_length("text") <= max_bytes).join(F.broadcast(sample), id_col)
    rows = rows.groupBy(id_col, "y").agg(F.min("text").alias("text"))  # an id may be repeated any number of times
    row = rows.select("text", "y").repartition(1).mapInArrow(tidy(_fit), "at binary, weights binary, bias double").first()
    weights = np.zeros(DIMENSIONS, np.float32)
    if row is None:
        return Model(weights, -30.0)
    weights[np.frombuffer(row["at"], "<i8")] = np.frombuffer(row["weights"], "<f4")
    return Model(weights, row["bias"])


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``, code-point span and score of each sentence at 0.5 or more.

    Every sentence of the whole text counts, however long it is. Null, empty and wordless texts score 0 with no sentence.
    A sentence with a score of exactly 0.5 offends. Repeated rows score alike. Columns of these two names are replaced,
    others kept. An empty table gives an empty result. Memory is bounded by the longest text.
    """
    docs = docs.drop("score", "offending")
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for t in batch.column(at).cast(pa.binary()):
                text = t.as_py() or b""
                p, spans = model.score(text)
                scores.append(p)
                found.append([{"start": len(text[:a].decode()), "end": len(text[:b].decode()), "score": s} for a, b, s in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], names=[*batch.schema.names, "score", "offending"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{columns}, score double, offending array<struct<start:long,end:long,score:double>>")
