"""Toxicity by multiple-instance learning: noisy-or over sentence scores, trained from document labels.

A sentence's score is a logistic function of the weights of its distinct words and word beginnings, less the
function's value without any (a sentence without evidence scores 0); a document's score is the noisy-or of
its sentences, 1 - prod(1 - p). Only documents carry labels; the gradient of their likelihood
passes through the noisy-or, so that blame falls on the sentences that explain the label, which can then be
located. An L1 penalty keeps only features that the labels bear out, and a leak, the chance that a label is 1 for no
sentence's sake, takes up label noise; the leak is no part of a score.

Defined cases: null and empty texts score as no sentence does (0); without a label of either kind every
score is 0; repeated rows stay repeated; very long texts are scored whole; an empty table gives no rows; columns named like
a result (``score``, ``predicted``, ``offending``) are replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import from_text, slices

#: Labelled documents of each label that a model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_PER_LABEL = 4_000
#: A feature counts if at least so many sampled documents hold it, and no more than this share of those of label 0.
LEAST_DOCUMENTS, MOST_SHARE = 4, 0.1
#: L1 penalty and steps of the fit, the leak, and the logistic function's argument without evidence.
PENALTY, STEPS, LEAK, BIAS = 5e-5, 150, 0.05, -4.0
THRESHOLD = 0.7
#: Letters of a word's beginning that are a feature beside the word.
STEM = 4
#: Words whose weight a scoring process keeps at hand.
MEMO = 200_000

_SENTENCE = re.compile(r"[.!?\n\r]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and, for longer words, its beginning."""
    whole = zlib.crc32(word.encode("utf-8", "replace"))
    return [whole, zlib.crc32(b"^" + word[:STEM].encode("utf-8", "replace"))] if len(word) > STEM else [whole]


def bag(text: str | None) -> tuple[bytes, bytes]:
    """A document's features (uint32), sentence after sentence, and the number of each sentence's (int32)."""
    sizes, all_of = [], []
    for s in sentences(text):
        mine = {f for w in set(_WORD.findall(s.lower())) for f in features(w)}
        sizes.append(len(mine))
        all_of += sorted(mine)
    return np.array(all_of, dtype=np.uint32).tobytes(), np.array(sizes, dtype=np.int32).tobytes()


def _rise(z):
    """A sentence's score from the sum of its weights, and what the logistic function itself gives."""
    full = 1 / (1 + np.exp(-np.clip(z + BIAS, -30, 30)))
    return full - 1 / (1 + np.exp(-BIAS)), full


class NoisyOr:
    """The fitted model: non-negative feature weights; without any, every score is 0."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights
        self.memo: dict[str, tuple[tuple[int, float], ...]] = {}

    def weighted(self, word: str) -> tuple[tuple[int, float], ...]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[word] = tuple((f, self.weights[f]) for f in features(word) if f in self.weights)
        return got

    def sentence_score(self, sentence: str) -> float:
        hit = {x for w in _WORD.findall(sentence.lower()) for x in self.weighted(w)}
        return float(_rise(sum(x for _, x in sorted(hit)))[0]) if hit else 0.0

    def sentence_scores(self, text: str | None) -> list[tuple[str, float]]:
        return [(s, self.sentence_score(s)) for s in sentences(text)]

    def score(self, text: str | None) -> float:
        weighted = self.weighted
        if not text or not any(map(weighted, set(_WORD.findall(text.lower())))):
            return 0.0
        left = 1.0
        for s in sentences(text):
            left *= 1 - self.sentence_score(s)
        return 1 - left


def fit(bags: list[tuple[int, bytes, bytes]]) -> NoisyOr:
    """Fit on (label, features, sentence sizes) by proximal gradient steps with momentum on the L1-penalised
    likelihood, both labels weighing the same."""
    labels = np.array([b[0] for b in bags], dtype=np.float64)
    if not len(bags) or labels.min() == labels.max():
        return NoisyOr({})
    sizes = [np.frombuffer(b[2], dtype=np.int32) for b in bags]
    raw = np.frombuffer(b"".join(b[1] for b in bags), dtype=np.uint32)
    n_sent, n_doc = sum(map(len, sizes)), len(bags)
    doc_of = np.repeat(np.arange(n_doc), [len(x) for x in sizes])
    sent_of = np.repeat(np.arange(n_sent, dtype=np.int32), np.concatenate(sizes))
    names, feats = np.unique(raw, return_inverse=True)
    once = np.unique(feats.astype(np.int64) * n_doc + doc_of[sent_of])
    spread = np.bincount(once // n_doc, minlength=len(names))
    plain = np.bincount(once // n_doc, labels[once % n_doc] == 0, minlength=len(names))
    keep = (spread >= LEAST_DOCUMENTS) & (plain <= max(LEAST_DOCUMENTS, MOST_SHARE * (labels == 0).sum()))
    place = np.cumsum(keep) - 1
    used = keep[feats]
    feats, sent_of, names = place[feats[used]], sent_of[used], names[keep]
    balance = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    kept, sent_of = np.unique(sent_of, return_inverse=True)  # the other sentences score 0
    doc_of, n_sent = doc_of[kept], len(kept)
    w = np.zeros(len(names))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p, full = _rise(np.bincount(sent_of, w[feats], minlength=n_sent))
        p = np.minimum(p, 1 - 1e-9)
        gone = np.exp(np.bincount(doc_of, np.log1p(-p), minlength=n_doc)) * (1 - LEAK)
        # d(-log L) / d(-log(1 - p)) of a sentence: 1 for label 0, -gone / (1 - gone) for label 1
        rate = np.where(labels == 1, -gone / (1 - gone), 1.0) * balance
        slope = full * (1 - full) / (1 - p) * rate[doc_of]
        g = np.bincount(feats, slope[sent_of], minlength=len(w))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        size = 0.15 / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-4)
        w = np.maximum(w - size * m1 / (1 - 0.9**step) - size * PENALTY, 0)
    return NoisyOr({int(names[i]): float(w[i]) for i in np.flatnonzero(w)})


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", where: Column | None = None) -> NoisyOr:
    """Fit on at most SAMPLE_PER_LABEL labelled documents of each label among the labels' rows that fit ``where``.
    A key labelled more than once counts with its larger label, a key with several texts with the greatest."""
    marks = labels if where is None else labels.where(where)
    marks = marks.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    marks = marks.groupBy("k").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("k", F.lit(11)))
    picked = [marks.where(F.col("y") == y).orderBy("h", "k").limit(SAMPLE_PER_LABEL) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]).select("k", "y"))  # at most twice the sample bound
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(chosen, "k").groupBy("k", "y").agg(F.max("t").alias("t"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in bags], pa.binary()), pa.array([x[1] for x in bags], pa.binary())], ["h", "y", "f", "s"])

    packed = rows.select(F.xxhash64("k", F.lit(11)).alias("h"), "y", "t").mapInArrow(pack, "h long, y int, f binary, s binary")
    return fit([(r["y"], bytes(r["f"]), bytes(r["s"])) for r in sorted(packed.toLocalIterator(), key=lambda r: (r["h"], r["y"], r["f"]))])


def score_documents(docs: DataFrame, model: NoisyOr, text: str = "text", columns: tuple[str, ...] = ("doc_id",), locate: bool = False) -> DataFrame:
    """The named columns with score and predicted of every row, and with ``locate`` the offending sentences:
    those that alone reach the threshold, in text order."""
    kind = "score double, predicted int" + ", offending array<string>" * locate

    def make():
        def run(texts: pa.Array) -> Iterator[pa.StructArray]:
            for part in slices(texts):
                held = part.to_pylist()
                score = np.array([model.score(t) for t in held], dtype=np.float64)
                said = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
                if locate:
                    said.append(pa.array([[s.strip() for s, p in model.sentence_scores(t) if p >= THRESHOLD] for t in held], pa.list_(pa.string())))
                yield pa.StructArray.from_arrays(said, ["score", "predicted", "offending"][: len(said)])

        return run

    return from_text(docs, columns, text, kind, make)
