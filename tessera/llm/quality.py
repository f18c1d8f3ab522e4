"""Document quality by supervised subword embeddings.

A document's features are its words, its pairs of neighbouring words and the
character n-grams of each word with its boundaries. Each feature is hashed to a
learned vector, a document is the mean of its features' vectors, and a softmax
layer gives the class. Training is numpy stochastic gradient descent, one
document a step, on a bounded sample of labelled rows; the vectors have a
higher rate than the output layer, for a feature's share of a mean is small.

For frozen weights the score's logit is the mean of one number per feature, so
texts are scored in whole buffers of bytes: hashes, lookups and sums of all
their features at once. A text longer than a buffer goes in pieces cut between
words (a longer word is cut itself); the pair of words at a cut counts.

Nulls and odd input: null and empty texts have no feature and get the score of
the softmax biases; whole texts of any length count in full; repeated rows each
get a row; no labelled rows at all give the score 0.5 throughout; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bucket_of, labelled_sample, utf8

#: Bytes in a buffer; the arrays beside it take about a hundred times that.
BUFFER = 1 << 20
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ODD, _PAIR = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
#: Powers of an odd number and of its inverse modulo 2^64: a run's hash is a difference of two running sums.
_POWER = np.concatenate([[np.uint64(1)], np.full(BUFFER + 64, _ODD, dtype=np.uint64)]).cumprod(dtype=np.uint64)
_INVERSE = np.concatenate([[np.uint64(1)], np.full(BUFFER + 64, pow(_ODD, -1, 1 << 64), dtype=np.uint64)]).cumprod(dtype=np.uint64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_ODD)
    return (h >> np.uint64(40)).astype(np.int64) % buckets


@dataclass(frozen=True)
class Settings:
    """buckets: at most 2^24. low, high: lengths of the character n-grams."""

    buckets: int = 1 << 18
    low: int = 3
    high: int = 4


def features(data: np.ndarray, s: Settings, before: int | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int | None]:
    """(places, buckets) of each kind of feature of a buffer that starts and ends with a blank; and its last word's hash.

    Byte 0 parts documents and 32 words; before: the hash of the word that the buffer goes on from.
    """
    inside = data > 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([[np.uint64(0)], (data * _POWER[: len(data)]).cumsum(dtype=np.uint64)])
    word = (sums[ends] - sums[starts]) * _INVERSE[starts]
    kinds = [(starts, _bucket(word, s.buckets))]
    # a pair belongs to its second word; none spans two documents
    parted = (data == 0).cumsum()[starts]
    first = np.concatenate([np.array([before or 0], dtype=np.uint64), word])[: len(word)]
    pair = np.concatenate([[before is not None], parted[1:] == parted[:-1]])[: len(word)]
    kinds.append((starts[pair], _bucket(first[pair] * _PAIR + word[pair] + np.uint64(1), s.buckets)))
    blanks = np.where(data == 0, np.uint8(32), data).astype(np.uint64)
    for n in range(s.low, s.high + 1):
        if len(data) < n:
            break
        whole = np.ones(len(data) - n + 1, dtype=bool)
        h = np.full(len(whole), np.uint64(n))
        for k in range(n):
            h = h * np.uint64(257) + blanks[k : k + len(whole)]
            if 0 < k < n - 1:
                whole &= inside[k : k + len(whole)]
        at = np.flatnonzero(whole)
        kinds.append((at, _bucket(h[at], s.buckets)))
    return kinds, int(word[-1]) if len(word) else before


def _plain(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    return np.where(_BLANK[data] | (data == 0), np.uint8(32), np.maximum(data, np.uint8(33)))


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of a buffer at most, cut between words where there is a blank."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BUFFER)
        if end < len(data):
            blanks = np.flatnonzero(data[at:end] == 32)
            end = at + int(blanks[-1]) + 1 if len(blanks) else end
        yield data[at:end]
        at = end


_ENDS = np.array([32], dtype=np.uint8)


def _long_text(data: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """The buckets of a text of any length, a kind of one piece at a time."""
    before = None
    for piece in pieces(data):
        kinds, before = features(np.concatenate([_ENDS, piece, _ENDS]), s, before)
        yield from (ids for _, ids in kinds)


@dataclass(frozen=True)
class SubwordModel:
    """Weights of the positive class over the negative one, bucket by bucket; 0 where none was met in training."""

    weight: np.ndarray
    bias: float
    settings: Settings


def score_texts(texts: list[bytes], model: SubwordModel) -> np.ndarray:
    """The chance of label 1 of each whole text."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) + 3 <= BUFFER:
            size += len(texts[j]) + 3
            j += 1
        if j == i:
            for ids in _long_text(_plain(texts[i]), model.settings):
                total[i] += model.weight[ids].sum(dtype=np.float64)
                count[i] += len(ids)
            i += 1
            continue
        # a blank before and after each text, and a 0 between
        data = np.full(size, 32, dtype=np.uint8)
        sizes = np.array([len(t) + 3 for t in texts[i:j]])
        ends = np.cumsum(sizes)
        for text, end, n in zip(texts[i:j], ends.tolist(), sizes.tolist()):
            data[end - n + 1 : end - 2] = _plain(text)
        data[ends - 1] = 0
        sums, counts = np.zeros(size), np.zeros(size)
        for at, ids in features(data, model.settings)[0]:
            sums[at] += model.weight[ids]
            counts[at] += 1
        total[i:j] = np.add.reduceat(sums, ends - sizes)
        count[i:j] = np.add.reduceat(counts, ends - sizes)
        i = j
    logit = model.bias + total / np.maximum(1, count)
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _bag(text: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their shares of all its features."""
    found = [np.unique(ids, return_counts=True) for ids in _long_text(_plain(text), s)]
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    unique, at = np.unique(np.concatenate([ids for ids, _ in found]), return_inverse=True)
    n = np.bincount(at, np.concatenate([k for _, k in found]))
    return unique.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def fit(rows: list[tuple[bytes, int]], settings: Settings = Settings(), dims: int = 8, epochs: int = 6, rate: float = 0.5, vector_rate: float = 10.0, seed: int = 7) -> SubwordModel:
    """Train on (text, label) rows; one pass over the rows in a new random order each epoch."""
    rng = np.random.default_rng(seed)
    bags = [(*_bag(text, settings), y) for text, y in rows]
    vectors = rng.uniform(-1 / dims, 1 / dims, (settings.buckets, dims)).astype(np.float32)
    met = np.zeros(settings.buckets, dtype=bool)
    for ids, _, _ in bags:
        met[ids] = True
    out = np.zeros((dims, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, at = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share, y = bags[i]
            left = 1 - at / steps
            at += 1
            mine = vectors[ids]
            hidden = share @ mine
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * left * np.outer(hidden, p)
            bias -= rate * left * p
            mine -= (vector_rate * left * share)[:, None] * back
            vectors[ids] = mine
    weight = np.where(met, vectors @ (out[:, 1] - out[:, 0]), 0)
    return SubwordModel(weight.astype(np.float32), float(bias[1] - bias[0]), settings)


def score_quality(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """(doc_id, score) of every whole text; score is the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = score_texts(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, fold: int = 1, parts: int = 3, most: int = 4000) -> DataFrame:
    """Fit outside the held-out fold on at most `most` labelled rows, score all rows."""
    model = fit(labelled_sample(docs, labels, "quality", fold, parts, most))
    held = F.coalesce(bucket_of(F.col("doc_id"), parts) == fold, F.lit(False))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
