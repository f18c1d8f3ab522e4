"""Toxicity by a counterfactually regularised word classifier.

A logistic model over the set of a document's words and of word beginnings of
six letters that one, two or four of its distinct words share. Its vocabulary
holds the features whose document frequency differs clearly between the
labels, and every identity term met in training. For each labelled text that names a group, the
group's name is swapped for the others of its kind, and the squared change of
the logit over all features that come or go with the swap is penalised, so that
the name alone moves no score.

Nulls and odd input: null and empty texts get the score of the intercept;
whole texts count, whatever their length; repeated rows each get a row; with
no labelled rows every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bucket_of, labelled_sample

WORD = re.compile(r"[^\W\d_]+")

#: Names of groups, by kind; a swap stays inside a kind.
IDENTITY_TERMS = {
    "gender": "woman women man men girl boy female male nonbinary transgender trans".split(),
    "religion": "christian christians muslim muslims jew jews jewish hindu hindus buddhist buddhists sikh sikhs atheist atheists catholic catholics".split(),
    "origin": "african american arab asian black white latino latina hispanic european indian chinese mexican immigrant immigrants refugee refugees migrant migrants".split(),
    "orientation": "gay lesbian bisexual queer straight heterosexual homosexual".split(),
    "ability": "disabled deaf blind autistic".split(),
    "age": "old young elderly teenage".split(),
}
KIND = {term: kind for kind, terms in IDENTITY_TERMS.items() for term in terms}


#: Letters of a word's beginning, and how many distinct words must share it for each of its features.
PREFIX, SHARED = 6, (1, 2, 4)


@dataclass(frozen=True)
class WordModel:
    weight: dict[str, float]
    bias: float
    prefixes: frozenset[str] = frozenset()


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(text: str, prefixes: frozenset[str] | None = None) -> set[str]:
    """Words, and beginnings marked with * for each level; only `prefixes` where given."""
    bag = words_of(text)
    if prefixes is None:
        starts = [w[:PREFIX] for w in bag if len(w) > PREFIX]
    elif prefixes:
        starts = [s for w in bag if (s := w[:PREFIX]) in prefixes and len(w) > PREFIX]
    else:
        starts = []
    if starts:
        for s, n in Counter(starts).items():
            bag.update(s + "*" * level for level in SHARED if n >= level)
    return bag


def _swapped(starts: Counter, word: str, other: str) -> tuple[list[str], list[str]]:
    """The features that a text loses and gains when `other` stands for `word`, at most two each; starts: its words' beginnings."""
    old, new = (w[:PREFIX] if len(w) > PREFIX else None for w in (word, other))
    lost, gained = [word], [other]
    if old != new:
        lost += [old + "*" * n for n in SHARED if old and n == starts[old]]
        gained += [new + "*" * n for n in SHARED if new and n == starts[new] + 1]
    return lost, gained


def _vocabulary(rows: list[tuple[str, int]], least: int, z: float, buckets: int = 1 << 20) -> list[str]:
    """All features whose document frequency differs by `z` standard errors, and the identity terms met; identity terms first, then the clearest.

    Frequencies are counted by hash bucket first, so that only features whose
    bucket is frequent enough get an exact count; memory does not grow with
    the number of different words.
    """
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    counts = np.zeros(buckets, dtype=np.int32)
    for text, _ in rows:
        counts[list({crc32(w.encode()) % buckets for w in features_of(text)})] += 1
    df: dict[str, list[int]] = {}
    for text, y in rows:
        for w in features_of(text):
            if w in KIND or counts[crc32(w.encode()) % buckets] >= least:
                df.setdefault(w, [0, 0])[y] += 1
    scored = []
    for w, (a, b) in df.items():
        if a + b < least and w not in KIND:
            continue
        p = (a + b + 1) / (n[0] + n[1] + 2)
        gap = (b / max(1, n[1]) - a / max(1, n[0])) / math.sqrt(p * (1 - p) * (1 / max(1, n[0]) + 1 / max(1, n[1])))
        if abs(gap) >= z or w in KIND:
            scored.append((w not in KIND, -abs(gap), w))
    return [w for *_, w in sorted(scored)]


def fit(rows: list[tuple[str, int]], least: int = 5, z: float = 4.0, ridge: float = 5e-5, swap_penalty: float = 1.0, epochs: int = 1000, rate: float = 0.5) -> WordModel:
    """Train on (text, label) rows by full-batch gradient steps with momentum."""
    if not rows:
        return WordModel({}, -math.inf)
    vocabulary = _vocabulary(rows, least, z)
    place = {w: i for i, w in enumerate(vocabulary)}
    doc, col = [], []
    swap_from, swap_to = [], []
    for i, (text, _) in enumerate(rows):
        bag = features_of(text)
        for w in bag & place.keys():
            doc.append(i)
            col.append(place[w])
        starts = Counter(w[:PREFIX] for w in bag if len(w) > PREFIX and w[-1] != "*")
        for w in bag & KIND.keys():
            for other in IDENTITY_TERMS[KIND[w]]:
                if other not in bag:  # a feature outside the vocabulary weighs nothing
                    for out, names in zip((swap_from, swap_to), _swapped(starts, w, other)):
                        out.append([*(place.get(f, -1) for f in names), -1][:2])
    doc, col = np.array(doc, dtype=np.int64), np.array(col, dtype=np.int64)
    y = np.array([y for _, y in rows], dtype=float)
    start, end = (np.array(x, dtype=np.int64).reshape(-1, 2) for x in (swap_from, swap_to))
    k = len(vocabulary)
    theta, moved = np.zeros(k + 1), np.zeros(k + 1)
    rate_of = np.full(k + 1, rate)
    rate_of[np.concatenate([start, end])] = rate / 2  # a swap moves up to four weights, twice those of a swap of short names
    base = y.mean().clip(1e-3, 1 - 1e-3)
    bias = math.log(base / (1 - base))
    for _ in range(epochs):
        logit = bias + np.bincount(doc, theta[col], len(rows))
        gap = 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y
        grad = np.bincount(col, gap[doc], k + 1) / len(rows) + ridge * theta
        if len(start):
            change = (theta[end] - theta[start]).sum(axis=1)  # place -1 is the spare last weight, kept at 0
            pull = np.repeat(2 * swap_penalty / len(start) * change, 2)
            grad += np.bincount(end.ravel() % (k + 1), pull, k + 1) - np.bincount(start.ravel() % (k + 1), pull, k + 1)
        grad[k] = 0
        moved = 0.9 * moved - rate_of * grad
        theta = theta + moved
        bias -= rate * gap.mean()
    weight = {w: float(t) for w, t in zip(vocabulary, theta) if abs(t) > 1e-4}
    return WordModel(weight, float(bias), frozenset(w.rstrip("*") for w in weight if w[-1] == "*"))


def score_text(text: str, model: WordModel) -> float:
    logit = model.bias + sum(map(model.weight.get, features_of(text, model.prefixes), repeat(0.0)))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))


def score_toxicity(docs: DataFrame, model: WordModel) -> DataFrame:
    """(doc_id, score) of every whole text; score is the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [score_text(t or "", shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, fold: int = 2, parts: int = 4, most: int = 5000) -> WordModel:
    """A model from at most `most` labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, "toxic", fold, parts, most)
    return fit([(text.decode("utf-8", "replace"), y) for text, y in rows])


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 2, parts: int = 4, most: int = 5000, limit: float = 0.3) -> DataFrame:
    """Score all rows with a model fitted outside the held-out fold."""
    held = F.coalesce(bucket_of(F.col("doc_id"), parts) == fold, F.lit(False))
    scored = score_toxicity(docs, train(docs, labels, fold, parts, most))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fold: int = 2, parts: int = 4, most: int = 5000, limit: float = 0.3) -> DataFrame:
    """The rows of docs scored below `limit`, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold, parts, most))

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([score_text(t or "", model.value) < limit for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
