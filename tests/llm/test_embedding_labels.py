"""Labels that need more passes than there may be, many labels off the origin, and lone pairs at the threshold."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import embed_dedup as E


def pair_at(rng, centre, noise, cosine=0.983):
    """Two vectors around a centre at about the cosine."""
    a = centre + noise * rng.normal(size=len(centre))
    a /= np.linalg.norm(a)
    b = rng.normal(size=len(a))
    b -= (b @ a) * a
    b /= np.linalg.norm(b)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def table(spark, labels, per_label, spread, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    rows, vectors = [], []
    for label in range(labels):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        found = []
        while len(found) < per_label:
            found += pair_at(rng, centre, spread)
        for v in found[:per_label]:
            vectors.append(v)
            rows.append((len(rows), label, v.tolist()))
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), np.array(vectors), np.repeat(np.arange(labels), per_label)


def brute(vectors, labels):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = np.zeros(len(vectors), dtype=int)
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        close = unit[at] @ unit[at].T >= 0.98
        links[at] = close.sum(axis=1) - 1
    return links


@pytest.mark.parametrize("spread", [0.5, 0.15])
def test_labels_beyond_the_passes_are_compared_whole(spark, spread):
    """No pass is allowed to such a label, so every link comes from its blocks: all of them are there."""
    df, vectors, labels = table(spark, 2, 400, spread)
    got = E.linked_vectors(df, window=64, block=50, passes=1, most_passes=0).toPandas().sort_values("vec_id")
    assert got.n_links.tolist() == brute(vectors, labels).tolist()


def test_every_large_label_is_centred(spark):
    """Forty labels far off the origin: links found by passes alone, with a recall of 0.95 at least."""
    df, vectors, labels = table(spark, 40, 200, 0.2, seed=3)
    large = E._large_labels(df.selectExpr("vec_id AS node", "label", "embedding", "size(embedding) AS size"), 32)
    assert {r.label for r in large.collect()} == set(range(40)) and all(len(r.centre) == 16 for r in large.collect())
    got = E.linked_vectors(df, window=64, most_passes=1000).toPandas().sort_values("vec_id")
    want = brute(vectors, labels)
    assert (got.n_links <= want).all()
    assert got.n_links.sum() >= 0.95 * want.sum()
