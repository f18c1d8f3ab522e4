"""The counterfactual classifier: every row counts, scores and optimum against the loss written out, swaps move no score."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tessera.llm import toxicity as T


def lopsided(n, seed=1):
    """Lines of a small vocabulary in which some names of religions stand mostly in toxic ones."""
    rng, terms = random.Random(seed), T.IDENTITY_TERMS["religion"]
    out = []
    for i in range(n):
        y = i % 2
        name = rng.choice(terms[:6]) if y and rng.random() < 0.8 else rng.choice(terms)
        out.append((f"{rng.choice(['those', 'the', 'all', 'some'])} {name} {'are awful vile' if y else 'are kind people'} {rng.choice(['here', 'there', 'now'])}", y))
    return out


def logit(text, model):
    p = T.score_text(text, model)
    return math.log(p / (1 - p))


@pytest.mark.parametrize("n", [320, 1200])
def test_any_two_names_of_a_kind_score_alike(n):
    model = T.fit(lopsided(n))
    found = [logit(f"the {w} are here today", model) for w in T.IDENTITY_TERMS["religion"]]
    assert max(found) - min(found) < 0.05
    assert T.score_text("they are awful vile", model) > 0.7 and T.score_text("they are kind people", model) < 0.3


def test_every_row_counts():
    """Rows that share most words are not one: twice as many toxic lines of the same words raise the base rate."""
    rows = [(f"the cat sat on mat number {i}", int(i % 3 == 0)) for i in range(90)]
    model = T.fit(rows)
    assert T.score_text("", model) == pytest.approx(1 / 3, abs=0.02)


def written_out_loss(weight, bias, rows, vocabulary, ridge=5e-5, penalty=1.0):
    """Mean log loss, ridge, and the mean squared change of the logit over every swap, from whole feature sets."""
    at = lambda bag: sum(weight.get(w, 0.0) for w in bag if w in vocabulary)
    loss, changes = 0.0, []
    for text, y in rows:
        z = bias + at(T.features_of(text))
        loss += math.log1p(math.exp(z)) - y * z
        words = T.words_of(text)
        for w in words & T.KIND.keys():
            for other in T.IDENTITY_TERMS[T.KIND[w]]:
                if other not in words:
                    changes.append(at(T.features_of(" ".join((words - {w}) | {other}))) - at(T.features_of(text)))
    return loss / len(rows) + ridge / 2 * sum(v * v for v in weight.values()) + penalty * float(np.mean(np.square(changes))) if changes else loss / len(rows)


def test_fit_is_the_optimum_of_the_loss_written_out():
    rows = lopsided(60, 3) + [("women and immigrants came", 0)] * 6 + [("idiots came", 1)] * 6
    model = T.fit(rows, epochs=4000)
    vocabulary = set(T._vocabulary(rows, 5, 4.0))
    weight = {w: model.weight.get(w, 0.0) for w in vocabulary}
    best = written_out_loss(weight, model.bias, rows, vocabulary)
    step = 1e-4
    for w in vocabulary:
        moved = [written_out_loss(weight | {w: weight[w] + s}, model.bias, rows, vocabulary) for s in (step, -step)]
        assert abs(moved[0] - moved[1]) / (2 * step) < 2e-3, w  # no slope in any weight
        assert min(moved) > best - 1e-6


def test_scores_are_the_sum_of_the_features_weights():
    model = T.fit(lopsided(200, 5) + [("immigrants immigration immigrating", 1)] * 8 + [("relation relations related", 0)] * 8)
    for text in ("", "the jews are awful", "immigrants immigrated", "Those VILE Muslims; vile!", "x" * 5000, "immigrant " * 3000):
        want = model.bias + sum(model.weight.get(f, 0.0) for f in T.features_of(text))
        assert logit(text, model) == pytest.approx(want, abs=1e-9)
