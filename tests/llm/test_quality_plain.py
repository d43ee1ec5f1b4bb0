"""The quality classifier's features, risk and prior against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from hippolake.llm import quality

MEMBERS = (" ", "\n", "\t\r\v\f", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "'\"()-", "#$%&*+=@^~", "<>/\\|_`{}[]")
BLANK = " \t\n\r\v\f"


def plain_features(text: str) -> list[float]:
    data = text.encode()
    counts = [0] * 14
    for b in data:
        kind = next((i for i, m in enumerate(MEMBERS, 1) if b < 128 and chr(b) in m), 12 if 128 <= b < 192 else 13 if b >= 192 else 0)
        counts[kind] += 1
    words = data.split()
    if not words:
        return [0.0] * 23
    n, low = len(words), [w for w in words]
    same = sum(a == b for a, b in zip(low, low[1:], strict=False))
    again = 0
    for at in range(0, n, 64):
        part = low[at : at + 64]
        again += len(part) - len(set(part))
    capital = sum(len(w) >= 2 and all(65 <= c <= 90 for c in w[:2]) for w in words)
    marked = sum(chr(w[-1]) in "!?#$%&*+=@^~<>/\\|_`{}[]" for w in words if w[-1] < 128)
    one = sum(len(w) == 1 for w in words)
    chars = len(data)
    return [*(math.sqrt(c / len(data)) for c in counts), math.log1p(n) / 10, math.sqrt(same / n), again / n, math.sqrt(capital / n), math.sqrt(marked / n), math.sqrt(one / n), min(chars / n, 50) / 10, same / n, float(n < 20)]


@pytest.mark.parametrize("text", ["Hello WORLD! a b b é\n", "x", " lead and  trail \t", "MIXED {code} <tag> 12 $5 what? " * 30, "日本 語 " * 70, "the the the " * 50 + "AB!"])
def test_features_are_what_a_plain_count_says(text):
    assert np.allclose(quality.features(text), plain_features(text))


def risk(model: quality.Model, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk, as the formula says."""
    fp, fu = model.raw(p), model.raw(u)
    loss = lambda f: np.log1p(np.exp(-f)).mean()
    return prior * loss(fp) + max(0.0, loss(-fu) - prior * loss(-fp))


def test_the_fitted_model_has_the_least_risk_around():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.7, 1, (600, 5)), rng.normal(-0.7, 1, (300, 5))
    p, u = good[:300], np.concatenate([good[300:], bad])
    model = quality.fit(p, u, 0.5)
    least = risk(model, p, u, 0.5)
    flat = quality.Model(model.mean, model.scale, model.w1 * 0, model.b1 * 0, model.w2, 0.0, 0.5)
    assert least < 0.6 * risk(flat, p, u, 0.5)
    for seed in range(20):
        other = np.random.default_rng(seed)
        moved = quality.Model(model.mean, model.scale, model.w1 + other.normal(0, 0.3, model.w1.shape), model.b1, model.w2 + other.normal(0, 0.3, model.w2.shape), model.b2, 0.5)
        assert risk(moved, p, u, 0.5) > least - 1e-3


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_the_prior_is_found_without_negatives(prior):
    rng = np.random.default_rng(4)
    n = 4000
    good = rng.normal(1.5, 1, (2000, 4))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (int(n * prior), 4)), rng.normal(-1.5, 1, (n - int(n * prior), 4))])
    assert abs(quality.estimated_prior(good, rng.permutation(unlabelled)) - prior) < 0.06
    assert quality.estimated_prior(good[:3], unlabelled) == quality.DEFAULT_PRIOR
