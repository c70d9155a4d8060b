"""The decoder of the extractor against all choices, boosted trees against a plain walk, rejection limits against a literal version."""

import math
import random
from itertools import product
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from quietday.llm import boosting, html, langid


def small_tree(rng, n):
    """A page of n elements, parents before children, the first above all."""
    return SimpleNamespace(tags=["x"] * n, parents=[-1, *(rng.randrange(i) for i in range(1, n))])


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_decoding_finds_the_likeliest_consistent_choice(n):
    rng = random.Random(n)
    for _ in range(60):
        page = small_tree(rng, n)
        p = np.array([rng.choice([0.0, 1.0, rng.random(), rng.random()]) for _ in range(n)])
        worth = lambda keep, p=p: sum(math.log((x if k else 1 - x) + 1e-9) for k, x in zip(keep[1:], p[1:], strict=True))  # noqa: E731  the root is kept
        consistent = [k for k in product([True, False], repeat=n) if k[0] and all(not k[v] or k[page.parents[v]] for v in range(1, n))]
        got = html.decode(page, p)
        assert tuple(got) in consistent
        assert worth(got) == pytest.approx(max(map(worth, consistent)), abs=1e-9)


def walk(trees, row):
    """The value of each tree's leaf, by going down from its root."""
    total = trees.base
    for features, cuts, values in zip(trees.features, trees.cuts, trees.values, strict=True):
        node = 0
        while node < len(features):
            edges = trees.edges[features[node]]
            bin_ = sum(1 for e in edges if row[features[node]] >= e)
            node = 2 * node + (2 if bin_ > cuts[node] else 1)
        total += values[node - len(features)]
    return 1 / (1 + math.exp(-total))


def test_predictions_are_those_of_a_walk():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 2, 400), rng.integers(0, 5, 400), np.zeros(400)])
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0) | (x[:, 2] == 3)).astype(float)
    for depth in (1, 3):
        trees = boosting.train(x, y, rounds=6, depth=depth)
        asked = np.concatenate([x[:60], [[0.0, 1.0, 9.0, -1.0], [99.0, 0.0, 3.0, 0.0]]])
        assert trees.predict(asked) == pytest.approx([walk(trees, r) for r in asked], abs=1e-12)


def test_limits_are_those_of_a_literal_version():
    rng = random.Random(6)
    rows = [(lang, rng.randrange(2, 5000), rng.uniform(2, 8)) for lang in ("de", "en") for _ in range(400)] + [("xx", 40, 3.0), ("xx", 45, 5.0), ("xx", 600, 2.0)]
    seen = pd.DataFrame(rows, columns=["lang", "n", "upper"])
    got = langid.limits(["de", "en", "none", "xx"], seen)
    for i, lang in enumerate(["de", "en", "none", "xx"]):
        own = []
        for k in range(langid.LENGTHS):
            x = sorted(u for l, n, u in rows if l == lang and min(n.bit_length() - 1, langid.LENGTHS - 1) == k)
            if x:
                top = x[math.ceil(langid.BELOW * len(x)) - 1]
                own.append(top + langid.MARGIN * (top - (x[len(x) // 2] + x[(len(x) - 1) // 2]) / 2))
            else:
                own.append(None)
        if all(v is None for v in own):
            assert np.isinf(got[i]).all()
            continue
        first = next(v for v in own if v is not None)
        filled = []
        for v in own:
            filled.append(v if v is not None else filled[-1] if filled else first)
        assert got[i] == pytest.approx([max(filled[k:]) for k in range(langid.LENGTHS)])
