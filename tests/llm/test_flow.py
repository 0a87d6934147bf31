"""The mix's flow beside unit augmentations by Bellman-Ford, and at thousands of patterns."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import mixing

INF = float("inf")


def cheapest(patterns, targets, most):
    """(words, cost) of a cheapest maximum flow, one word after another over a cheapest path."""
    names = [*patterns, *targets]
    at = {x: i + 2 for i, x in enumerate(names)}
    edges = []
    for p, n in patterns.items():
        edges += [[0, at[p], n, 2**k] for k in range(most)] + [[at[p], at[s], 99, 0] for s in p]
    edges += [[at[s], 1, t, 0] for s, t in targets.items()]
    edges = [e for a, b, c, w in edges for e in ([a, b, c, w], [b, a, 0, -w])]
    words = cost = 0
    while True:
        far, via = [0] + [INF] * (len(names) + 1), {}
        for _ in range(len(names) + 2):
            for i, (a, b, c, w) in enumerate(edges):
                if c > 0 and far[a] + w < far[b]:
                    far[b], via[b] = far[a] + w, i
        if far[1] == INF:
            return words, cost
        words, cost, b = words + 1, cost + far[1], 1
        while b:
            i = via[b]
            edges[i][2] -= 1
            edges[i ^ 1][2] += 1
            b = edges[i][0]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sets(st.sampled_from("abcd"), min_size=1).map(lambda s: tuple(sorted(s))), st.integers(0, 6), min_size=1, max_size=6), st.lists(st.integers(0, 15), min_size=4, max_size=4))
def test_as_cheap_as_single_words(patterns, quotas):
    targets = {s: q for s, q in zip("abcd", quotas, strict=True) if any(s in p for p in patterns)}
    got = mixing.route(patterns, targets)
    assert all(0 <= got[p] <= 3 * n + 1e-6 for p, n in patterns.items())
    spent = sum(2**k * max(0, min(n, got[p] - k * n)) for p, n in patterns.items() for k in range(3))
    assert (sum(got.values()), spent) == pytest.approx(cheapest(patterns, targets, 3))


def test_thousands_of_overlapping_patterns():
    r = random.Random(1)
    patterns = {}
    while len(patterns) < 5000:
        patterns[tuple(sorted(r.sample(range(20), r.randint(1, 6))))] = r.randint(1, 100_000)
    own = [sum(n for p, n in patterns.items() if s in p) for s in range(20)]
    targets = dict(enumerate(mixing.water_fill(own, [1 + s % 3 for s in range(20)], 3, sum(patterns.values()))))
    began = time.time()
    got = mixing.route(patterns, targets)
    assert time.time() - began < 30
    assert sum(got.values()) == pytest.approx(sum(patterns.values()))
    assert all(0 <= got[p] <= 3 * n for p, n in patterns.items())
