import random

import numpy as np
import pytest

from earshot.operators import components


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {x: root(x) for x in parent}


def graph(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    return edges + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 660)] + [(7, 7)]


def test_forest():
    for seed in range(20):
        e = np.array(graph(seed))
        x, y = components.forest(e[:, 0], e[:, 1])
        want = brute(graph(seed))
        assert dict(zip(x.tolist(), y.tolist())) == {k: v for k, v in want.items() if k != v}


@pytest.mark.parametrize("per_task", [2_000_000, 60])
def test_connected_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "EDGES_PER_TASK", per_task)
    e = graph(1)
    df = spark.createDataFrame([*e, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == brute(e)
    assert components.connected_components(df.limit(0)).count() == 0
