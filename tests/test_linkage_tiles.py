import numpy as np

from earshot.operators import clustering


def test_nearest_clusters_by_tiles_are_those_of_one_task(spark, monkeypatch):
    """Copies of vectors, so that many distances are equal; tiles of 3 by 5 inside blocks of 12."""
    points = np.random.default_rng(2).normal(size=(40, 5))
    df = spark.createDataFrame([("k", i, points[i % 30].tolist()) for i in range(50)], "k string, node long, vec array<double>")
    want = {r.node: r.cluster for r in clustering.average_linkage(df, "k", "node", "vec", 0.5).collect()}
    monkeypatch.setattr(clustering, "TILE", (3, 5))
    report = []
    got = {r.node: r.cluster for r in clustering.average_linkage(df, "k", "node", "vec", 0.5, block=12, report=report).collect()}
    assert got == want and len(report) > 1 and all(got[i] == got[i - 30] for i in range(30, 50))
