import threading

import numpy as np

from earshot.operators import evaluation


def test_svm_probe_fits_its_classes_side_by_side(spark, monkeypatch):
    """Each fit waits until those of all three classes have begun."""
    rng = np.random.default_rng(3)
    centres = np.eye(3)
    df = spark.createDataFrame([(i, i % 3, "test" if i % 5 == 0 else "train", (centres[i % 3] + rng.normal(scale=0.2, size=3)).tolist()) for i in range(60)], "node long, label int, split string, vec array<double>")
    one_by_one = {r.node: r.pred for r in evaluation.svm_probe(df, "vec", "label", max_iter=2, at_once=1).collect()}
    begun = threading.Barrier(3, timeout=60)

    class Together(evaluation.LinearSVC):
        def _fit(self, dataset):
            begun.wait()
            return super()._fit(dataset)

    monkeypatch.setattr(evaluation, "LinearSVC", Together)
    got = {r.node: (r.label, r.pred) for r in evaluation.svm_probe(df, "vec", "label", max_iter=2).collect()}
    assert {k: p for k, (_, p) in got.items()} == one_by_one
    assert sum(a == p for a, p in got.values()) > 50
