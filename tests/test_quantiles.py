"""Exact quantiles by refinement beside Spark's percentile, bit for bit."""

import math
import random

import pytest
from pyspark.sql import functions as F

from earshot.operators import clustering, intervals, quantiles, summary

SHARES = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]


def values(kind, n, seed):
    r = random.Random(seed)
    if kind == "uniform":
        return [r.random() for _ in range(n)]
    if kind == "ties":
        return [float(r.randrange(4)) for _ in range(n)]
    if kind == "one":
        return [2.5] * n
    if kind == "powers":
        return [2.0 ** r.randrange(-900, 900) * (1 if r.random() < 0.5 else -1) for _ in range(n)]
    return [r.choice([math.inf, -math.inf, math.nan, 1e308, -1e308, 0.0, r.random()]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, i, x) for j, k in enumerate(["uniform", "ties", "one", "powers", "odd"]) for i, x in enumerate(values(k, 3000, j))]
    data += [(None, i, x) for i, x in enumerate(values("uniform", 900, 9))]
    data += [("small", 0, 1.0), ("small", 1, 2.0), ("nulls", 0, None), ("nulls", 1, None), ("mixed", 0, None), ("mixed", 1, 7.0)]
    return spark.createDataFrame(data, "k string, i int, x double").repartition(7)


def shown(df):
    return {r.k: (r.n, None if r.q is None else [x.hex() for x in r.q]) for r in df.collect()}


@pytest.mark.parametrize(("few", "bins"), [(20, 16), (1000, 1024), (10**6, 8)])
def test_equal_to_percentile(rows, few, bins):
    want = rows.groupBy("k").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q"))
    assert shown(quantiles.exact_percentiles(rows, ["k"], F.col("x"), SHARES, few, bins)) == shown(want)


def test_salted_join(rows, spark, monkeypatch):
    want = shown(quantiles.exact_percentiles(rows, ["k"], F.col("x"), SHARES, 50, 32))
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 2)
    assert shown(quantiles.exact_percentiles(rows, ["k"], F.col("x"), SHARES, 50, 32)) == want


def test_without_keys_and_rows(rows):
    got = quantiles.exact_percentiles(rows.filter("k = 'uniform'"), [], F.col("x"), [0.5], 10, 16).first()
    want = rows.filter("k = 'uniform'").agg(F.median("x")).first()[0]
    assert (got.n, got.q) == (3000, [want])
    assert quantiles.exact_percentiles(rows.limit(0), ["k"], F.col("x"), [0.5]).count() == 0


def test_outliers_of_a_hot_key_do_not_depend_on_the_way(spark):
    r = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 50}", i, [r.gauss(1, 0.2) for _ in range(6)]) for i in range(1200)]
    data += [(None, 2000 + i, [r.gauss(1, 0.2) for _ in range(6)]) for i in range(40)] + [("hot", 5000, [-9.0, 1.0, 1.0, 1.0, 1.0, 1.0]), ("hot", 5001, None)]
    df = spark.createDataFrame(data, "k string, row int, vec array<double>")
    plain = {r.row: (r.distance, r.inlier) for r in clustering.mad_outliers(df, ["k"], "row", "vec").collect()}
    fine = {r.row: (r.distance, r.inlier) for r in clustering.mad_outliers(df, ["k"], "row", "vec", few=20).collect()}
    assert plain == fine
    assert len(plain) == 1241
    assert not plain[5000][1]


def test_bands_and_levels_of_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise(F.concat(F.lit("b"), F.col("id") % 9)).alias("k"), "id", (F.abs(F.hash("id")) / 1e9).alias("x"))
    for f in (lambda few: summary.quantile_bands(df, "k", "x", few).select("id", "band"), lambda few: intervals.snr_proxy(df, ["k"], "x", few)):
        assert sorted(map(tuple, f(30).collect())) == sorted(map(tuple, f(10**6).collect()))
