"""Table functions from SQL beside the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from earshot.functions import tables
from earshot.operators import evaluation, splits


def test_replicates_follow_their_table(spark):
    tables.register(spark)
    rows = [(1, "a"), (2, None), (3, "ü:")]
    df = spark.createDataFrame(rows, "k long, name string")
    df.createOrReplaceTempView("units")
    got = spark.sql("SELECT * FROM replicates(TABLE(units), 20, 7)")
    assert got.dtypes == [("k", "bigint"), ("name", "string"), ("replicate", "int"), ("w", "bigint")]
    want = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("w", evaluation.multiplicity(7, "k", "name", "replicate"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert spark.sql("SELECT * FROM replicates(TABLE(SELECT * FROM units WHERE k > 9), 20, 7)").count() == 0
    assert spark.sql("SELECT * FROM replicates(TABLE(units), 0, 7)").count() == 0


@pytest.mark.parametrize("call", ["replicates(TABLE(SELECT 1.5D AS x), 3, 1)", "replicates(TABLE(SELECT 1 AS w), 3, 1)", "replicates(TABLE(SELECT 1 AS k), -1, 1)", "greedy_splits(TABLE(SELECT 1 AS k), 'k', 'k', 'mass', 'k')"])
def test_wrong_arguments_are_named_before_the_query_runs(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="keys are|name of a result|negative|no column"):
        spark.sql(f"SELECT * FROM {call}").schema  # noqa: B018


def test_greedy_splits_equal_the_operator(spark):
    tables.register(spark)
    rows = [(c, g, float(1 + (g * 7919) % 50)) for c in ("x", "y", None) for g in range(60)] + [("z", 1, 4.0), ("hot", 5, 1.0)] + [("hot", g, 3.0) for g in range(100, 400)]
    df = spark.createDataFrame(rows, "region string, customer long, m double")
    df.createOrReplaceTempView("rows")
    got = spark.sql("SELECT * FROM greedy_splits(TABLE(SELECT region, customer, m, sum(m) OVER (PARTITION BY region) AS total FROM rows), 'region', 'customer', 'm', 'total')")
    assert got.columns == ["region", "customer", "split"]
    want = splits.disjoint_splits(df.filter("region IS NOT NULL"), "region", "customer", F.col("m")).select("region", "customer", "split")
    own = {tuple(r) for r in got.collect()}
    assert {r for r in own if r[0] is not None} == {tuple(r) for r in want.collect()}
    assert {(g, s) for r, g, s in own if r is None} == {(g, s) for r, g, s in own if r == "x"}
    nothing = spark.sql("SELECT * FROM greedy_splits(TABLE(SELECT 'a' AS region, 1 AS customer, CAST(NULL AS DOUBLE) AS m, 1D AS total), 'region', 'customer', 'm', 'total')")
    assert [tuple(r) for r in nothing.collect()] == [("a", 1, None)]
