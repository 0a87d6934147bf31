"""Vector columns with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a scaled to length 1; a zero vector stays zero."""
    return F.transform(F.array(F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def mean_vectors(df: DataFrame, keys: list[str], vec: str, normalise: bool = True) -> DataFrame:
    """(keys, n, centroid): the mean vector of each group, scaled to length 1.

    Vectors are added up component by component with partial sums before the shuffle.
    """
    dims = df.select(*keys, F.posexplode(vec).alias("_i", "_x"))
    sums = dims.groupBy(*keys, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count("*").alias("n"))
    whole = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda e: e["_s"]).alias("_v"))
    mean = F.transform(F.col("_v"), lambda x: x / F.col("n"))
    return whole.select(*keys, "n", (unit(mean) if normalise else mean).alias("centroid"))


def fuse(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shifted = F.transform(F.array(F.transform(logits, lambda x: F.exp(x - top))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))
    return shifted[0]


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1
