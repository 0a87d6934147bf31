"""Validation queries: each gives violations or a one-row guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_violations(df: DataFrame, tolerance: float = 1.0, cut: float = 20.0) -> DataFrame:
    """(file, problem) of recovered ids (file, id, csv_seconds, measured_seconds, remote_seconds, confidence)."""
    out = [df.filter(~F.coalesce(F.col("id").rlike("^[A-Za-z0-9_-]{11}$"), F.lit(False))).select("file", F.lit("malformed id").alias("problem"))]
    several = df.filter("id IS NOT NULL").groupBy("id").agg(F.countDistinct(F.round("measured_seconds", 1)).alias("_n")).filter("_n > 1")
    out.append(df.join(several, "id", "left_semi").select("file", F.lit("one id, different lengths").alias("problem")))
    out.append(df.filter(F.abs(F.col("csv_seconds") - F.col("measured_seconds")) > tolerance).select("file", F.lit("recorded length differs").alias("problem")))
    out.append(df.filter((F.abs(F.col("remote_seconds") - F.col("measured_seconds")) > cut) & (F.coalesce("confidence", F.lit("")) != "rejected")).select("file", F.lit("remote length differs").alias("problem")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def confidence(local: Column, remote: Column, cut: float = 20.0) -> Column:
    return F.when(remote.isNull(), "none").when(F.abs(local - remote) <= cut, "high").otherwise("rejected")


def apply_ids(rows: DataFrame, ids: DataFrame, key: str = "file") -> DataFrame:
    """rows with high-confidence ids (key, id, url_a, url_b, confidence) applied and a status: written, same or missing."""
    good = ids.filter("confidence = 'high'").select(key, F.col("id").alias("_id"), F.coalesce(F.nullif(F.trim("url_a"), F.lit("")), F.nullif(F.trim("url_b"), F.lit(""))).alias("_url")).dropDuplicates([key])
    out = rows.join(good, key, "left")
    status = F.when(F.col("_id").isNull(), "missing").when(F.coalesce(F.col("id") == F.col("_id"), F.lit(False)), "same").otherwise("written")
    return out.withColumn("status", status).withColumns({"id": F.coalesce("_id", "id"), "url": F.coalesce("_url", "url")}).drop("_id", "_url")


def sample_design(df: DataFrame, key: str, cells: list[str], caps: list[str], order: str) -> DataFrame:
    """One row: rows, unique keys, least and most rows in a cell, most rows of each cap column, contiguous order."""
    n = df.groupBy(*cells).count().agg(F.min("count").alias("least_cell"), F.max("count").alias("most_cell"))
    out = df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), ((F.min(order) == 1) & (F.max(order) == F.count("*")) & (F.countDistinct(order) == F.count("*"))).alias("contiguous")).crossJoin(n)
    for c in caps:
        out = out.crossJoin(df.groupBy(c).count().agg(F.max("count").alias(f"most_{c}")))
    return out


def outside_enum(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def count_guard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of both tables, and whether they are as many."""
    return a.agg(F.count("*").alias("left")).crossJoin(b.agg(F.count("*").alias("right"))).withColumn("equal", F.col("left") == F.col("right"))


def key_audit(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of right that repeat, rows of left without a match."""
    twice = right.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("repeated"))
    return left.join(right.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("missing")).crossJoin(twice)
