"""Bounded, repeatable samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: str):
    """Is the row in the held-out fold: crc32 of the key as text, modulo FOLDS, is 0? (null keys are)"""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled_texts(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int, key: str = "doc_id", text: str = "text") -> list[tuple]:
    """(text, label) of at most per_label rows for each label, in hash order; texts over max_chars are left out.

    labels: (key, label), one row for each key. Only keys and labels are ranked; no label's rows meet in one
    task, because rows are first thinned to about twice the sample by their hash.
    """
    counts = labels.groupBy("label").agg(F.count("*").alias("_n"))
    share = (F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)).alias("_share")
    thin = labels.select(key, "label", share).join(F.broadcast(counts), "label").filter(F.col("_share") * F.col("_n") < 2.0 * per_label + 50)
    ranked = thin.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_share", key))).filter(F.col("_r") <= per_label)
    picked = docs.select(F.col(key), F.col(text).alias("_text")).filter(F.length("_text") <= max_chars).join(F.broadcast(ranked.select(key, "label", "_r")), key)
    return [(r._text, r.label) for r in sorted(picked.select("_text", "label", "_r").collect(), key=lambda r: (str(r.label), r._r, r._text))]
