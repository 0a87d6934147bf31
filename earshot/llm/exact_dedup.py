"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Texts are read and hashed once, into a narrow table of keys and digests. Pass one (blooms.repeated_bits) shuffles
bit numbers. Pass two tests every row against the broadcast bitmaps: rows whose hash occurs once pass straight
through; only the others are grouped by digest and byte length. No text is ever shuffled. The join of a group's survivor to its rows is salted
on both sides, so that a group holding a third of all rows is spread over SALTS tasks or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import blooms
from earshot.session import stored

SALTS = 16


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The largest key of a group stays. A group
    whose keys are all null has keep_id null, and its rows are kept. Rows that repeat both key and
    text carry the same decision. An empty table gives an empty result; other columns are ignored. Long texts are hashed
    whole and never shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(key).alias(key), F.unhex(F.sha2(body, 256)).alias("_sha"), F.octet_length(body).alias("_len")), "digests")
    rows = rows.withColumn("_h", F.xxhash64("_sha", "_len"))
    blocks = blooms.n_blocks(rows.count())
    rows = blooms.flag_repeated(rows, "_h", stored(blooms.repeated_bits(rows, "_h", blocks), "bits"), blocks, "_again")
    rows = rows.withColumn("text_sha256", F.lower(F.hex("_sha"))).drop("_sha")
    once = rows.filter("not _again").select(key, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = rows.filter("_again").drop("_again", "_h")
    groups = maybe.groupBy("text_sha256", "_len").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = maybe.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["text_sha256", "_len", "_salt"])
    return once.unionByName(joined.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
