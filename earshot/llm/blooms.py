"""Counting Bloom pass over hashes, built and probed with SQL functions only.

The filter is blocked: a hash picks one block of 32,768 bits, then K bits inside it. Pass one counts
how many rows hit each bit and keeps the bits hit at least twice, so a hash with a single-hit bit
occurs once for certain. The filter has BITS_PER_ROW bits for each row up to MAX_BITS (32 MB), which
bounds what is broadcast; beyond that it lets more unrepeated rows through and results stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32_768
K = 2
BITS_PER_ROW = 16
MAX_BITS = 1 << 28


def _bits(h: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(k)), F.lit(BLOCK)) for k in range(1, K + 1)]


def n_blocks(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    return max(1, min(max_bits, rows * bits_per_row) // BLOCK)


def repeated_bits(hashes: DataFrame, h: str, blocks: int, least: int = 2) -> DataFrame:
    """(block, bits): per block, a bitmap of the bits that `least` or more rows hit."""
    hits = hashes.select(F.pmod(F.col(h), F.lit(blocks)).alias("block"), F.explode(F.array_distinct(F.array(*_bits(F.col(h))))).alias("bit"))
    twice = hits.groupBy("block", "bit").count().filter(F.col("count") >= least)
    return twice.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def flag_repeated(df: DataFrame, h: str, bitmaps: DataFrame, blocks: int, flag: str) -> DataFrame:
    """df with a boolean column: may this row's hash occur twice? The bitmaps (at most MAX_BITS bits) are broadcast."""
    marks = F.broadcast(bitmaps.select(F.col("block").alias("_bloom_block"), F.col("bits").alias("_bloom_bits")))
    out = df.join(marks, F.pmod(F.col(h), F.lit(blocks)) == F.col("_bloom_block"), "left")
    hit = F.lit(True)
    for bit in _bits(F.col(h)):
        byte = F.conv(F.hex(F.col("_bloom_bits").substr(F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.expr("1").bitwiseAND(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int"))) == 1)
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_bloom_block", "_bloom_bits")


def flag_keys(df: DataFrame, key: str, keys: DataFrame, name: str, flag: str) -> DataFrame:
    """df with a boolean column: may this row's key be in column `name` of keys? keys should be a stored table."""
    return _flagged(df, F.xxhash64(key), keys.select(F.xxhash64(name).alias("_bloom_h")), flag)


def with_key(df: DataFrame, key: str, hashes: DataFrame, name: str) -> DataFrame:
    """The rows of df the xxhash64 of whose key may be in column `name` of hashes, a stored table."""
    return _flagged(df, F.xxhash64(key), hashes.select(F.col(name).alias("_bloom_h")), "_bloom_maybe").filter("_bloom_maybe").drop("_bloom_maybe")


def _flagged(df: DataFrame, h: Column, hashes: DataFrame, flag: str) -> DataFrame:
    blocks = n_blocks(hashes.count())
    return flag_repeated(df.withColumn("_bloom_h", h), "_bloom_h", repeated_bits(hashes, "_bloom_h", blocks, least=1), blocks, flag).drop("_bloom_h")


def drop_rows(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """df without the rows whose key is in gone (column `key`). Only rows that may be in it are shuffled; null keys stay."""
    rows = flag_keys(df, key, gone, key, "_bloom_maybe")
    return rows.filter("not _bloom_maybe").unionByName(rows.filter("_bloom_maybe").join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)).drop("_bloom_maybe")
