"""Token ids in a binary file format: patched frame-of-reference shards in ascending document order.

write() range-partitions documents by key, tokenizes them in Arrow batches and writes shards of about
SHARD_TOKENS ids, each row a self-contained pfor array with its documents' keys and lengths. read()
decodes shards independently; only one running total per written partition is broadcast (16 bytes each).
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.llm import pfor, tokens, words
from earshot.session import bound_batches, shared_dir

SHARD_TOKENS = 1 << 20
SHARDS = "part int, shard int, start long, n_tokens long, keys array<long>, lengths array<long>, ids binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id", piecewise: bool = True) -> None:
    """Write every text's ids and end_id to path. Null text counts as empty (only end_id); null keys come first.

    Rows that repeat a key each keep their own ids. A document is never cut across shards, so a very long one makes a
    large shard. An empty table gives a folder without shards; other columns are ignored.
    """

    def shards(batches):
        encoder, part = tokens.encoder(tokenizer, piecewise), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        at = shard = size = 0
        keys, parts = [], []

        def flush():
            ids = np.frombuffer(b"".join(parts), "<u4")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "start": [at], "n_tokens": [len(ids)], "keys": pa.array([keys], pa.list_(pa.int64())), "lengths": pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64())), "ids": pa.array([pfor.encode(ids)], pa.binary())})

        for batch, texts in words.text_batches(batches):
            for k, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                keys.append(k)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SHARD_TOKENS:
                    yield flush()
                    at, shard, size, keys, parts = at + size, shard + 1, 0, [], []
        if keys:
            yield flush()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long"), F.col(text)).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first())
    rows.mapInArrow(shards, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files; none if they hold no shard."""
    files = spark.read.schema(SHARDS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, n = pfor.decode(r["ids"]), r["lengths"]
                ends = np.cumsum(n)
                crcs = [zlib.crc32(ids[b - a : b]) for a, b in zip(n, ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({key: pa.array(r["keys"], pa.int64()), "start": ends - n + r["start"] + r["before"], "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return files.join(F.broadcast(before), "part").mapInArrow(documents, f"{key} long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write documents as token files in the shared folder, and read them back; see write() for nulls, repeated keys and empty tables."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write(docs, path, tokenizer or tokens.tokenizer_path(), end_id)
    return read(spark, path)
