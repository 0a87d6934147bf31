"""Corpus pipeline: toxicity, line dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.
An empty table goes through every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from earshot.llm import line_dedup, mixing, packing, shingle_join, toxicity
from earshot.session import forget, let_workers_import, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; null and empty texts stay, rows that repeat a key are judged each for itself."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks and runs of lines; those of which no words are left go, rows with a null key stay whole."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest key of each group of similar documents (five words, 0.8); rows with a null key stay."""
    return shingle_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words go."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; every row is packed for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("shingle_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: Learned scores and hashed draws have no SQL form; tests/llm/test_pipeline.py checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            forget(last)
    return docs
