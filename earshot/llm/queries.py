"""Registered queries of the training-data operators: one thin query each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.llm import exact_dedup, language, lexical_search, line_dedup, media, mixing, packing, periodic_runs, pivot_search, shingle_join, token_files, toxicity, url_filter
from earshot.session import table


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "removed_chunks", "removed_lines")


def op5_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_media(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


def op9_shingle_join(spark, sf_dir):
    return shingle_join.jaccard_groups(table(spark, sf_dir, "documents"), 3, 90, 100)


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_pivot_search(spark, sf_dir):
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.find_runs(table(spark, sf_dir, "documents"), words=periodic_runs.with_repeated_tail))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_files": op3_token_files,
    "op4_line_dedup": op4_line_dedup,
    "op5_language": op5_language,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_media": op8_media,
    "op9_shingle_join": op9_shingle_join,
    "op10_mixing": op10_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_pivot_search": op12_pivot_search,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op12_pivot_search": pivot_search.ORACLE_SQL,
}
