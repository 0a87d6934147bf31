"""Registries: pipe-delimited tables of channels and playlists, and their checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.text import blank, playlist_url, sanitize
from earshot.operators.quantiles import spread_join

#: The registry's columns and enumerations.
COLUMNS = ("region", "source", "show", "url", "url_type", "lang_flag", "status", "channel_id", "playlist_id", "n_playlists", "n_videos", "added", "score", "keywords", "notes")
BACKUP = ".bak"
ENUMS = {"status": ("pending", "approved", "rejected", "done"), "url_type": ("channel", "playlist", "video")}


MOST_HEADERS = 1_000


def _marked_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, header): lines that count, and whether they are the first such line of their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.filter((F.trim("value") != "") & ~F.ltrim(F.col("value")).startswith("#"))

    def run(batches):
        last = (None, None)  # file and block of the line before; a task reads blocks one after another, in their order
        for b in batches:
            file, at = np.array(b.column(1).to_pylist(), object), b.column(2).to_numpy()
            if len(at):
                first = np.concatenate([[(file[0], at[0]) != last], (file[1:] != file[:-1]) | (at[1:] != at[:-1])])
                last = (file[-1], at[-1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(first.astype(bool) & (at == 0))], names=["value", "file", "header"])

    return lines.mapInArrow(run, "value string, file string, header boolean")


def read_registry(spark: SparkSession, path: str, columns=COLUMNS, sep: str = "|") -> DataFrame:
    """Rows of delimited files with quotes: blank lines and full-line # comments are dropped, cells trimmed.

    Each file's header is its first line that counts (in its first block); later lines that equal it are rows. Files may have different headers, at most MOST_HEADERS of them.
    Canonical columns that are missing come as '', other columns of the headers stay last. All columns are text. A cell ends with its line.
    """
    lines = _marked_lines(spark, path)
    heads = lines.filter("header").select("file", F.col("value").alias("_head"))
    kinds = sorted(r[0] for r in heads.select("_head").distinct().limit(MOST_HEADERS + 1).collect())
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"over {MOST_HEADERS} headers")
    body = lines.filter("not header").select("file", "value")
    if len(kinds) > 1:
        body = spread_join(body, heads, ["file"])
    names = [[c.strip().strip('"') for c in k.split(sep)] for k in kinds] or [list(columns)]
    extra = list(dict.fromkeys(c for header in names for c in header if c not in columns))
    out = None
    for k, header in zip(kinds or [None], names, strict=True):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        own = body.filter(F.col("_head") == k) if len(kinds) > 1 else body
        rows = own.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r")).select("r.*")
        rows = rows.select(*[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(c) if c in header else F.lit("").alias(c) for c in [*columns, *extra]])
        out = rows if out is None else out.unionByName(rows)
    return out


def sanitized(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(sanitize(F.col(c).cast("string")), F.lit("")).alias(c) for c in df.columns])


def write_registry(df: DataFrame, path: str, sep: str = "|") -> None:
    """Sanitised cells in a delimited folder. What was there before the first overwriting is kept in path + BACKUP, once."""
    spark = df.sparkSession
    old, backup = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + BACKUP))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(old) and not files.exists(backup):
        spark.read.text(path).write.text(path + BACKUP)
    # df may come from the old version, so it is written apart and moved
    new = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    sanitized(df).write.mode("overwrite").option("sep", sep).option("header", True).csv(path + ".new")
    files.delete(old, True)
    files.rename(new, old)


def picked_rows(df: DataFrame) -> DataFrame:
    """Registry columns for picked playlists (playlist_id, source and optional others)."""
    have = set(df.columns)
    values = {c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in have else F.lit("") for c in COLUMNS}
    values |= {"url": playlist_url(F.col("playlist_id")), "url_type": F.lit("playlist"), "status": F.lit("pending"), "lang_flag": F.lit("arabic"), "source": F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown"))}
    return df.withColumns(values)


def violations(df: DataFrame, key: str, enums=ENUMS) -> DataFrame:
    """(key, level, problem) rows: enumerations, blank urls, duplicate channel ids, contaminated cells."""
    found = []
    for c, allowed in enums.items():
        found.append(df.filter(~blank(F.col(c)) & ~F.lower(c).isin(*allowed)).select(key, F.lit("error").alias("level"), F.lit(f"bad {c}").alias("problem")))
    found.append(df.filter(blank(F.col("url"))).select(key, F.lit("error").alias("level"), F.lit("blank url").alias("problem")))
    twice = df.filter(~blank(F.col("channel_id"))).groupBy("channel_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    found.append(df.join(twice, "channel_id", "left_semi").select(key, F.lit("warning").alias("level"), F.lit("duplicate channel_id").alias("problem")))
    dirty = F.lit(False)
    for c in ("source", "show", "notes"):
        if c in df.columns:
            dirty = dirty | F.coalesce(F.col(c).contains("|") | F.col(c).contains('""'), F.lit(False))
    found.append(df.filter(dirty).select(key, F.lit("warning").alias("level"), F.lit("pipe or doubled quote").alias("problem")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def bad_lines(lines: DataFrame, fields: int, sep: str = "|") -> DataFrame:
    """Lines (column value) whose number of cells, quotes respected, is not `fields`."""
    bare = F.regexp_replace("value", '"[^"]*"', "q")
    return lines.filter(F.size(F.split(bare, f"\\{sep}", -1)) != fields)
