"""Readers and writers of the corpus's files. All paths are read and written by Spark's tasks; trees of small files through pyarrow.fs."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.session import in_tasks, stored

FILES_A_TASK = 4_000
FOLDERS_A_TASK = 8

#: The segment manifest's columns. file_id stays text: an id such as 55917924e225 is no number.
MANIFEST = "file_id string, speaker_id string, start_time double, end_time double, duration double, macro_class string, sub_cat string, playlist string, source string, master_audio_path string, is_excluded string, dialect_strength double, quality string"
SIDECAR = "id string, title string, channel string, channel_id string, playlist_id string, playlist_name string, upload_date string, duration double, webpage_url string"


def read_resources(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Union of one CSV per resource under <region>/<playlist>/, with region and playlist from the folders."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return rows.withColumns({"region": F.url_decode(F.element_at(parts, -3)), "playlist": F.url_decode(F.element_at(parts, -2))})


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, speaker_id, start, end) of SPEAKER lines; end is start plus duration."""
    cells = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("file_id"), cells.alias("c")).filter(F.get("c", F.lit(0)) == "SPEAKER")
    start, length = F.get("c", F.lit(3)).try_cast("double"), F.get("c", F.lit(4)).try_cast("double")
    return lines.select("file_id", F.get("c", F.lit(7)).alias("speaker_id"), start.alias("start"), (start + length).alias("end")).dropna()


def read_sidecars(spark: SparkSession, path: str, schema: str = SIDECAR) -> DataFrame:
    """One JSON document per file, in any subfolder of the folder path; a file that cannot be read gives nulls. Files are listed and read by tasks."""
    def read(batches):
        system, base = FileSystem.from_uri(_uri(path))
        for b in batches:
            for some in _by_bytes(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts = []
                for x in some:
                    with system.open_input_stream(f"{base.rstrip('/')}/{x}") as f:
                        raw = f.read()
                    texts.append(raw.decode(json.detect_encoding(raw), "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(texts, pa.string())], ["file", "text"])

    files = _listed(spark, path)
    texts = in_tasks(files, FILES_A_TASK, "path").mapInArrow(read, "file string, text string")
    rows = texts.select("file", F.explode_outer(F.from_json("text", f"array<struct<{schema}>>")).alias("r"))
    return rows.select("r.*", F.concat(F.lit(path.rstrip("/") + "/"), "file").alias("file"))


def _uri(path: str) -> str:
    return path if ":" in path else f"file://{path}"


def _by_bytes(names: list[str], sizes: list[int], most: int = 2 << 20):
    out, held = [], 0
    for name, size in zip(names, sizes, strict=True):
        if out and held + size > most:
            yield out
            out, held = [], 0
        out.append(name)
        held += size
    if out:
        yield out


def with_siblings(files: DataFrame, audio: str = "wav") -> DataFrame:
    """(folder, stem, has_turns, has_sidecar) of the audio files among (folder, stem, ext)."""
    ext = F.lower("ext")
    return files.groupBy("folder", "stem").agg(F.bool_or(ext == audio).alias("audio"), F.bool_or(ext == "rttm").alias("has_turns"), F.bool_or(ext == "json").alias("has_sidecar")).filter("audio").drop("audio")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of all files under the folder path, named from there on. Tasks list the folders, a level of the tree in each round, so no list
    of files meets in the driver; a folder's own list is one task's. As for Spark, names that begin with . or _ do not count."""
    def walk(batches):
        system, base = FileSystem.from_uri(_uri(path))
        base = base.rstrip("/")
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = system.get_file_info(FileSelector(f"{base}/{folder}" if folder else base))
                for at in range(0, len(found), 4096):
                    some = [f for f in found[at : at + 4096] if f.base_name[0] not in "._"]
                    names = [f.path[f.path.rindex("/") + 1 :] for f in some]
                    out = [pa.array([f"{folder}/{n}" if folder else n for n in names], pa.string()), pa.array([f.size if f.is_file else -1 for f in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, ["path", "size"])

    level, files = spark.range(1, numPartitions=1).select(F.lit("").alias("path")), []
    while True:
        found = stored(level.mapInArrow(walk, "path string, size long"), "listed")
        files.append(found.filter("size >= 0"))
        level = found.filter("size < 0").select("path")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, files)
        level = in_tasks(level, FOLDERS_A_TASK, "path")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path).select(F.concat(F.lit(path.rstrip("/") + "/"), "path").alias("path"))


def list_harvest(spark: SparkSession, path: str, exts: tuple[str, ...] = ("wav",)) -> DataFrame:
    """(macro, sub, playlist, file) of the files <macro>/<sub>/<playlist>/<file> under path with one of the extensions."""
    parts = F.split("path", "/")
    files = _whole(spark, path).filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*exts))
    return files.select(*[F.element_at(parts, k).alias(n) for k, n in ((-4, "macro"), (-3, "sub"), (-2, "playlist"), (-1, "file"))])


def list_episodes(spark: SparkSession, path: str, audio: str = "wav") -> DataFrame:
    """with_siblings() of a tree's files; contents are not read."""
    files = _whole(spark, path)
    return with_siblings(files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)\.([^./]*)$", 1).alias("stem"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("ext")), audio)


def keyword_bank(texts: DataFrame, column: str = "value", fallback: dict[str, list[str]] | None = None) -> DataFrame:
    """(region, keyword) of bank JSON in either layout: {"regions": {...}} or the map itself; the fallback if there is none."""
    kind = "map<string,array<string>>"
    whole = F.coalesce(F.from_json(F.get_json_object(column, "$.regions"), kind), F.from_json(column, kind))
    rows = texts.select(F.explode(whole).alias("region", "_k")).select("region", F.explode("_k").alias("keyword")).filter(F.trim("keyword") != "").distinct()
    if fallback and not rows.limit(1).count():
        rows = texts.sparkSession.createDataFrame([(r, k) for r, ks in fallback.items() for k in ks], "region string, keyword string")
    return rows


def exploded_episodes(resources: DataFrame, catalogue: list[str]) -> DataFrame:
    """(file_id, class, provenance) from resource records with an episodes array; one row for each file."""
    e = resources.select("class", F.explode("episodes").alias("e")).select("class", "e.*")
    e = e.withColumn("provenance", F.when(F.col("source").isin(*catalogue), "catalogue").otherwise("search"))
    return e.groupBy("file_id").agg(F.min(F.struct("class", "provenance")).alias("r")).select("file_id", "r.*")


def blocklist_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name) of pipe rows: column 2, and the `;`-separated names of column 4 unless unknown."""
    c = F.split(column, r"\|", -1)
    second, fourth = F.get(c, F.lit(1)), F.get(c, F.lit(3))
    some = F.when(F.lower(F.trim(fourth)) == "unknown", F.array().cast("array<string>")).otherwise(F.split(F.coalesce(fourth, F.lit("")), ";"))
    names = lines.filter(~F.ltrim(F.col(column)).startswith("#")).select(F.explode(F.concat(F.array(second), some)).alias("n"))
    return names.select(F.lower(F.trim("n")).alias("name")).filter("name <> ''").distinct()


def blocklist_rows(episodes: DataFrame) -> DataFrame:
    """(show, episodes, channels): sorted distinct named channels joined by ' ; ', or unknown."""
    named = F.when(~F.lower(F.trim("channel")).isin("", "unknown", "na"), F.trim("channel"))
    names = F.concat_ws(" ; ", F.sort_array(F.collect_set(named)))
    return episodes.groupBy("show").agg(F.count("*").alias("episodes"), names.alias("_c")).select("show", "episodes", F.when(F.col("_c") == "", "unknown").otherwise(F.col("_c")).alias("channels"))


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(form).save(f"{path}/{name}")


def rejects(df: DataFrame) -> DataFrame:
    return df.filter("is_excluded")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in new, then new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: count and order-insensitive hash of all columns (by name, as text): the sum of 60 bits of each row's MD5."""
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    bits = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(bits), F.lit(0)).alias("hash"))


def write_release(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)
