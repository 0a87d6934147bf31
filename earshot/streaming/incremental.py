"""Incremental batch state and Structured Streaming forms of it."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from earshot import config as C
from earshot.operators.joins import overlay
from earshot.session import delete, exists


def work_plan(items: DataFrame, ledger: DataFrame, signature: str, key: str = "id") -> DataFrame:
    """Items to process: all of them when the ledger's signature differs, else the unseen ones. ledger: (key, signature)."""
    same = ledger.filter(F.col("signature") == signature).select(key).distinct()
    return items.join(same, key, "left_anti")


def new_ledger(items: DataFrame, ledger: DataFrame, signature: str, key: str = "id") -> DataFrame:
    """The ledger after processing: keys of this signature, old and new."""
    old = ledger.filter(F.col("signature") == signature).select(key)
    return old.unionByName(items.select(key)).distinct().withColumn("signature", F.lit(signature))


def rebuild_status(resources: DataFrame, ledger: DataFrame, signature: str, force: Column | None = None) -> DataFrame:
    """resources (resource, n_items, has_output) with status: forced, new, reset, stale, missing_output or unchanged. ledger: (resource, signature, n_items)."""
    old = ledger.select("resource", F.col("signature").alias("_s"), F.col("n_items").alias("_n"))
    forced = F.lit(False) if force is None else force
    status = F.when(forced, "forced").when(F.col("_s").isNull(), "new").when(F.col("_s") != signature, "reset").when(F.col("n_items") > F.col("_n"), "stale").when(~F.coalesce("has_output", F.lit(False)), "missing_output").otherwise("unchanged")
    return resources.join(old, "resource", "left").withColumn("status", status).drop("_s", "_n")


def unscored(resources: DataFrame, scored: DataFrame, keys: tuple[str, ...] = ("region", "playlist")) -> DataFrame:
    return resources.join(scored.select(*keys).distinct(), list(keys), "left_anti")


def input_status(resources: DataFrame, segments: DataFrame, vectors: DataFrame, key: str = "resource") -> DataFrame:
    """(key, status): ready, empty or missing_inputs for re-deriving clusters from stored segments and vectors."""
    s = segments.groupBy(key).agg(F.count("*").alias("_s"))
    v = vectors.groupBy(key).agg(F.count("*").alias("_v"))
    status = F.when(F.col("_s").isNull() | F.col("_v").isNull(), "missing_inputs").when(F.col("_s") == 0, "empty").otherwise("ready")
    return resources.select(key).join(s, key, "left").join(v, key, "left").select(key, status.alias("status"))


def stage_upsert(state: DataFrame, key: str, values: dict[str, str], key_column: str = "key") -> DataFrame:
    """State with one key's non-empty values written over it."""
    columns = [c for c in state.columns if c != key_column]
    one = state.sparkSession.range(1).select(F.lit(key).alias(key_column), *[F.lit(values.get(c, "")).alias(c) for c in columns])
    return overlay(state, one, key_column)


# --- streams -----------------------------------------------------------------------------------------------


def distinct_decisions(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """One decision for each (annotator, item): the first to arrive."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["annotator", "item_id"])


def hourly_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(hour, n) per tumbling hour; rows later than the delay are left out."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


def new_recordings(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Arriving recordings with unseen id and then unseen content hash."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"]).dropDuplicatesWithinWatermark(["hash"])


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "start long, end long, turns long"


class RunMerger(StatefulProcessor):
    """Open runs of one (file, speaker) in list state; a run leaves when the watermark has passed its end and the gap."""

    def __init__(self, gap: float):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", RUNS)

    def _open(self) -> list[tuple[int, int, int]]:
        return [tuple(r) for r in self.runs.get()] if self.runs.exists() else []

    def _merged(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for start, end, turns in sorted(runs):
            if out and round((start - out[-1][1]) / 1e6, 9) <= self.gap:
                first, last, n = out[-1]
                out[-1] = (first, max(last, end), n + turns)
            else:
                out.append((start, end, turns))
        return out

    def handleInputRows(self, key, rows, timerValues):
        runs = self._open()
        while some := [(r["start"], r["end"], 1) for r in itertools.islice(rows, 10_000)]:
            runs = self._merged(runs + some)
        self.runs.put(runs)
        for _, end, _ in runs:
            self.handle.registerTimer(math.floor(end / 1e3 + self.gap * 1e3) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        done = lambda r: math.floor(r[1] / 1e3 + self.gap * 1e3) + 1 <= now
        runs = self._open()
        if left := [r for r in runs if not done(r)]:
            self.runs.put(left)
        else:
            self.runs.clear()
        for start, end, turns in filter(done, runs):
            yield Row(file_id=key[0], speaker_id=key[1], start=start, end=end, turns=turns)

    def close(self) -> None:
        pass


def _as_runs(df: DataFrame) -> DataFrame:
    return df.select("file_id", "speaker_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "turns")


def speech_runs(stream: DataFrame, gap: float = C.GAP_TOLERANCE, delay: str = "1 hour") -> DataFrame:
    """(file_id, speaker_id, start, end, turns): turns (ts, seconds, file_id, speaker_id) merged to runs by the rule of merge_turns(), in append mode.

    Turns may come in any order within the delay and lie inside others; Spark drops those that come later. A run is put out once no
    turn that is still awaited can reach it; those that wait at the end are open_runs(). State is kept in RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    start = F.unix_micros("ts")
    rows = stream.withWatermark("ts", delay).select("file_id", "speaker_id", "ts", start.alias("start"), (start + F.round(F.col("seconds") * 1_000_000).cast("long")).alias("end"))
    kinds = dict(stream.dtypes)
    out = rows.groupBy("file_id", "speaker_id").transformWithState(RunMerger(gap), f"file_id {kinds['file_id']}, speaker_id {kinds['speaker_id']}, {RUNS}", "Append", "EventTime")
    return _as_runs(out)


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The runs that speech_runs() still holds, from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "runs").load(checkpoint)
    return _as_runs(state.select("key.file_id", "key.speaker_id", "list_element.*"))


def _manifests(spark: SparkSession, path: str) -> dict[int, dict]:
    """By version: which batch wrote each bucket, and the number of buckets. There are two versions at most, each a row for each bucket."""
    out: dict[int, dict] = {}
    if exists(spark, f"{path}/manifests"):
        for r in spark.read.schema("bucket int, batch long, buckets int, n long").parquet(f"{path}/manifests").collect():
            m = out.setdefault(r.n, {"at": {}, "buckets": r.buckets})
            if r.bucket >= 0:
                m["at"][r.bucket] = r.batch
    return out


def _bucket_paths(path: str, at: dict[int, int]) -> list[str]:
    return [f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(at.items())]


def merge_into(path: str, key: str, buckets: int = 64):
    """foreachBatch function that merges each batch (key, order, values) into a stored state, which merged_state() reads.

    A value that is not blank counts until one with a larger order comes, in whatever batch: late rows do not undo newer ones. Keys are hashed to
    buckets; a batch reads and writes only those it touches, so its cost follows the batch and not the state. The version (a small
    manifest of buckets) moves after they are written, and a batch that comes again after that changes nothing. Buckets that neither the
    newest nor the version before it uses are deleted. The number of buckets cannot change later.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, values = batch.sparkSession, [c for c in batch.columns if c not in (key, "order")]
        versions = _manifests(spark, path)
        last = max(versions, default=-1)
        if number <= last:
            return
        now = versions.get(last, {"at": {}, "buckets": buckets})
        if now["buckets"] != buckets:
            raise ValueError(f"the state has {now['buckets']} buckets")
        rows = batch.select(key, *[F.when(F.trim(F.col(c).cast("string")) != "", F.struct("order", F.col(c).alias("value"))).alias(c) for c in values])
        kinds = rows.schema
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        before = {b: now["at"][b] for b in touched if b in now["at"]}
        if before:
            old = spark.read.schema(kinds).parquet(*_bucket_paths(path, before))
            rows = rows.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        merged = rows.groupBy(key, "bucket").agg(*[F.max(c).alias(c) for c in values])
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
        at = now["at"] | dict.fromkeys(touched, number)
        manifest = spark.createDataFrame([(b, n, buckets) for b, n in sorted(at.items())] or [(-1, -1, buckets)], "bucket int, batch long, buckets int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/n={number}")
        used = {*_bucket_paths(path, at), *_bucket_paths(path, now["at"])}
        for n, m in versions.items():
            if n < last:
                for p in {*_bucket_paths(path, m["at"])} - used:
                    delete(spark, p)
                delete(spark, f"{path}/manifests/n={n}")

    return write


def merged_state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, values) of the newest version that merge_into() wrote; the batch and bucket folders are not columns."""
    versions = _manifests(spark, path)
    paths = _bucket_paths(path, versions[max(versions)]["at"]) if versions else []
    if not paths:
        raise ValueError(f"no state in {path}")
    rows = spark.read.parquet(*paths)
    return rows.select(key, *[F.col(f"{c}.value").alias(c) for c in rows.columns if c != key])
