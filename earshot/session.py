"""Session helpers shared by all subpackages."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def let_workers_import(spark: SparkSession) -> None:
    """Add this checkout to the Python workers' path (a cluster ships it with --py-files instead)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


#: Bytes of rows that go to a Python worker at once.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def bound_batches(spark: SparkSession) -> None:
    """Bound what Python workers are given at once by bytes too, as rows may hold long texts; settings of the application stay."""
    own = spark.sparkContext.getConf()
    for key, value in BATCH.items():
        if not own.contains(key):
            spark.conf.set(key, value)


#: Bytes of input (Parquet) for each shuffle partition. AQE joins partitions that turn out small.
BYTES_A_PARTITION = 8 << 20
JOINED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def scale_shuffles(spark: SparkSession, sf_dir: str) -> None:
    """Let the number of shuffle partitions grow with the tables in sf_dir, so that a task's sorts and hash tables do not; a setting of the application stays."""
    if not spark.sparkContext.getConf().contains(INITIAL):
        files, at = _file_system(spark, sf_dir)
        size = files.getContentSummary(at).getLength() if files.exists(at) else 0
        spark.conf.set(INITIAL, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BYTES_A_PARTITION)))
    if not spark.sparkContext.getConf().contains(JOINED):
        spark.conf.set(JOINED, "32m")


def usual_shuffles(spark: SparkSession) -> None:
    """Take back what scale_shuffles set for an earlier query of the session."""
    for key in (INITIAL, JOINED):
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.unset(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset one in the warehouse, or in a
    temporary folder if all tasks run in the driver's own process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        alone = sc.master == "local" or sc.master.startswith("local[")
        folder = tempfile.mkdtemp(prefix="spark-earshot-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/earshot-{uuid.uuid4().hex[:12]}"
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def in_tasks(rows: DataFrame, each: int, *by: str) -> DataFrame:
    """rows dealt over tasks of about `each` rows: what a row costs is not its bytes, by which Spark would cut or join tasks."""
    return rows.repartition(rows.count() // each + 1, *by)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.stored_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
