"""The stream of merged turns beside the batch rule: nested and shuffled turns, a restart in between."""

import random

from pyspark.sql import functions as F

from earshot.operators import intervals
from earshot.streaming import incremental


def test_runs_equal_the_batch_rule(spark, tmp_path):
    r = random.Random(4)
    turns = []
    for f in ("a", "b"):
        at = 0.0
        for _ in range(120):
            at = round(at + r.choice([0.0, 0.1, 0.5, 0.6, 3.0, 40.0]), 1)
            turns.append((f, "s", at, r.choice([0.1, 0.2, 5.0])))
            turns.append((f, "s", round(at + 0.1, 1), 0.1))  # inside or just after it
    turns = sorted(turns, key=lambda t: t[2] + r.uniform(0, 50))  # late by less than the delay
    df = spark.createDataFrame(turns, "file_id string, speaker_id string, at double, seconds double")
    df = df.withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long") + 1_700_000_000_000_000))
    rows = df.collect()
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for part in (0, 1):  # the second run starts from the first one's checkpoint
        half = rows[part * len(rows) // 2 : (part + 1) * len(rows) // 2]
        spark.createDataFrame(half, df.schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = incremental.speech_runs(stream, 0.5, "60 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    done, waiting = spark.read.parquet(out), incremental.open_runs(spark, log)
    got = done.unionByName(waiting).select("file_id", F.unix_micros("start"), F.unix_micros("end"), "turns").collect()
    batch = intervals.merge_turns(df.select("file_id", "speaker_id", F.col("at").alias("start"), F.round(F.col("at") + F.col("seconds"), 6).alias("end")), 0.5)
    want = {(x.file_id, round(x.start * 1e6), round(x.end * 1e6)) for x in batch.collect()}
    assert {(x[0], x[1] - 1_700_000_000_000_000, x[2] - 1_700_000_000_000_000) for x in got} == want
    assert len(got) == len(want) and sum(x.turns for x in got) == len(turns)
    assert done.count() > 10 and waiting.count() > 0
