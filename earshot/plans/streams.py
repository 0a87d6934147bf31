"""Queries of the R operators. Streams read the events table's rows as files and run to the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from earshot.plans.registry import query
from earshot.plans.sources import place
from earshot.session import table
from earshot.streaming import incremental as R

c = F.col


def stream(spark, df, name, parts=2):
    """df as a file stream."""
    path = place(spark, name)
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(spark, df, name, mode="append"):
    """Run a stream to the end of its input into files (append) or the last state of a table (complete), and read them."""
    path = place(spark, name)
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{path}/out")
    view = f"s{uuid.uuid4().hex[:12]}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out{number % 2}")
        spark.range(1).select(F.lit(number % 2).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/last")

    q = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/log-{view}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out{spark.read.parquet(f'{path}/last').first()[0]}")


@query("r01_work_plan", "SELECT 'plan' AS kind, event_id AS id FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT 'reset', event_id FROM events UNION ALL SELECT 'ledger', event_id FROM events")
def r01(spark, sf):
    e = table(spark, sf, "events").select(c("event_id").alias("id"))
    ledger = e.filter("id % 3 = 0").withColumn("signature", F.lit("a"))
    plan = R.work_plan(e, ledger, "a")
    return plan.select(F.lit("plan").alias("kind"), "id").unionByName(R.work_plan(e, ledger, "b").select(F.lit("reset").alias("kind"), "id")).unionByName(R.new_ledger(plan, ledger, "a").select(F.lit("ledger").alias("kind"), "id"))


@query("r02_rebuild_status", """SELECT user_id AS resource, CASE WHEN user_id % 11 = 0 THEN 'forced' WHEN user_id % 5 = 0 THEN 'new' WHEN user_id % 5 = 1 THEN 'reset' WHEN user_id % 5 = 2 THEN 'stale' WHEN user_id % 5 = 3 THEN 'missing_output' ELSE 'unchanged' END AS status FROM events GROUP BY user_id""")
def r02(spark, sf):
    n = table(spark, sf, "events").groupBy(c("user_id").alias("resource")).agg(F.count("*").alias("n_items")).withColumn("has_output", c("resource") % 5 != 3)
    ledger = n.filter("resource % 5 <> 0").select("resource", F.when(c("resource") % 5 == 1, "old").otherwise("now").alias("signature"), F.when(c("resource") % 5 == 2, c("n_items") - 1).otherwise(c("n_items")).alias("n_items"))
    return R.rebuild_status(n, ledger, "now", c("resource") % 11 == 0).select("resource", "status")


@query("r03_decision_stream", "SELECT user_id AS item_id, event_type AS annotator, 1 AS n FROM events GROUP BY ALL")
def r03(spark, sf):
    e = table(spark, sf, "events").select(c("ts").cast("timestamp").alias("ts"), c("user_id").alias("item_id"), c("event_type").alias("annotator"), "event_id")
    out = finished(spark, R.distinct_decisions(stream(spark, e, "decisions"), "40 days"), "accepted")
    return out.groupBy("item_id", "annotator").agg(F.count("*").alias("n"))


@query("r04_hourly_progress", "WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1) SELECT strftime(hour, '%Y-%m-%d %H') AS hour, n, (sum(n) OVER (ORDER BY hour))::BIGINT AS total FROM h")
def r04(spark, sf):
    from pyspark.sql import Window

    s = R.hourly_counts(stream(spark, table(spark, sf, "events").select(c("ts").cast("timestamp").alias("ts")), "progress"), "40 days")
    out = finished(spark, s, "hours", "complete")
    return out.withColumn("total", F.sum("n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("r05_stage_stream", "SELECT user_id AS key, max_by(event_type, event_id) AS stage FROM events GROUP BY user_id")
def r05(spark, sf):
    e = table(spark, sf, "events").select(c("user_id").alias("key"), c("event_id").alias("order"), c("event_type").alias("stage"))
    path = place(spark, "stages")
    q = stream(spark, e, "stages-in").writeStream.foreachBatch(R.merge_into(path, "key")).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return R.merged_state(spark, path, "key")


@query("r06_new_recordings", "SELECT DISTINCT user_id AS id, user_id * 7 AS hash FROM events")
def r06(spark, sf):
    e = table(spark, sf, "events").select(c("ts").cast("timestamp").alias("ts"), c("user_id").alias("id"), (c("user_id") * 7).alias("hash"))
    return finished(spark, R.new_recordings(stream(spark, e, "recordings"), "40 days"), "new").select("id", "hash")


@query("r07_speech_runs", """WITH t AS (SELECT event_type AS file_id, user_id % 5 AS speaker_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + floor(value)::BIGINT AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY file_id, speaker_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t), r AS (SELECT *, sum(CASE WHEN p IS NULL OR a - p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, speaker_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT file_id, speaker_id, min(a)::BIGINT AS start, max(b)::BIGINT AS "end", count(*) AS turns FROM r GROUP BY file_id, speaker_id, run""")
def r07(spark, sf):
    e = table(spark, sf, "events").select(F.timestamp_seconds(F.unix_timestamp("ts")).alias("ts"), F.floor("value").cast("double").alias("seconds"), c("event_type").alias("file_id"), (c("user_id") % 5).alias("speaker_id"))
    path = place(spark, "runs")
    q = R.speech_runs(stream(spark, e, "turns"), delay="40 days").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    waiting = R.open_runs(spark, f"{path}/log")
    out = spark.read.schema(waiting.schema).parquet(f"{path}/out").unionByName(waiting)
    return out.select("file_id", "speaker_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "turns")


@query("r08_unscored", "SELECT DISTINCT o_orderstatus AS region, o_orderpriority AS playlist FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def r08(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderstatus").alias("region"), c("o_orderpriority").alias("playlist")).distinct()
    return R.unscored(o, o.filter("region = 'F' AND playlist = '1-URGENT'"))


@query("r09_input_status", "SELECT o_custkey AS resource, CASE WHEN o_custkey % 2 = 0 AND o_custkey % 3 <> 0 THEN 'ready' ELSE 'missing_inputs' END AS status FROM orders GROUP BY o_custkey")
def r09(spark, sf):
    o = table(spark, sf, "orders").select(c("o_custkey").alias("resource"))
    return R.input_status(o.distinct(), o.filter("resource % 2 = 0"), o.filter("resource % 3 <> 0"))


@query("r10_stage_upsert", "SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey = 7 THEN 'clustered' ELSE o_orderstatus END AS stage, o_orderpriority AS note FROM orders")
def r10(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderkey").cast("string").alias("key"), c("o_orderstatus").alias("stage"), c("o_orderpriority").alias("note"))
    return R.stage_upsert(o, "7", {"stage": "clustered"})
