"""Queries of the I operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import intervals as I
from earshot.plans.registry import query, segments, views
from earshot.session import table

#: Turns from events: four files by event type, seconds from the first day, lengths from values.
TURNS = """turns AS (SELECT event_type AS file_id, user_id % 5 AS speaker_id, t AS start, t + round(value / 10, 1) AS "end"
FROM (SELECT *, (epoch_s % 20000) * 1e0 AS t FROM e))"""
DUCK = "e AS (SELECT *, floor(epoch(ts))::BIGINT AS epoch_s FROM events), " + TURNS


def turns(spark, sf):
    e = table(spark, sf, "events")
    t = (F.unix_timestamp("ts") % 20000).cast("double")
    return e.select(F.col("event_type").alias("file_id"), (F.col("user_id") % 5).alias("speaker_id"), t.alias("start"), (t + F.round(F.col("value") / 10, 1)).alias("end"))


MERGE = """b AS (SELECT *, max("end") OVER (PARTITION BY file_id, speaker_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {src}),
r AS (SELECT *, sum(CASE WHEN m IS NULL OR round(start - m, 9) > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, speaker_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM b),
{out} AS (SELECT file_id, speaker_id, min(start) AS start, max("end") AS "end" FROM r GROUP BY file_id, speaker_id, run)"""
ATOMS = """p AS (SELECT DISTINCT file_id, start AS t FROM turns WHERE "end" > start UNION SELECT DISTINCT file_id, "end" FROM turns WHERE "end" > start),
a AS (SELECT file_id, t AS start, lead(t) OVER (PARTITION BY file_id ORDER BY t) AS "end" FROM p),
x AS (SELECT a.file_id, a.start, a."end", min(speaker_id) AS speaker_id FROM a JOIN turns t ON t.file_id = a.file_id AND t.start < a."end" AND t."end" > a.start AND t."end" > t.start WHERE a."end" IS NOT NULL GROUP BY ALL HAVING count(DISTINCT speaker_id) = 1)"""
ROUNDED = 'SELECT file_id, speaker_id, round(start, 4) AS start, round("end", 4) AS "end" FROM '


def shown(df):
    return df.select("file_id", "speaker_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("i01_exclusive_turns", f"WITH {DUCK}, {ATOMS}, {MERGE.format(src='x', gap='1e-6', out='o')} {ROUNDED} o")
def i01(spark, sf):
    return shown(I.exclusive_turns(turns(spark, sf)))


@query("i02_merge_turns", f"WITH {DUCK}, {MERGE.format(src='turns', gap='0.5', out='o')} {ROUNDED} o")
def i02(spark, sf):
    return shown(I.merge_turns(turns(spark, sf)))


LONG = 'long AS (SELECT file_id, speaker_id, start, start + ("end" - start) * 6 AS "end" FROM turns)'
SPLIT = """s AS (SELECT *, greatest(ceil(round("end" - start, 9) / 10) - 1, 0)::INT AS n FROM {src}), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM s),
c AS (SELECT file_id, speaker_id, start + k * 10.0::DOUBLE AS start, CASE WHEN k < n THEN start + k * 10.0::DOUBLE + 10 ELSE "end" END AS "end" FROM k), o AS (SELECT * FROM c WHERE round("end" - start, 9) >= 3)"""


@query("i03_split_fixed", f"WITH {DUCK}, {LONG}, {SPLIT.format(src='long')} {ROUNDED} o")
def i03(spark, sf):
    t = turns(spark, sf).withColumn("end", F.col("start") + (F.col("end") - F.col("start")) * 6)
    return shown(I.split_fixed(t))


@query("i04_split_quietest")
def i04(spark, sf):
    t = turns(spark, sf).withColumn("end", F.col("start") + (F.col("end") - F.col("start")) * 6)
    e = table(spark, sf, "events").select(F.col("event_type").alias("file_id"), (F.unix_timestamp("ts") % 20000).cast("double").alias("t"), F.col("value").alias("energy"))
    return shown(I.split_quietest(t, e))


@query("i05_segment_rows", f"""WITH {DUCK} SELECT file_id, speaker_id, round(start, 3) AS start_time, round("end", 3) AS end_time, round("end" - start, 3) AS duration, 'Target' AS macro_class FROM turns""")
def i05(spark, sf):
    return I.segment_rows(turns(spark, sf), macro_class="Target")


@query("i06_segment_files", f"""WITH {DUCK}, {ATOMS}, {MERGE.format(src='x', gap='1e-6', out='m1')}, {MERGE.format(src='m1', gap='0.5', out='m2').replace('b AS', 'b2 AS').replace('FROM b)', 'FROM b2)').replace('r AS', 'r2 AS').replace('FROM r ', 'FROM r2 ')}, {SPLIT.format(src='m2')}
SELECT file_id, speaker_id, round(start, 3) AS start_time, round("end", 3) AS end_time, round("end" - start, 3) AS duration FROM o""")
def i06(spark, sf):
    return I.segment_files(turns(spark, sf))


@query("i07_speech_ratio", """WITH {seg}, g AS (SELECT DISTINCT file_id, seg_no, start_time, end_time FROM seg WHERE duration > 1), sp AS (SELECT DISTINCT file_id, seg_no * 20e0 + 1 AS start, seg_no * 20e0 + 4 AS "end" FROM seg),
u AS (SELECT file_id, seg_no, start_time, end_time FROM g QUALIFY row_number() OVER (PARTITION BY file_id, seg_no ORDER BY end_time DESC) = 1)
SELECT u.file_id, u.seg_no, round(coalesce(sum(least(u.end_time, sp."end") - greatest(u.start_time, sp.start)), 0) / (max(u.end_time) - max(u.start_time)), 6) AS speech_ratio
FROM u LEFT JOIN sp ON u.file_id = sp.file_id AND sp.start < u.end_time AND sp."end" > u.start_time GROUP BY u.file_id, u.seg_no""")
def i07(spark, sf):
    from earshot.operators.summary import keep_first

    seg = segments(spark, sf)
    g = keep_first(seg.filter("duration > 1").select("file_id", "seg_no", "start_time", "end_time"), ["file_id", "seg_no"], [F.desc("end_time")])
    spans = seg.select("file_id", (F.col("seg_no") * 20.0 + 1).alias("start"), (F.col("seg_no") * 20.0 + 4).alias("end")).distinct()
    return I.speech_ratio(g, spans, ["file_id", "seg_no"]).withColumn("speech_ratio", F.round("speech_ratio", 6))


@query("i08_snr_proxy", """SELECT user_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(20 * log10(greatest(value, 1e-10)), 0.9) - quantile_cont(20 * log10(greatest(value, 1e-10)), 0.1) END, 6) AS snr_db FROM events GROUP BY user_id""")
def i08(spark, sf):
    return I.snr_proxy(table(spark, sf, "events"), ["user_id"], "value").withColumn("snr_db", F.round("snr_db", 6))


@query("i09_guarded", "WITH {seg} SELECT file_id, seg_no, CASE WHEN duration < 0.5 THEN 0 ELSE music_prob END AS music FROM seg")
def i09(spark, sf):
    return segments(spark, sf).select("file_id", "seg_no", I.guarded(F.col("music_prob"), F.col("duration"), 0.5).alias("music"))
