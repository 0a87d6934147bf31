"""Queries of the W and D operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import summary as S
from earshot.plans.aggregates import HARVEST, harvest, rounded
from earshot.plans.registry import query, segments
from earshot.session import table

KEY = ("file_id", "seg_no")


@query("w01_terciles", """WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, CASE WHEN r <= floor((n + 1) / 3) THEN 'low' WHEN r <= floor(2 * n / 3) THEN 'mid' ELSE 'high' END AS tercile FROM c""")
def w01(spark, sf):
    return S.terciles(table(spark, sf, "customer"), "c_nationkey", ["c_acctbal", "c_custkey"]).select("c_custkey", "tercile")


@query("w02_quantile_bands", """WITH {seg}, q AS (SELECT region, round(quantile_cont(duration, 1/3), 9) AS a, round(quantile_cont(duration, 2/3), 9) AS b FROM seg GROUP BY region)
SELECT file_id, seg_no, CASE WHEN round(duration, 9) <= a THEN 'short' WHEN round(duration, 9) <= b THEN 'medium' ELSE 'long' END AS band FROM seg JOIN q USING (region)""")
def w02(spark, sf):
    return S.quantile_bands(segments(spark, sf), "region", "duration").select(*KEY, "band")


@query("w03_timeline_spread", """WITH {seg}, r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY file_id, seg_no, snr_db, duration) - 1 AS i, count(*) OVER (PARTITION BY speaker) AS n FROM seg),
s AS (SELECT *, CASE WHEN n <= 5 THEN i ELSE CASE WHEN i >= floor(4 * n / 5) THEN 4 WHEN i >= floor(3 * n / 5) THEN 3 WHEN i >= floor(2 * n / 5) THEN 2 WHEN i >= floor(n / 5) THEN 1 ELSE 0 END END AS slice FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY speaker, slice ORDER BY (snr_db >= 15)::INT DESC, duration DESC, file_id, seg_no, snr_db) AS k FROM s) SELECT speaker, slice::INT AS slice, file_id, seg_no FROM b WHERE k = 1""")
def w03(spark, sf):
    best = [F.desc((F.col("snr_db") >= 15).cast("int")), F.desc("duration")]
    return S.timeline_spread(segments(spark, sf), "speaker", 5, ["file_id", "seg_no", "snr_db", "duration"], best).select("speaker", "slice", *KEY)


@query("w04_diverse_top", """WITH {seg}, f AS (SELECT *, (row_number() OVER (PARTITION BY speaker, file_id ORDER BY snr_db >= 15 DESC, duration DESC, seg_no) > 1)::INT AS again FROM seg),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY again, snr_db >= 15 DESC, duration DESC, file_id, seg_no) AS rank FROM f) SELECT speaker, file_id, seg_no, rank::INT AS rank FROM r WHERE rank <= 6""")
def w04(spark, sf):
    return S.diverse_top(segments(spark, sf), "speaker", "file_id", 6, [F.desc(F.col("snr_db") >= 15), F.desc("duration"), F.col("file_id"), F.col("seg_no")]).select("speaker", *KEY, "rank")


@query("w05_longest", """WITH {seg}, r AS (SELECT *, row_number() OVER (PARTITION BY playlist, global_actor ORDER BY duration DESC, file_id, seg_no) AS rank FROM seg WHERE global_actor >= 0) SELECT playlist, global_actor, file_id, seg_no, rank::INT AS rank FROM r WHERE rank <= 3""")
def w05(spark, sf):
    return S.top_rows(segments(spark, sf).filter("global_actor >= 0"), ["playlist", "global_actor"], [F.desc("duration"), F.col("file_id"), F.col("seg_no")], 3).select("playlist", "global_actor", *KEY, "rank")


@query("w06_ranked_sizes", """WITH {seg}, n AS (SELECT playlist, global_actor, count(*) AS n FROM seg GROUP BY ALL), m AS (SELECT playlist, global_actor, tier, row_number() OVER (PARTITION BY playlist, global_actor ORDER BY count(*) DESC, tier) AS k FROM seg GROUP BY playlist, global_actor, tier)
SELECT playlist, global_actor, n, tier, row_number() OVER (PARTITION BY playlist ORDER BY n DESC, global_actor)::INT AS rank FROM n JOIN m USING (playlist, global_actor) WHERE k = 1""")
def w06(spark, sf):
    return S.ranked_sizes(segments(spark, sf), "playlist", "global_actor", "tier")


@query("w07_cumulative", "WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1) SELECT strftime(hour, '%Y-%m-%d %H') AS hour, n, (sum(n) OVER (ORDER BY hour))::BIGINT AS total FROM h")
def w07(spark, sf):
    return S.cumulative_by_hour(table(spark, sf, "events"), "ts").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("w08_lorenz", """WITH {seg}, h AS (SELECT region, speaker, sum(duration) AS h FROM seg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY h) AS i, row_number() OVER (PARTITION BY region ORDER BY h DESC) AS d FROM h)
SELECT region, count(*) AS n, round(2 * sum(i * h) / (count(*) * sum(h)) - (count(*) + 1) / count(*), 6) AS gini, round(sum(CASE WHEN d <= 10 THEN h END) / sum(h), 6) AS top_share FROM r GROUP BY region""")
def w08(spark, sf):
    h = segments(spark, sf).groupBy("region", "speaker").agg(F.sum("duration").alias("h"))
    return rounded(S.lorenz(h, "region", "h"), "gini", "top_share")


@query("w09_rank_auc", """WITH {seg}, r AS (SELECT region, is_excluded, rank() OVER (PARTITION BY region ORDER BY snr_db) AS lo, count(*) OVER (PARTITION BY region, snr_db) AS m FROM seg)
SELECT region, round((sum(CASE WHEN is_excluded THEN lo + (m - 1) / 2 END) - count(*) FILTER (WHERE is_excluded) * (count(*) FILTER (WHERE is_excluded) + 1) / 2) / (count(*) FILTER (WHERE is_excluded) * count(*) FILTER (WHERE NOT is_excluded)), 6) AS auc FROM r GROUP BY region""")
def w09(spark, sf):
    return rounded(S.rank_auc(segments(spark, sf), "snr_db", F.col("is_excluded"), ["region"]), "auc")


@query("w10_keep_first", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def w10(spark, sf):
    return S.keep_first(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")])


@query("w11_disambiguate", "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size DESC, p_name || p_partkey) > 1 THEN p_type || '__' || p_name || p_partkey ELSE p_type END AS unique_name FROM part")
def w11(spark, sf):
    return S.disambiguate(table(spark, sf, "part").withColumn("base", F.concat("p_name", F.col("p_partkey").cast("string"))), ["p_brand"], "p_type", "p_size", "base").select("p_partkey", "unique_name")


@query("w13_review_queue", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS place FROM customer WHERE c_acctbal >= 5000 AND c_nationkey < 12")
def w13(spark, sf):
    from earshot.operators.splits import numbered

    c = table(spark, sf, "customer").filter("c_acctbal >= 5000 AND c_nationkey < 12")
    ranked = c.groupBy("c_custkey").agg(F.max("c_acctbal").alias("risk"))
    return numbered(ranked, "place", F.desc("risk"), F.col("c_custkey")).select("c_custkey", F.col("place").cast("int").alias("place"))


@query("w14_pair_queue", """WITH p AS (SELECT vec_id AS a, vec_id + 1 AS b, label / 10 AS sim, label % 2 = 0 AS "cross" FROM embeddings)
SELECT a, b, sim, "cross" FROM p WHERE "cross" AND a % 7 <> 0 AND b % 7 <> 0 AND a % 5 <> 0""")
def w14(spark, sf):
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("label") / 10).alias("sim"), (F.col("label") % 2 == 0).alias("cross"))
    dust = p.filter("a % 7 = 0").select(F.col("a").alias("actor")).unionByName(p.filter("b % 7 = 0").select(F.col("b").alias("actor")))
    return S.pair_queue([p.filter("a % 2 = 0"), p.filter("a % 2 = 1")], dust, p.filter("a % 5 = 0"), cross=True)


@query("w15_hit_filter", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE n >= 3 ORDER BY n DESC, user_id LIMIT 20")
def w15(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "user_id").limit(20)


@query("w16_latest", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def w16(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


@query("w17_class_order", """WITH {seg}, s AS (SELECT playlist, round(sum(duration) / 3600, 9) AS h, count(DISTINCT speaker % 60) AS channels FROM seg GROUP BY playlist)
SELECT playlist, row_number() OVER (ORDER BY playlist IN ('NATION_1', 'NATION_2', 'NATION_3'), h, playlist)::INT AS place, channels <= 50 AS thin FROM s""")
def w17(spark, sf):
    s = S.class_summary(segments(spark, sf).withColumn("c", F.col("speaker") % 60), ["playlist"], {"channels": "c"})
    return S.class_order(s, "playlist", ["NATION_1", "NATION_2", "NATION_3"], 50).select("playlist", "place", "thin")


@query("d01_union", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind, NULL::INT AS s_nationkey FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def d01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    return S.union_all(c, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey"))


@query("d02_dedup_first", """WITH u AS (SELECT o_custkey % 500 AS channel_id, 0 AS part, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey % 700, 1, o_orderkey FROM orders WHERE o_orderkey % 2 = 1)
SELECT channel_id, part, k FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY part, k) AS r FROM u) WHERE r = 1""")
def d02(spark, sf):
    o = table(spark, sf, "orders")
    old = o.filter("o_orderkey % 2 = 0").select((F.col("o_custkey") % 500).alias("channel_id"), F.lit(0).alias("part"), F.col("o_orderkey").alias("k"))
    new = o.filter("o_orderkey % 2 = 1").select((F.col("o_custkey") % 700).alias("channel_id"), F.lit(1).alias("part"), F.col("o_orderkey").alias("k"))
    return S.keep_first(old.unionByName(new), ["channel_id"], ["part", "k"])


@query("d03_leakage", """WITH {seg}, t AS (SELECT DISTINCT playlist, global_actor FROM seg WHERE split = 'test' AND region = 'ASIA'), r AS (SELECT DISTINCT playlist, global_actor FROM seg WHERE split = 'train' AND region = 'ASIA' AND seg_no > 5)
SELECT count(*) AS test, count(r.playlist) AS leaked, round(count(r.playlist) / count(*), 6) AS share, count(r.playlist) / count(*) > 0.05 AS over FROM t LEFT JOIN r USING (playlist, global_actor)""")
def d03(spark, sf):
    seg = segments(spark, sf).filter("region = 'ASIA' AND (split <> 'train' OR seg_no > 5)").withColumn("k", F.concat_ws("#", "playlist", "global_actor"))
    return rounded(S.leakage(seg, "k"), "share")


@query("d04_overlaps", "WITH {seg} SELECT global_actor, count(DISTINCT split) AS splits FROM seg GROUP BY global_actor HAVING count(DISTINCT split) > 1")
def d04(spark, sf):
    return S.overlaps(segments(spark, sf), "global_actor")


@query("d05_harvest_dedup", f"""WITH {HARVEST} SELECT "order", status FROM h""")
def d05(spark, sf):
    return harvest(spark, sf).select("order", "status")


@query("d06_purge", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND NOT starts_with(source, 'src1') AND lang <> 'de'")
def d06(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("lang").alias("show"))
    return S.purge(d, d.filter("id % 3 = 0"), "src1", "de").select("doc_id")


@query("d07_tranches", "SELECT item_id, 'primary' AS tranche FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'extension' FROM benchmark WHERE item_id % 2 = 1")
def d07(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id")
    return S.tranches(primary=b.filter("item_id % 2 = 0"), extension=b.filter("item_id % 2 = 1"))


@query("d08_channel_overlap", """WITH {seg}, t AS (SELECT DISTINCT file_id % 97 AS c FROM seg WHERE split = 'train' AND region = 'ASIA' AND seg_no = 7), x AS (SELECT speaker, (file_id % 97) IN (SELECT c FROM t) AS hit FROM seg WHERE split = 'test')
SELECT round(avg(hit::INT), 6) AS segment_share, round(count(DISTINCT CASE WHEN hit THEN speaker END) / count(DISTINCT speaker), 6) AS speaker_share FROM x""")
def d08(spark, sf):
    seg = segments(spark, sf).filter("split <> 'train' OR (region = 'ASIA' AND seg_no = 7)").withColumn("c", F.col("file_id") % 97)
    return rounded(S.channel_overlap(seg, "c", "speaker"), "segment_share", "speaker_share")


@query("d09_ordered_distinct", "SELECT event_type, min(event_id) AS place FROM events GROUP BY event_type")
def d09(spark, sf):
    return S.ordered_distinct(table(spark, sf, "events"), "event_type", "event_id")
