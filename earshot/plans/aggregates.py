"""Queries of the A operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions.text import normalize_name
from earshot.operators import gates as G
from earshot.operators import summary as S
from earshot.plans.registry import query, segments
from earshot.session import table


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


GATED = """gated AS (SELECT *, is_excluded OR (coalesce(music_prob, 0) >= 0.6 AND coalesce(panns_speech_prob, 1) < 0.5) OR coalesce(speech_ratio, 1) < 0.75 OR coalesce(snr_db, 99) < 3 AS gone FROM seg)"""


@query("a01_class_summary", f"""WITH {{seg}}, {GATED} SELECT region, count(*) AS segments, round(sum(duration) / 3600, 6) AS hours,
count(DISTINCT speaker) AS speakers, count(DISTINCT playlist) AS channels, count(DISTINCT file_id) AS episodes FROM gated WHERE NOT gone GROUP BY region""")
def a01(spark, sf):
    seg = G.content_gates(segments(spark, sf)).filter("NOT is_excluded")
    return rounded(S.class_summary(seg, ["region"], {"speakers": "speaker", "channels": "playlist", "episodes": "file_id"}), "hours")


@query("a02_per_speaker", """WITH {seg} SELECT speaker, count(*) AS segments, round(sum(duration) / 3600, 6) AS hours, min(tier) AS tier FROM seg GROUP BY speaker""")
def a02(spark, sf):
    return rounded(S.per_speaker(segments(spark, sf), "speaker", "tier", "recorded"), "hours")


@query("a03_split_summary", """WITH {seg} SELECT split, region, count(*) AS segments, round(sum(duration) / 3600, 6) AS hours, count(DISTINCT playlist) AS channels FROM seg GROUP BY split, region""")
def a03(spark, sf):
    return rounded(S.class_summary(segments(spark, sf), ["split", "region"], {"channels": "playlist"}), "hours")


@query("a04_top_source_share", """WITH {seg}, h AS (SELECT region, playlist, sum(duration) / 3600 AS h FROM seg GROUP BY ALL),
r AS (SELECT *, sum(h) OVER (PARTITION BY region) AS a, row_number() OVER (PARTITION BY region ORDER BY round(h, 9) DESC, playlist) AS k FROM h)
SELECT region, playlist, round(h / a, 6) AS share FROM r WHERE k = 1""")
def a04(spark, sf):
    return rounded(S.top_share(segments(spark, sf), "region", "playlist"), "share")


@query("a05_provenance", """WITH {seg}, e AS (SELECT DISTINCT region, file_id, CASE WHEN file_id % 3 = 0 THEN 'catalogue' ELSE 'search' END AS p FROM seg)
SELECT region, count(*) AS episodes, count(*) FILTER (WHERE p = 'catalogue') AS catalogue, round(100.0 * count(*) FILTER (WHERE p = 'catalogue') / count(*), 6) AS catalogue_percent FROM e GROUP BY region""")
def a05(spark, sf):
    eps = segments(spark, sf).select("region", "file_id").distinct()
    side = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderkey") % 3 == 0, "catalogue").otherwise("search").alias("p"))
    return rounded(S.provenance_counts(eps.join(side, "file_id", "left"), "region", "p"), "catalogue_percent")


@query("a06_tier_quality", """WITH {seg}, q AS (SELECT tier, CASE WHEN snr_db >= 15 THEN 'clean' ELSE 'noisy' END AS quality FROM seg)
SELECT 'tier' AS kind, tier AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM q), 6) AS share FROM q GROUP BY tier
UNION ALL SELECT 'quality', quality, count(*), round(count(*) / (SELECT count(*) FROM q), 6) FROM q GROUP BY quality""")
def a06(spark, sf):
    seg = segments(spark, sf).withColumn("quality", G.quality_flag(F.col("snr_db")))
    both = [S.counts_with_share(seg, c).select(F.lit(c).alias("kind"), F.col(c).alias("value"), "n", F.round("share", 6).alias("share")) for c in ("tier", "quality")]
    return S.union_all(*both)


@query("a07_corpus_totals", """WITH {seg} SELECT CASE grouping(region) WHEN 0 THEN 'group' ELSE 'total' END AS level, region, count(*) AS segments, round(sum(duration) / 60, 4) AS minutes, count(DISTINCT playlist) AS playlists, count(DISTINCT file_id) AS episodes, count(DISTINCT speaker) AS speakers FROM seg GROUP BY ROLLUP (region)""")
def a07(spark, sf):
    return rounded(S.corpus_totals(segments(spark, sf), "region", {"playlists": "playlist", "episodes": "file_id", "speakers": "speaker"}), "minutes", digits=4)


@query("a08_temporal_coverage", """WITH d AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d') END AS d FROM orders)
SELECT 'all' AS year, count(*) AS n, count(d) AS dated, min(d) AS first, max(d) AS last FROM d UNION ALL SELECT substr(d, 1, 4), count(*), NULL, NULL, NULL FROM d WHERE d IS NOT NULL GROUP BY 1""")
def a08(spark, sf):
    d = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("d"))
    whole, years = S.temporal_coverage(d, "d")
    return S.union_all(whole.select(F.lit("all").alias("year"), F.col("total").alias("n"), "dated", "first", "last"), years)


@query("a09_resource_metadata", """WITH {seg}, s AS (SELECT playlist, coalesce(exclude_reason, '') AS k, count(*) AS v FROM seg GROUP BY ALL)
SELECT playlist, sum(v)::BIGINT AS segments, string_agg(k || '=' || v, ';' ORDER BY k) AS statuses, (SELECT count(DISTINCT file_id) FROM seg g WHERE g.playlist = s.playlist) AS episodes FROM s GROUP BY playlist""")
def a09(spark, sf):
    m = S.resource_metadata(segments(spark, sf), "playlist", "exclude_reason", "file_id")
    pairs = F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("playlist", "segments", F.array_join(pairs, ";").alias("statuses"), F.size("episodes").alias("episodes"))


@query("a10_actor_triage", """WITH {seg} SELECT speaker, count(*) AS n, round(avg(music_prob), 6) AS music_mean, round(avg(CASE WHEN music_prob >= 0.5 THEN 1 ELSE 0 END), 6) AS music_share, round(sum(duration) / 60, 4) AS minutes,
round(greatest(avg(music_prob), 1 - avg(speech_ratio), 1 - avg(panns_speech_prob), 1 - least(avg(snr_db) / 30, 1)), 6) AS risk FROM seg GROUP BY speaker""")
def a10(spark, sf):
    t = S.actor_triage(segments(spark, sf), "speaker").select("speaker", "n", "music_mean", "music_share", "minutes", "risk")
    return rounded(rounded(t, "minutes", digits=4), "music_mean", "music_share", "risk")


@query("a11_gender_mix", """WITH a AS (SELECT c_custkey AS user_id, (c_acctbal + 1000) / 11000 AS base FROM customer),
v AS (SELECT user_id, avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, round(least(p, 1 - p), 6) AS gender_mix, CASE WHEN p >= 0.5 THEN 'female' WHEN p IS NOT NULL THEN 'male' END AS gender_majority, coalesce(n, 0) AS gender_n,
round(CASE WHEN coalesce(n, 0) >= 5 THEN greatest(base, least(1, 2 * least(p, 1 - p))) ELSE base END, 6) AS risk FROM a LEFT JOIN v USING (user_id)""")
def a11(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), ((F.col("c_acctbal") + 1000) / 11000).alias("risk"))
    v = table(spark, sf, "events").select("user_id", F.when(F.col("event_type").isin("view", "click"), "female").otherwise("male").alias("label"))
    out = S.gender_mix(S.gender_mix(a, v, "user_id").drop("gender_mix", "gender_majority", "gender_n"), v, "user_id")
    return rounded(out.drop("risk_score_base"), "gender_mix", "risk")


MODE = "(SELECT {c} FROM (SELECT {k}, {c}, count(*) AS n FROM seg GROUP BY ALL) m WHERE m.{k} = o.{k} ORDER BY n DESC, {c} LIMIT 1)"


@query("a12_actor_table", f"""WITH {{seg}}, o AS (SELECT speaker, min(playlist) AS playlist, count(*) AS n, sum(duration) / 60 AS minutes FROM seg GROUP BY speaker),
g AS (SELECT playlist, sum(n)::BIGINT AS group_n, sum(minutes) AS group_minutes FROM o GROUP BY playlist)
SELECT o.speaker, o.playlist, n, round(minutes, 4) AS minutes, {MODE.format(c="exclude_reason", k="speaker").replace("exclude_reason", "quality").replace("FROM seg", "FROM (SELECT *, CASE WHEN snr_db >= 15 THEN 'clean' ELSE 'noisy' END AS quality FROM seg)")} AS quality,
group_n, group_n < 5 OR round(group_minutes * 60, 6) < 45 AS below_floor, CASE WHEN o.speaker % 2 = 0 THEN round((c_acctbal + 1000) / 11000, 6) ELSE 0.5 END AS risk
FROM o JOIN g USING (playlist) JOIN customer ON o.speaker = c_custkey""")
def a12(spark, sf):
    risks = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("speaker"), ((F.col("c_acctbal") + 1000) / 11000).alias("risk"))
    seg = segments(spark, sf).withColumn("quality", G.quality_flag(F.col("snr_db")))
    out = S.actor_table(seg, "speaker", "playlist", ["quality"], risks).select("speaker", "playlist", "n", "minutes", "quality", "group_n", "below_floor", "risk")
    return rounded(rounded(out, "minutes", digits=4), "risk")


@query("a13_evidence", """WITH {seg} SELECT speaker, count(*) FILTER (WHERE NOT is_excluded) AS evidence_segments, round(coalesce(sum(duration) FILTER (WHERE NOT is_excluded), 0), 4) AS evidence_seconds,
count(*) FILTER (WHERE NOT is_excluded) < 5 OR round(coalesce(sum(duration) FILTER (WHERE NOT is_excluded), 0), 6) < 45 AS dust FROM seg GROUP BY speaker""")
def a13(spark, sf):
    return rounded(S.evidence(segments(spark, sf), "speaker", F.col("is_excluded")), "evidence_seconds", digits=4)


@query("a14_dominant_by_duration", """WITH {seg}, d AS (SELECT playlist, tier, round(sum(duration), 6) AS w FROM seg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY w DESC, tier) AS k FROM d)
SELECT playlist, tier FROM r WHERE k = 1""")
def a14(spark, sf):
    return S.dominant(segments(spark, sf), ["playlist"], "tier", F.col("duration"))


@query("a15_dominant_by_count", """WITH {seg}, d AS (SELECT playlist, tier, count(*) AS w FROM seg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY playlist ORDER BY w DESC, tier) AS k FROM d)
SELECT playlist, tier FROM r WHERE k = 1""")
def a15(spark, sf):
    return S.dominant(segments(spark, sf), ["playlist"], "tier")


@query("a16_channel_table", """WITH {seg} SELECT playlist, CASE WHEN playlist IN ('NATION_1', 'NATION_2') THEN 'TikTok' ELSE 'YouTube' END AS platform, round(sum(duration) / 3600, 6) AS hours, count(*) AS segments, count(DISTINCT speaker) AS speakers,
string_agg(DISTINCT split, '|' ORDER BY split) AS splits, min(region) AS region FROM seg GROUP BY playlist""")
def a16(spark, sf):
    name = F.when(F.col("playlist").isin("NATION_1", "NATION_2"), "tiktok_a").otherwise(F.col("playlist"))
    return rounded(S.channel_table(segments(spark, sf), "playlist", "region", G.platform(name), "speaker", "split"), "hours")


@query("a17_pivot", """WITH {seg} SELECT region, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'test') AS test FROM seg GROUP BY region""")
def a17(spark, sf):
    return S.pivot_counts(segments(spark, sf), "region", "split", ["train", "test"])


@query("a18_concentration", """WITH {seg}, h AS (SELECT region, playlist, sum(duration) / 3600 AS h FROM seg GROUP BY ALL)
SELECT region, count(*) AS n, round(sum(h) * sum(h) / sum(h * h), 6) AS n_eff, round(stddev_pop(h) / avg(h), 6) AS cv FROM h GROUP BY region""")
def a18(spark, sf):
    h = segments(spark, sf).groupBy("region", "playlist").agg(S.hours().alias("h"))
    return rounded(S.concentration(h, "region", "h"), "n_eff", "cv")


@query("a19_channel_counts", """WITH {seg}, d AS (SELECT speaker, tier, round(sum(duration), 6) AS w FROM (SELECT speaker, duration, CASE WHEN seg_no % 2 = 0 THEN 'even' ELSE 'odd' END AS tier FROM seg) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY w DESC, tier) AS k FROM d)
SELECT tier AS class, count(DISTINCT speaker) AS carrier, count(*) FILTER (WHERE k = 1) AS dominant FROM r GROUP BY tier UNION ALL SELECT 'Total', count(DISTINCT speaker), count(DISTINCT speaker) FROM r""")
def a19(spark, sf):
    seg = segments(spark, sf).withColumn("class", F.when(F.col("seg_no") % 2 == 0, "even").otherwise("odd"))
    return S.channel_counts(seg, "speaker", "class")


@query("a20_distinct_speakers", "WITH {seg} SELECT region, count(DISTINCT speaker) AS speakers FROM seg GROUP BY region")
def a20(spark, sf):
    return S.distinct_speakers(segments(spark, sf), "region", "speaker")


@query("a21_crosstab", "SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n, CASE grouping(o_orderstatus, o_orderpriority) WHEN 0 THEN 'cell' WHEN 1 THEN 'by_o_orderstatus' WHEN 2 THEN 'by_o_orderpriority' ELSE 'total' END AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a21(spark, sf):
    return S.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("a22_gender_by_region", """WITH {seg}, s AS (SELECT DISTINCT speaker, region, CASE WHEN speaker % 3 = 0 THEN 'f' ELSE 'm' END AS g FROM seg)
SELECT region, count(*) FILTER (WHERE g = 'f') AS f, count(*) FILTER (WHERE g = 'm') AS m, round(count(*) FILTER (WHERE g = 'f') / count(*), 6) AS female_share FROM s GROUP BY region""")
def a22(spark, sf):
    seg = segments(spark, sf)
    who = S.dominant(seg, ["speaker"], "region", F.col("duration")).withColumn("g", F.when(F.col("speaker") % 3 == 0, "f").otherwise("m"))
    return S.pivot_counts(who, "region", "g", ["f", "m"]).withColumn("female_share", F.round(F.col("f") / (F.col("f") + F.col("m")), 6))


@query("a23_funnel", """WITH {seg} SELECT round(sum(duration) / 60, 3) AS "all", round(sum(CASE WHEN music_prob < 0.6 THEN duration ELSE 0 END) / 60, 3) AS music, round(sum(CASE WHEN music_prob < 0.6 AND speech_ratio >= 0.75 THEN duration ELSE 0 END) / 60, 3) AS speech,
round(sum(CASE WHEN music_prob < 0.6 AND speech_ratio >= 0.75 AND snr_db >= 3 THEN duration ELSE 0 END) / 60, 3) AS snr FROM seg""")
def a23(spark, sf):
    c = F.col
    return rounded(S.funnel(segments(spark, sf), {"music": c("music_prob") < 0.6, "speech": c("speech_ratio") >= 0.75, "snr": c("snr_db") >= 3}), "all", "music", "speech", "snr", digits=3)


@query("a24_reason_counts", "WITH {seg} SELECT coalesce(nullif(trim(exclude_reason), ''), '(none)') AS exclude_reason, count(*) AS n FROM seg GROUP BY 1")
def a24(spark, sf):
    return S.value_counts(segments(spark, sf), "exclude_reason")


@query("a25_histogram", """WITH {seg}, b AS (SELECT is_excluded, least(floor(snr_db / 1.0), 39)::INT AS bin FROM seg WHERE snr_db BETWEEN 0 AND 40)
SELECT is_excluded, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY is_excluded), 8) AS density FROM b GROUP BY is_excluded, bin""")
def a25(spark, sf):
    return rounded(S.histogram(segments(spark, sf), "snr_db", 0.0, 40.0, 40, ["is_excluded"]), "density", digits=8)


@query("a26_bucket_minutes", """WITH {seg} SELECT CASE WHEN duration < 5 THEN 'short' WHEN duration < 8 THEN 'medium' ELSE 'long' END AS bucket, round(sum(duration) / 60, 3) AS minutes FROM seg WHERE duration BETWEEN 3 AND 10 GROUP BY 1""")
def a26(spark, sf):
    return rounded(S.bucket_minutes(segments(spark, sf)), "minutes", digits=3)


@query("a27_composition", """WITH {seg}, v AS (SELECT unnest(['Tier1', 'Tier2', 'Tier3', 'reject']) AS tier), r AS (SELECT DISTINCT region FROM seg)
SELECT r.region, v.tier, count(s.tier) AS n FROM r CROSS JOIN v LEFT JOIN seg s ON s.region = r.region AND s.tier = v.tier GROUP BY ALL""")
def a27(spark, sf):
    return S.composition(segments(spark, sf), "region", "tier", ["Tier1", "Tier2", "Tier3", "reject"])


@query("a28_stage_summary", """WITH e AS (SELECT o_custkey AS "show", o_orderkey AS "order", CASE o_orderstatus WHEN 'F' THEN 'downloaded' WHEN 'O' THEN 'picked' ELSE 'diarized' END AS stage, strftime(o_orderdate, '%Y%m%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'id' || o_orderkey END AS id FROM orders)
SELECT "show", count(*) FILTER (WHERE stage = 'picked') AS picked, count(*) FILTER (WHERE stage = 'downloaded') AS downloaded, min(date) AS first, max(date) AS last, coalesce(arg_min(id, "order") FILTER (WHERE trim(id) <> ''), '') AS id FROM e GROUP BY 1""")
def a28(spark, sf):
    c = F.col
    e = table(spark, sf, "orders").select(c("o_custkey").alias("show"), c("o_orderkey").alias("order"), F.when(c("o_orderstatus") == "F", "downloaded").when(c("o_orderstatus") == "O", "picked").otherwise("diarized").alias("stage"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.when(c("o_orderkey") % 2 == 0, " ").otherwise(F.concat(F.lit("id"), c("o_orderkey").cast("string"))).alias("id"))
    return S.stage_summary(e, "show", ["picked", "downloaded"])


@query("a29_coverage", """SELECT CASE grouping(o_orderpriority) WHEN 0 THEN 'group' ELSE 'total' END AS level, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_custkey % 3 = 0) AS ids, round(100.0 * count(*) FILTER (WHERE o_custkey % 3 = 0) / count(*), 6) AS ids_percent FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def a29(spark, sf):
    return rounded(S.coverage(table(spark, sf, "orders"), "o_orderpriority", {"ids": F.col("o_custkey") % 3 == 0}), "ids_percent")


@query("a30_keyword_rollup", """WITH h AS (SELECT user_id AS channel, event_id AS "order", CASE WHEN event_id % 3 = 0 THEN ' ' ELSE 'n' || event_id END AS name, event_type AS region, 't' || event_id AS title, 'k' || (event_id % 4) AS keyword FROM events),
k AS (SELECT channel, keyword, min("order") AS o FROM h GROUP BY ALL), m AS (SELECT channel, region, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, region) AS r FROM h GROUP BY channel, region)
SELECT channel, count(*) AS hits, arg_max(name, "order") FILTER (WHERE trim(name) <> '') AS name, array_to_string((list(title ORDER BY "order"))[1:3], ' ; ') AS titles,
(SELECT string_agg(keyword, ' ; ' ORDER BY o) FROM k WHERE k.channel = h.channel) AS keywords, (SELECT region FROM m WHERE m.channel = h.channel AND r = 1) AS region FROM h GROUP BY channel""")
def a30(spark, sf):
    c = F.col
    i = c("event_id").cast("string")
    h = table(spark, sf, "events").select(c("user_id").alias("channel"), c("event_id").alias("order"), F.when(c("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("n"), i)).alias("name"), c("event_type").alias("region"), F.concat(F.lit("t"), i).alias("title"), F.concat(F.lit("k"), (c("event_id") % 4).cast("string")).alias("keyword"))
    return S.keyword_rollup(h, "channel")


@query("a31_multi_show", "SELECT p_partkey, p_size AS n_shows FROM part WHERE p_size >= 8 ORDER BY p_size DESC, p_partkey LIMIT 15")
def a31(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("+")).alias("count"))
    return S.multi_show(p, "count").select("p_partkey", "n_shows")


@query("a32_capped", "SELECT p_partkey, CASE WHEN p_size - 1 >= 40 THEN '40+' WHEN p_size - 1 = 0 THEN '' ELSE (p_size - 1)::VARCHAR END AS shown FROM part")
def a32(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.capped(F.col("p_size") - 1, 40).alias("shown"))


@query("a33_run_totals", "SELECT CASE grouping(l_returnflag) WHEN 0 THEN 'group' ELSE 'total' END AS level, l_returnflag, round(sum(l_quantity), 3) AS l_quantity, round(sum(l_extendedprice), 1) AS l_extendedprice FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def a33(spark, sf):
    return rounded(rounded(S.run_totals(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]), "l_quantity", digits=3), "l_extendedprice", digits=1)


@query("a34_reviewed_report", """WITH {seg} SELECT region, round(sum(CASE WHEN NOT is_excluded THEN duration ELSE 0 END) / 3600, 6) AS kept_hours, round(sum(CASE WHEN NOT is_excluded AND speaker % 5 <> 0 THEN duration ELSE 0 END) / 3600, 6) AS effective_hours,
count(DISTINCT CASE WHEN NOT is_excluded AND speaker % 5 <> 0 THEN speaker END) AS speakers, count(*) FILTER (WHERE NOT is_excluded AND speaker % 5 = 0) AS floor_rows FROM seg GROUP BY region""")
def a34(spark, sf):
    return rounded(S.reviewed_report(segments(spark, sf), "region", "speaker", ~F.col("is_excluded"), F.col("speaker") % 5 == 0), "kept_hours", "effective_hours")


ACTORS = """actors AS (SELECT c_custkey AS actor, r_name AS region, CASE c_mktsegment WHEN 'BUILDING' THEN 'keep' WHEN 'MACHINERY' THEN 'reject' END AS decision, CASE WHEN c_custkey % 9 = 0 THEN 'X' ELSE '' END AS resolved_region,
(c_acctbal + 1000) / 100 AS hours, c_custkey % 6 = 0 AS below_floor FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def actors(spark, sf):
    from earshot.plans.registry import views

    views(spark, sf, "customer", "nation", "region")
    return spark.sql(f"WITH {ACTORS} SELECT * FROM actors")


@query("a35_review_kpis", f"""WITH {ACTORS} SELECT count(*) AS actors, count(decision) AS decided, round(count(decision) / count(*), 6) AS coverage, round(sum(CASE WHEN decision = 'keep' AND NOT below_floor THEN hours ELSE 0 END), 3) AS kept_hours,
round(sum(CASE WHEN decision = 'reject' AND NOT below_floor THEN hours ELSE 0 END), 3) AS removed_hours, round(sum(CASE WHEN below_floor THEN hours ELSE 0 END), 3) AS dust_hours,
round(sum(CASE WHEN decision IS NULL AND NOT below_floor THEN hours ELSE 0 END), 3) AS pending_hours, count(*) FILTER (WHERE decision IS NOT NULL AND below_floor) AS dust_decided FROM actors""")
def a35(spark, sf):
    return rounded(rounded(S.review_kpis(actors(spark, sf)), "coverage"), "kept_hours", "removed_hours", "dust_hours", "pending_hours", digits=3)


@query("a36_review_composition", f"""WITH {ACTORS} SELECT coalesce(nullif(resolved_region, ''), region) AS final_region, CASE WHEN decision = 'keep' THEN 'kept' ELSE 'pending' END AS status, round(sum(hours), 3) AS weight
FROM actors WHERE decision = 'keep' OR decision IS NULL GROUP BY 1, 2""")
def a36(spark, sf):
    return rounded(S.review_composition(actors(spark, sf)), "weight", digits=3)


@query("a37_playlist_actors", """WITH {seg} SELECT playlist, global_actor, count(*) AS n, round(sum(duration) / 60, 4) AS minutes FROM seg WHERE NOT is_excluded AND global_actor >= 0 AND tier IN ('Tier1', 'Tier2') GROUP BY ALL""")
def a37(spark, sf):
    return G.kept(segments(spark, sf)).groupBy("playlist", "global_actor").agg(F.count("*").alias("n"), F.round(F.sum("duration") / 60, 4).alias("minutes"))


@query("a38_show_index", """SELECT trim(regexp_replace(lower(p_brand), '[^0-9a-z]+', ' ', 'g')) AS key, sum(p_size)::BIGINT AS episodes, arg_min(p_type, p_partkey) AS region, arg_min(p_name, p_partkey) AS "show" FROM part GROUP BY 1""")
def a38(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("region"), F.col("p_name").alias("show"), F.col("p_size").alias("episodes"), "p_brand")
    return S.show_index(p, normalize_name(F.col("p_brand")), "p_partkey")


HARVEST = """e AS (SELECT event_id AS "order", event_id % 700 AS id, user_id AS hash, value AS seconds FROM events), i AS (SELECT *, id < 50 OR row_number() OVER (PARTITION BY id ORDER BY "order") > 1 AS known FROM e),
s AS (SELECT *, CASE WHEN known THEN 'dup_id' WHEN seconds > 90 THEN 'too_long' END AS st FROM i),
h AS (SELECT *, coalesce(st, CASE WHEN hash < 10 OR row_number() OVER (PARTITION BY hash, st IS NULL ORDER BY "order") > 1 THEN 'dup_audio' END, 'downloaded') AS status FROM s)"""


def harvest(spark, sf):
    c = F.col
    e = table(spark, sf, "events").select(c("event_id").alias("order"), (c("event_id") % 700).alias("id"), c("user_id").alias("hash"), c("value").alias("seconds"))
    return S.harvest_status(e, spark.range(50), spark.range(10).select(c("id").alias("hash")), 90.0)


@query("a39_harvest_counts", f"WITH {HARVEST} SELECT status, count(*) AS n FROM h GROUP BY status")
def a39(spark, sf):
    return harvest(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("a40_reason_breakdown", f"""WITH {ACTORS}, b AS (SELECT *, least(floor(hours / 4.4), 24)::INT AS bin, decision IS NOT NULL AS decided FROM actors WHERE hours BETWEEN 0 AND 110)
SELECT 'reason' AS kind, coalesce(decision, '(none)') AS value, count(*) AS n FROM actors GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM actors GROUP BY 2 UNION ALL SELECT 'risk_' || decided, bin::VARCHAR, count(*) FROM b GROUP BY ALL""")
def a40(spark, sf):
    a = actors(spark, sf)
    out = [S.value_counts(a, c).select(F.lit(k).alias("kind"), F.col(c).alias("value"), "n") for k, c in (("reason", "decision"), ("region", "region"))]
    hist = S.histogram(a.withColumn("decided", F.col("decision").isNotNull()), "hours", 0.0, 110.0, 25, ["decided"])
    return S.union_all(*out, hist.select(F.concat(F.lit("risk_"), F.col("decided").cast("string")).alias("kind"), F.col("bin").cast("string").alias("value"), "n"))
