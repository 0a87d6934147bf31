"""Queries of the P and X operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from earshot.functions import text as T
from earshot.functions import vectors as V
from earshot.operators import gates as G
from earshot.plans.registry import query, segments
from earshot.session import table

KEY = ("file_id", "seg_no")
RULES = "coalesce(music_prob, 0) >= 0.6 AND coalesce(panns_speech_prob, 1) < 0.5"
CASE = f"CASE WHEN {RULES} THEN 'music' WHEN coalesce(speech_ratio, 1) < 0.75 THEN 'low_speech' WHEN coalesce(snr_db, 99) < 3 THEN 'low_snr' ELSE %s END"
ANY = f"({RULES} OR coalesce(speech_ratio, 1) < 0.75 OR coalesce(snr_db, 99) < 3)"
BLANK = "lower(trim(coalesce(%s, ''))) IN ('', 'na', 'nan', 'none')"


@query("p01_content_gates", f"""WITH {{seg}} SELECT file_id, seg_no, is_excluded OR {ANY} AS is_excluded,
CASE WHEN {BLANK % "exclude_reason"} THEN {CASE % "coalesce(exclude_reason, '')"} ELSE exclude_reason END AS exclude_reason FROM seg""")
def p01(spark, sf):
    return G.content_gates(segments(spark, sf)).select(*KEY, "is_excluded", "exclude_reason")


@query("p02_fill_reasons", f"""WITH {{seg}} SELECT file_id, seg_no,
CASE WHEN is_excluded AND {BLANK % "exclude_reason"} THEN {CASE % "'mad_outlier'"} ELSE coalesce(exclude_reason, '') END AS exclude_reason FROM seg""")
def p02(spark, sf):
    return G.fill_reasons(segments(spark, sf)).select(*KEY, "exclude_reason")


@query("p03_repair", """WITH {seg}, f AS (SELECT DISTINCT o_orderkey + 1000000 AS bad, o_orderkey AS good FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(good, file_id + 1000000) AS file_id, seg_no, CASE WHEN NOT is_excluded THEN '' ELSE coalesce(exclude_reason, '') END AS exclude_reason
FROM seg LEFT JOIN f ON file_id + 1000000 = bad""")
def p03(spark, sf):
    orders = table(spark, sf, "orders")
    fixes = orders.filter("o_orderkey % 3 = 0 OR o_orderkey % 3 = 1").select((F.col("o_orderkey") + 1000000).alias("bad"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("good"))
    mangled = segments(spark, sf).withColumn("file_id", F.col("file_id") + 1000000)
    return G.repair_ids(G.repair_reasons(mangled), fixes, orders.select(F.col("o_orderkey").alias("file_id"))).select(*KEY, "exclude_reason")


@query("p04_quality", "WITH {seg} SELECT file_id, seg_no, CASE WHEN snr_db >= 15 THEN 'clean' ELSE 'noisy' END AS quality FROM seg")
def p04(spark, sf):
    return segments(spark, sf).select(*KEY, G.quality_flag(F.col("snr_db")).alias("quality"))


@query("p05_empty_slices", """WITH {seg} SELECT file_id, seg_no, is_excluded OR start_time >= 20 * (file_id % 7) AS is_excluded,
CASE WHEN start_time >= 20 * (file_id % 7) THEN 'empty_slice' ELSE coalesce(exclude_reason, '') END AS exclude_reason FROM seg""")
def p05(spark, sf):
    return G.empty_slices(segments(spark, sf), 20 * (F.col("file_id") % 7)).select(*KEY, "is_excluded", "exclude_reason")


@query("p06_active_kept", """WITH {seg} SELECT region, count(*) AS active, count(*) FILTER (WHERE tier IN ('Tier1', 'Tier2')) AS kept FROM seg
WHERE NOT is_excluded AND global_actor >= 0 GROUP BY region""")
def p06(spark, sf):
    seg = segments(spark, sf)
    kept = G.kept(seg).groupBy("region").agg(F.count("*").alias("kept"))
    return G.active(seg).groupBy("region").agg(F.count("*").alias("active")).join(kept, "region", "left").select("region", "active", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("p07_reviewed", "WITH {seg} SELECT file_id, seg_no, speaker FROM seg WHERE segment_group = 'BUILDING' AND NOT is_excluded")
def p07(spark, sf):
    return G.reviewed(segments(spark, sf).withColumn("verified_keep", F.col("segment_group") == "BUILDING")).select(*KEY, "speaker")


@query("p08_controls", """WITH {seg} SELECT file_id, seg_no, playlist AS final_dialect FROM seg WHERE region = 'ASIA' AND NOT is_excluded AND global_actor >= 0 AND tier IN ('Tier1', 'Tier2')""")
def p08(spark, sf):
    seg = segments(spark, sf).withColumn("macro_class", F.when(F.col("region") == "ASIA", "Control").otherwise("Target"))
    return G.controls(seg, renames={"playlist": "final_dialect"}).select(*KEY, "final_dialect")


@query("p09_canonical_region", """SELECT n_nationkey, CASE lower(r_name) WHEN 'asia' THEN 'Far East' WHEN 'europe' THEN 'EUROPE' WHEN 'middle east' THEN 'Levant'
ELSE array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey""")
def p09(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", G.canonical(F.col("r_name"), {"asia": "Far East"}, ["EUROPE"], {"middle east": "Levant"}).alias("canonical"))


@query("p10_macro_class", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Control' ELSE 'Target' END AS macro FROM customer")
def p10(spark, sf):
    folder = F.when(F.col("c_mktsegment") == "BUILDING", "Con_trols").otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", G.macro_class(folder).alias("macro"))


def parts_as_registry(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.when(F.col("p_partkey") % 11 == 0, "#off").when(F.col("p_partkey") % 13 == 0, " ").otherwise(F.concat(F.lit("u/"), F.col("p_partkey").cast("string"))).alias("url"),
        F.when(F.col("p_size") % 2 == 0, "Approved").otherwise("pending").alias("status"), F.element_at(F.split("p_type", " "), 1).alias("region"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_brand")).alias("source"), F.col("p_name").alias("show"), F.lit(" ").alias("lang_flag"),
    )


@query("p11_registry_rows", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN nullif(trim(p_name), '') ELSE p_brand END AS source, p_name AS show, 'arabic' AS lang_flag
FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_size % 2 = 0""")
def p11(spark, sf):
    return G.registry_rows(parts_as_registry(spark, sf), only_approved=True).select("p_partkey", "source", "show", "lang_flag")


@query("p12_pick_resources", """WITH {seg} SELECT DISTINCT region, playlist FROM seg WHERE contains(lower(playlist), 'an') OR contains(lower(playlist), '1')""")
def p12(spark, sf):
    names = segments(spark, sf).select("region", "playlist").distinct()
    return G.pick_resources(names, contains="an").unionByName(G.pick_resources(names, contains="1")).distinct()


@query("p13_any_of", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p13(spark, sf):
    return G.any_of(table(spark, sf, "orders"), o_orderstatus=["O", "F"], o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None).select("o_orderkey")


@query("p14_text_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '01') OR contains(lower(c_mktsegment), 'mach')")
def p14(spark, sf):
    c = table(spark, sf, "customer")
    return G.text_search(c, "01", ["c_name", "c_mktsegment"], "c_acctbal").unionByName(G.text_search(c, "MACH", ["c_name", "c_mktsegment"], "c_acctbal")).select("c_custkey", "c_name").distinct()


@query("p15_platform", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'TikTok' ELSE 'YouTube' END AS platform FROM documents")
def p15(spark, sf):
    name = F.when(F.col("source").isin("src1", "src2"), "Tik" + "Tok_x").otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", G.platform(name, F.col("lang")).alias("platform"))


@query("p16_migrate_decisions", """SELECT event_id, CASE event_type WHEN 'click' THEN 'keep' WHEN 'view' THEN 'reject' ELSE 'pending' END AS decision,
CASE event_type WHEN 'view' THEN 'music' ELSE '' END AS reason, CASE WHEN event_type IN ('click', 'view') THEN 'n' ELSE 'n [was: ' || event_type || ']' END AS notes FROM events""")
def p16(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("category"), F.lit("n").alias("notes"))
    return G.migrate_decisions(e, {"click": ("keep", ""), "view": ("reject", "music")})


@query("p17_score_column", "SELECT l_orderkey AS file_id, l_linenumber AS seg_no, l_quantity / 50 AS dialect_strength FROM lineitem")
def p17(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("seg_no"), "l_quantity")

    def scorer(q):
        return q / 50

    scorer.__annotations__ = {"q": pd.Series, "return": pd.Series}
    return G.with_score(rows, "dialect_strength", scorer, "l_quantity").drop("l_quantity")


@query("p18_junk_titles", "SELECT event_id FROM events WHERE event_type IS NULL OR event_type NOT IN ('view')")
def p18(spark, sf):
    title = F.when(F.col("event_type") == "view", " Uploads").otherwise(F.col("event_type"))
    return table(spark, sf, "events").filter(G.not_junk_title(title)).select("event_id")


@query("p19_show_playlists", "SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 1)")
def p19(spark, sf):
    pid = F.concat(F.element_at(F.array(F.lit("PL"), F.lit("OLAK5uy_"), F.lit("UU"), F.lit("xPL")), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name"))
    return table(spark, sf, "part").filter(G.show_playlist(pid)).select("p_partkey")


@query("p20_probe_eligible", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND abs(value / 100 - (1 - value / 100)) >= 0.3")
def p20(spark, sf):
    label = F.when(F.col("event_type") == "click", "female").when(F.col("event_type") == "view", "male").otherwise("unsure")
    return G.probe_eligible(table(spark, sf, "events").withColumns({"label": label, "p_female": F.col("value") / 100, "p_male": 1 - F.col("value") / 100})).select("event_id")


@query("p21_blind", "SELECT conv_id, turn, text FROM conversations")
def p21(spark, sf):
    return G.blind(table(spark, sf, "conversations"), ["conv_id", "turn", "text"], "turn")


@query("p22_normalise_fuse", """SELECT vec_id, len(embedding) + 10 AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) / CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) = 0 THEN 1 ELSE list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) END, 6) AS norm2 FROM embeddings""")
def p22(spark, sf):
    e = table(spark, sf, "embeddings")
    one = V.unit(F.col("embedding"))
    return e.select("vec_id", F.size(V.fuse(one, F.array_repeat(F.lit(0.0), 10))).alias("dims"), F.round(V.dot(one, one), 6).alias("norm2"))


@query("p23_softmax", """WITH z AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: x::DOUBLE) AS z FROM embeddings)
SELECT vec_id, list_position(z, list_max(z)) - 1 AS label, round(exp(list_max(z)) / list_sum(list_transform(z, lambda x: exp(x))), 6) AS top FROM z""")
def p23(spark, sf):
    z = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", V.argmax(z).alias("label"), F.round(F.array_max(V.softmax(z)), 6).alias("top"))


@query("p24_gate_risk", """WITH {seg} SELECT file_id, seg_no, greatest(coalesce(music_prob, 0.5), coalesce(1 - speech_ratio, 0.5), coalesce(1 - panns_speech_prob, 0.5), coalesce(1 - least(snr_db / 30, 1), 0.5)) AS risk FROM seg""")
def p24(spark, sf):
    c = G.gate_risk(F.col("music_prob"), F.col("speech_ratio"), F.col("panns_speech_prob"), F.col("snr_db"))
    return segments(spark, sf).select(*KEY, c["risk"].alias("risk"))


@query("p25_key_precedence", "WITH {seg} SELECT region AS class, global_actor AS speaker, count(*) AS n FROM seg GROUP BY ALL")
def p25(spark, sf):
    seg = segments(spark, sf)
    who, what = G.speaker_column(seg.drop("speaker")), G.class_column(seg)
    return seg.groupBy(F.col(what).alias("class"), F.col(who).alias("speaker")).agg(F.count("*").alias("n"))


@query("p26_score_bands", """WITH {seg}, u AS (SELECT file_id, seg_no, 'music_prob' AS metric, music_prob AS value FROM seg UNION ALL SELECT file_id, seg_no, 'snr_db', snr_db FROM seg)
SELECT *, CASE WHEN value IS NULL THEN NULL WHEN metric = 'music_prob' THEN CASE WHEN value <= 0.2 THEN 'good' WHEN value <= 0.6 THEN 'warn' ELSE 'bad' END
ELSE CASE WHEN value >= 15 THEN 'good' WHEN value >= 3 THEN 'warn' ELSE 'bad' END END AS band FROM u""")
def p26(spark, sf):
    return G.score_bands(segments(spark, sf).select(*KEY, "music_prob", "snr_db"), list(KEY), {"music_prob": (False, 0.2, 0.6), "snr_db": (True, 15, 3)})


@query("p27_needs_fill", "SELECT p_partkey FROM part WHERE (p_size % 2 = 0 AND (p_size % 3 = 0 OR p_size % 5 = 0)) OR (p_size % 2 = 1 AND p_size % 5 = 0)")
def p27(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "channel").otherwise("playlist").alias("url_type"), F.when(F.col("p_size") % 3 == 0, "nan").otherwise("4").alias("n_playlists"), F.when(F.col("p_size") % 5 == 0, " ").otherwise("9").alias("n_videos"), F.col("p_brand").alias("source"))
    return G.needs_fill(p).select("p_partkey")


@query("p28_readiness", "SELECT o_custkey AS playlist, count(*) AS episodes, bool_and(o_orderstatus <> 'O') AS ready FROM orders GROUP BY o_custkey")
def p28(spark, sf):
    return G.readiness(table(spark, sf, "orders").select(F.col("o_custkey").alias("playlist"), (F.col("o_orderstatus") != "O").alias("has_turns")))


@query("u01_segment_scorer", "SELECT l_orderkey AS file_id, l_linenumber AS seg_no, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS score FROM lineitem")
def u01(spark, sf):
    """A scalar scorer of several columns, given as a pandas function."""

    def scorer(q, middle):
        return 1 / (1 + (-(q - middle) / 10).pipe(np.exp))

    scorer.__annotations__ = {"q": pd.Series, "middle": pd.Series, "return": pd.Series}
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("seg_no"), "l_quantity", F.lit(25.0).alias("middle"))
    return G.with_score(rows, "score", scorer, "l_quantity", "middle").select("file_id", "seg_no", F.round("score", 6).alias("score"))


@query("u02_vector_helpers", """WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), k AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY label)
SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_dot_product(embedding::DOUBLE[], m), 6) AS dot FROM embeddings JOIN k USING (label)""")
def u02(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    both = e.join(V.mean_vectors(e, ["label"], "embedding", normalise=False).select("label", "centroid"), "label")
    return both.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.dot(F.col("embedding"), F.col("centroid")), 6).alias("dot"))


@query("x01_sanitize", """SELECT page_id, trim(regexp_replace(translate(html, '|' || chr(10) || chr(13) || chr(9), '/   '), '"{2,}', '"', 'g')) AS clean FROM pages""")
def x01(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.sanitize(F.col("html")).alias("clean"))


@query("x02_normalize_name", "SELECT doc_id, trim(regexp_replace(lower(text), '[^0-9a-z؀-ۿ]+', ' ', 'g')) AS name FROM documents")
def x02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_name(F.col("text")).alias("name"))


@query("x03_normalize_title", "SELECT page_id, trim(regexp_replace(lower(translate(url, '｜_|', '   ')), '\\s+', ' ', 'g')) AS title FROM pages")
def x03(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_title(F.col("url")).alias("title"))


@query("x04_title_similarity", "SELECT a.p_partkey, round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name), 1), 6) AS ratio FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def x04(spark, sf):
    p = table(spark, sf, "part")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(other, "p_partkey").select("p_partkey", F.round(T.title_similarity(F.col("p_name"), F.col("other")), 6).alias("ratio"))


@query("x06_stable_id", "SELECT page_id, substr(sha1(url), 1, 12) AS file_id FROM pages")
def x06(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.stable_id(F.col("url")).alias("file_id"))


@query("x07_playlist_id", "SELECT page_id, nullif(regexp_extract(replace(url, 'ref=', 'list='), '[?&]list=([^&#]+)', 1), '') AS pid FROM pages")
def x07(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.playlist_id(F.replace(F.col("url"), F.lit("ref="), F.lit("list="))).alias("pid"))


@query("x08_channel_url", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://www.youtube.com/channel/UC' || c_name ELSE 'https://www.youtube.com/@' || c_name END AS url,
'https://www.youtube.com/playlist?list=' || c_name AS playlist FROM customer""")
def x08(spark, sf):
    cid = F.concat(F.when(F.col("c_custkey") % 2 == 0, "UC").otherwise("@"), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", T.channel_url(cid).alias("url"), T.playlist_url(F.col("c_name")).alias("playlist"))


@query("x09_stem", "SELECT page_id, regexp_replace(regexp_extract(replace(url, 'example', 'a\\b [x]'), '([^/\\\\]*)$', 1), '\\.[^.]*$', '') AS stem, replace(url, '\\', '/') AS path FROM pages")
def x09(spark, sf):
    u = F.replace(F.col("url"), F.lit("example"), F.lit("a\\b [x]"))
    return table(spark, sf, "pages").select("page_id", T.stem(u).alias("stem"), T.forward_slashes(F.col("url")).alias("path"))


@query("x10_dates", """WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d, o_custkey FROM orders)
SELECT o_orderkey, substr(d, 1, 4) || '-' || substr(d, 5, 2) AS ym, substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS ymd,
CASE WHEN substr(d, 1, 6) = '199501' THEN '1995-01' ELSE substr(d, 1, 4) || '-' || substr(d, 5, 2) || ' → 1995-01' END AS period, (o_custkey // 60)::VARCHAR || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0') AS ms FROM d""")
def x10(spark, sf):
    d = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf, "orders").select("o_orderkey", T.year_month(d).alias("ym"), T.day(d).alias("ymd"), T.period(d, F.lit("19950131")).alias("period"), T.minutes_seconds(F.col("o_custkey")).alias("ms"))


@query("x11_actor_uid", "WITH {seg} SELECT region || '/' || playlist || '#' || global_actor AS actor_uid, region, count(*) AS n FROM seg GROUP BY ALL")
def x11(spark, sf):
    uid = T.actor_uid(F.col("region"), F.col("playlist"), F.col("global_actor"))
    return segments(spark, sf).select(uid.alias("actor_uid")).groupBy("actor_uid").agg(F.count("*").alias("n")).withColumn("region", T.region_of_uid(F.col("actor_uid")))


@query("x12_blank", "SELECT l_orderkey, l_linenumber, l_returnflag IN ('N', 'A') AS is_blank FROM lineitem")
def x12(spark, sf):
    c = F.when(F.col("l_returnflag") == "N", " NaN").when(F.col("l_returnflag") == "A", F.lit(None).cast("string")).otherwise("R")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.blank(c).alias("is_blank"))


@query("x13_validity", "SELECT o_orderkey, o_custkey % 3 = 0 AS date_ok, o_custkey % 2 = 1 AS id_ok FROM orders")
def x13(spark, sf):
    d = F.when(F.col("o_custkey") % 3 == 0, "20240131").when(F.col("o_custkey") % 3 == 1, "2024-1-1").otherwise(F.lit(None).cast("string"))
    i = F.when(F.col("o_custkey") % 2 == 1, "abc").otherwise("Unknown ")
    return table(spark, sf, "orders").select("o_orderkey", T.valid_date(d).alias("date_ok"), T.valid_id(i).alias("id_ok"))


@query("x14_registry_row", """SELECT p_partkey, 'https://www.youtube.com/playlist?list=' || p_name AS url, 'playlist' AS url_type, 'pending' AS status, coalesce(nullif(trim(p_brand), ''), 'unknown') AS source, 'arabic' AS lang_flag FROM part""")
def x14(spark, sf):
    from earshot.sources.registry import picked_rows

    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("playlist_id"), F.col("p_brand").alias("source"))
    return picked_rows(p).select("p_partkey", "url", "url_type", "status", "source", "lang_flag")


@query("x15_bag_folder", "SELECT CASE WHEN event_type = 'view' THEN user_id::VARCHAR ELSE event_type END AS bag, count(*) AS n FROM events GROUP BY 1")
def x15(spark, sf):
    channel = F.when(F.col("event_type") == "view", "Unknown").otherwise(F.col("event_type"))
    return table(spark, sf, "events").groupBy(T.bag_folder(channel, F.col("user_id").cast("string")).alias("bag")).agg(F.count("*").alias("n"))
