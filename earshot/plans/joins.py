"""Queries of the J operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.operators import joins as J
from earshot.operators.splits import numbered
from earshot.plans.aggregates import rounded
from earshot.plans.registry import query, segments
from earshot.session import stored, table

c = F.col


@query("j01_lookup", "WITH {seg} SELECT DISTINCT speaker, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE speaker::VARCHAR END AS speaker_global FROM seg JOIN customer ON speaker = c_custkey")
def j01(spark, sf):
    who = segments(spark, sf).select(c("speaker").cast("string").alias("speaker")).distinct()
    m = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(c("c_custkey").cast("string").alias("speaker"), c("c_name").alias("speaker_global"))
    return J.lookup(who, m, "speaker", "speaker_global").withColumn("speaker", c("speaker").cast("long"))


@query("j02_match_report", "SELECT count(*) AS rows, count(*) FILTER (WHERE l_orderkey % 4 = 0) AS missing, round(100.0 * count(*) FILTER (WHERE l_orderkey % 4 = 0) / count(*), 6) AS percent FROM lineitem")
def j02(spark, sf):
    l = table(spark, sf, "lineitem").select(c("l_orderkey").alias("k"), J.millis("l_quantity").alias("q"), c("l_linenumber").alias("n"))
    return rounded(J.match_report(l, l.filter("k % 4 <> 0"), ["k", "q", "n"]), "percent")


@query("j03_evidence_join", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def j03(spark, sf):
    n = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return J.lookup(table(spark, sf, "customer").select("c_custkey"), n, "c_custkey", "n", F.lit(0))


@query("j04_provenance_join", "WITH {seg} SELECT DISTINCT file_id, CASE WHEN file_id % 3 = 0 THEN 'F' END AS p FROM seg")
def j04(spark, sf):
    side = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(c("o_orderkey").alias("file_id"), F.lit("F").alias("p"))
    return J.lookup(segments(spark, sf).select("file_id").distinct(), side.unionByName(side), "file_id", "p", F.lit(None).cast("string"))


@query("j05_strict_join", "SELECT doc_id, quality, source FROM labels JOIN documents USING (doc_id)")
def j05(spark, sf):
    return J.strict_join(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"])


@query("j06_merge_predictions", "SELECT vec_id, label AS true, label % 3 AS pred_a, label % 4 AS pred_b FROM embeddings WHERE vec_id % 2 = 0")
def j06(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", c("label").alias("true"))
    return J.merge_predictions({"a": e.withColumn("pred", c("true") % 3), "b": e.filter("vec_id % 2 = 0").withColumn("pred", c("true") % 4)}, ["vec_id"])


@query("j07_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def j07(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 100000").select(c("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("j08_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j08(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


def durations(spark, sf):
    l = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select((c("o_custkey") % 200).alias("g"), c("o_orderkey").alias("local"), F.round(c("o_totalprice") / 100, 1).alias("l_dur"), F.concat(F.lit("T "), c("o_orderpriority")).alias("l_title"))
    r = table(spark, sf, "orders").filter("o_orderkey % 2 = 1").select((c("o_custkey") % 200).alias("g"), c("o_orderkey").alias("remote"), F.round(c("o_totalprice") / 100, 1).alias("r_dur"), F.concat(F.lit("t_"), c("o_orderpriority")).alias("r_title"))
    return l, r


@query("j11_assign_within")
def j11(spark, sf):
    l, r = durations(spark, sf)
    return J.assign_within(l, r, "g", 5.0)


SIDES = """l AS (SELECT o_orderkey AS local, round(o_totalprice / 100, 1) AS d, lower(replace('T ' || o_orderpriority || (o_custkey % 300), '_', ' ')) AS t FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT o_orderkey AS remote, round(o_totalprice / 100, 1) AS d, lower(replace('t_' || o_orderpriority || (o_custkey % 400), '_', ' ')) AS t FROM orders WHERE o_orderkey % 2 = 1)"""


@query("j12_match_titles", f"""WITH {SIDES}, a AS (SELECT local, remote, round(abs(l.d - r.d), 9) <= 2 AS close FROM l JOIN r USING (t)), b AS (SELECT *, bool_or(close) OVER (PARTITION BY local) AS best FROM a),
m AS (SELECT local, remote FROM b WHERE close = best UNION SELECT local, remote FROM l JOIN r ON round(abs(l.d - r.d), 9) <= 2 WHERE local NOT IN (SELECT local FROM a)), n AS (SELECT local, count(DISTINCT remote) AS n, min(remote) AS remote FROM m GROUP BY local)
SELECT l.local, CASE WHEN n = 1 THEN n.remote END AS remote, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM l LEFT JOIN n USING (local)""")
def j12(spark, sf):
    l, r = durations(spark, sf)
    o = table(spark, sf, "orders")
    l = l.join(o.select(c("o_orderkey").alias("local"), (c("o_custkey") % 300).cast("string").alias("x")), "local").withColumn("l_title", F.concat("l_title", "x")).drop("x", "g")
    r = r.join(o.select(c("o_orderkey").alias("remote"), (c("o_custkey") % 400).cast("string").alias("x")), "remote").withColumn("r_title", F.concat("r_title", "x")).drop("x", "g")
    return J.match_titles(l, r)


@query("j13_contained", """WITH a AS (SELECT DISTINCT p_type || ' ' || p_brand AS l FROM part), b AS (SELECT DISTINCT p_type AS r FROM part UNION SELECT DISTINCT p_type || ' ' || p_brand FROM part WHERE p_size = 7),
m AS (SELECT l, r, CASE WHEN l = r THEN 0 ELSE 1 END AS k FROM a JOIN b ON l = r OR (length(least(l, r)) >= 0 AND length(CASE WHEN length(l) < length(r) THEN l ELSE r END) >= 5 AND (contains(l, r) OR contains(r, l))))
SELECT l AS "left", arg_min(r, (k, r)) AS "right" FROM m GROUP BY l""")
def j13(spark, sf):
    p = table(spark, sf, "part")
    both = F.concat_ws(" ", "p_type", "p_brand")
    left = p.select(both.alias("name")).distinct()
    right = p.select(c("p_type").alias("name")).unionByName(p.filter("p_size = 7").select(both.alias("name"))).distinct()
    return J.contained_match(left, right)


@query("j14_coalesced_lookup", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'id' || doc_id WHEN doc_id % 3 = 0 THEN 'name' || source END AS v FROM documents")
def j14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", c("doc_id").alias("id"), F.when(c("doc_id") % 3 == 0, c("source")).alias("name"))
    by_id = d.filter("id % 2 = 0").select("id", F.concat(F.lit("id"), c("id").cast("string")).alias("v"))
    by_name = d.filter("name IS NOT NULL").select("name", F.concat(F.lit("name"), "name").alias("v")).distinct()
    return J.coalesced_lookup(d, by_id, by_name, "v").select("doc_id", "v")


@query("j15_suppress_channels", """WITH p AS (SELECT p_partkey, p_partkey % 300 AS ch, CASE WHEN p_size % 2 = 0 THEN 'channel' ELSE 'playlist' END AS t, CASE WHEN p_size % 5 = 0 THEN 'approved' ELSE 'pending' END AS s FROM part)
SELECT p_partkey FROM p WHERE t <> 'channel' OR ch NOT IN (SELECT ch FROM p WHERE t = 'playlist' AND s = 'approved')""")
def j15(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (c("p_partkey") % 300).cast("string").alias("channel_id"), F.when(c("p_size") % 2 == 0, "channel").otherwise("playlist").alias("url_type"), F.when(c("p_size") % 5 == 0, "approved").otherwise("pending").alias("status"))
    return J.suppress_channels(p).select("p_partkey")


@query("j16_aligned", "SELECT vec_id, label, label % 3 AS pred FROM embeddings")
def j16(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    rows = stored(numbered(e, "place", c("vec_id")), "places")
    frozen = rows.select("label", (c("label") % 3).alias("pred"), c("place").alias("row"))
    return J.aligned(rows, frozen, "place", "row", ["label"]).select("vec_id", "label", "pred")


@query("j17_first_wins", "SELECT name, coalesce(min(CASE WHEN p = 0 THEN url END), min(url)) AS url FROM (SELECT p_type AS name, p_name AS url, 0 AS p FROM part WHERE p_size < 10 UNION ALL SELECT p_brand, p_name, 1 FROM part UNION ALL SELECT p_type, p_name, 1 FROM part WHERE p_size > 20) GROUP BY name")
def j17(spark, sf):
    p = table(spark, sf, "part")
    a = p.filter("p_size < 10").select(c("p_type").alias("name"), c("p_name").alias("url"))
    b = p.select(c("p_brand").alias("name"), c("p_name").alias("url")).unionByName(p.filter("p_size > 20").select(c("p_type").alias("name"), c("p_name").alias("url")))
    return J.first_wins(a, b)


@query("j18_attach_by_stem", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ID' || o_orderkey ELSE '' END AS youtube_id FROM orders")
def j18(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.when(c("o_orderkey") % 2 == 0, "D:\\x\\").otherwise("/data/"), F.lit("a ["), c("o_orderkey").cast("string"), F.lit("].wav")).alias("path"))
    index = o.filter("o_orderkey % 3 = 0").select(F.concat(F.lit("a ["), c("o_orderkey").cast("string"), F.lit("]")).alias("stem"), F.concat(F.lit("ID"), c("o_orderkey").cast("string")).alias("youtube_id"))
    return J.attach_by_stem(o, index, "path", ["youtube_id"]).drop("path")


@query("j19_borrow", "SELECT DISTINCT l_orderkey AS file_id, 'p' || l_orderkey AS path FROM lineitem")
def j19(spark, sf):
    l = table(spark, sf, "lineitem").select(c("l_orderkey").alias("file_id")).distinct()
    return J.borrow(l, table(spark, sf, "orders").select(c("o_orderkey").alias("file_id"), F.concat(F.lit("p"), c("o_orderkey").cast("string")).alias("path")), "file_id", "path")




@query("j20_overlay", """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'picked' ELSE 'downloaded' END AS stage, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 1 THEN 'new' WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note
FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0) AND (o_orderkey % 4 = 0 OR o_orderkey % 7 <> 0)""")
def j20(spark, sf):
    stage = F.when(c("o_orderkey") % 4 == 0, "picked").otherwise("downloaded").alias("stage")
    o = table(spark, sf, "orders")
    state = o.filter("o_orderkey % 3 <> 0").select(c("o_orderkey").alias("key"), stage, c("o_orderpriority").alias("note"))
    fresh = o.filter("o_orderkey % 5 <> 0").select(c("o_orderkey").alias("key"), stage, F.when(c("o_orderkey") % 2 == 0, "").otherwise("new").alias("note"))
    return J.overlay(state, fresh, "key", o.filter("o_orderkey % 7 <> 0").select(c("o_orderkey").alias("key")))


@query("j21_work_list", """SELECT 'todo' AS kind, o_orderkey AS k FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus = 'O' UNION ALL SELECT 'missing', c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j21(spark, sf):
    e = table(spark, sf, "orders").select(c("o_custkey").alias("show"), "o_orderkey", (c("o_orderstatus") != "O").alias("has_turns"))
    todo, missing = J.work_list(e, table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(c("c_custkey").alias("show")))
    return todo.select(F.lit("todo").alias("kind"), c("o_orderkey").alias("k")).unionByName(missing.select(F.lit("missing").alias("kind"), c("show").alias("k")))


@query("j22_loose_uploads", "SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'seen' ELSE 'new' END AS status FROM events WHERE event_id % 3 <> 0")
def j22(spark, sf):
    e = table(spark, sf, "events").select(c("event_id").alias("id"))
    return J.loose_uploads(e, e.filter("id % 3 = 0"), e.filter("id % 4 = 0"))
